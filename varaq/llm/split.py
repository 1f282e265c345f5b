"""Problem 6: chapters over a size limit, cut at natural boundaries with overlap.

Method: bounded-quantifier regex extraction. The alternatives are ordered by boundary strength
(rest of the text, block end, sentence end, white space, any character that does not tear a combining
mark off) and each consumes greedily up to the limit; overlaps come from look-back offsets into the
piece before, computed with SQL array functions. A chapter of very many blocks is cut in sections that hand on
what they can't finish, so that its pieces are those of one expression over all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

SECTION = 512  # block numbers per section: the most blocks that meet in one row; no piece depends on it
KEYS = ("doc_id", "chapter_no")

#: A sentence end seen from behind, one per way of writing: an end mark, closers, then white space or (in zh, ja) nothing.
_CLOSERS = "[\"'”’»)\\]」』》）]"
_ENDS = [f"(?<=[.!?…؟۔]{_CLOSERS}{{0,2}}\\s)(?<!\\s\\p{{Lu}}\\.\\s)(?=[^\\p{{Ll}}])", f"(?<=[。！？]{_CLOSERS}{{0,2}})(?!{_CLOSERS}|[。！？])"]


def piece_pattern(size: int) -> str:
    """Pieces of 1..size characters, by the strongest boundary that fits."""
    run = f"[\\s\\S]{{1,{size}}}"
    last = f"[\\s\\S]{{0,{size - 1}}}\\n"
    sentence = "|".join(run + e for e in _ENDS)
    return f"{run}\\z|{last}|{sentence}|{run}(?<=\\s)|{run}(?![\\p{{M}}\\u200c\\u200d])|{run}"


def lookback_pattern(size: int) -> str:
    """The longest tail of at most size characters that starts at a block, else a sentence, else a word, else anywhere."""
    tail = f"([\\s\\S]{{1,{size}}})\\z"
    ends = "|".join(f"{e}[\\s\\S]{{1,{size}}}\\z" for e in _ENDS)
    return f"(?<=\\n)[\\s\\S]{{1,{size}}}\\z|{ends}|(?<=\\s)(?=\\S)[\\s\\S]{{1,{size}}}\\z|{tail}"


def split_chapters(blocks: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of at most `limit` characters of every chapter whose text is longer than `limit`.

    Input: doc_id, chapter_no, block_no, text (other columns are ignored, whatever their names).
    Output: doc_id, chapter_no, piece_no (from 0), start_pos (of the piece without its overlap, in the
    chapter's text), overlap (string, repeated from the piece before), body (string), chapter_chars.
    overlap + body is the piece; the bodies joined in order are the chapter's text exactly.

    A chapter's text is its blocks' texts by block_no, joined by one newline. Null texts are left out; an
    empty text counts as an empty block; equal rows count once; two texts under one block_no both count,
    in text order; null keys form a chapter of their own; an empty table gives an empty result. No task ever holds
    more than 512 block numbers of one chapter.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    most = limit - overlap
    rows = blocks.select(*KEYS, "block_no", "text").where("text is not null")
    section = F.coalesce(F.floor(F.col("block_no") / SECTION), F.lit(-1))
    sections = (
        rows.groupBy(*KEYS, section.alias("section"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("block_no", "text"))), lambda b: b["text"]), "\n").alias("text"))
    )
    # what is known about sections comes from lengths alone: repeated rows go by hashes, and texts are shuffled once
    sizes = rows.select(*KEYS, "block_no", section.alias("section"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"), F.length("text").alias("n")).distinct()
    facts = sizes.groupBy(*KEYS, "section").agg((F.sum("n") + F.count("*") - 1).alias("chars"))
    chapter = Window.partitionBy(*KEYS)
    ordered = chapter.orderBy("section")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    placed = settled(
        facts.withColumns({"chapter_chars": F.sum("chars").over(chapter) + F.count("*").over(chapter) - 1, "parts": F.count("*").over(chapter)})
        .where(F.col("chapter_chars") > limit)
        .select(*KEYS, "section", "chapter_chars", "parts", F.lead(F.lit(1)).over(ordered).isNull().alias("last"), F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0)).alias("base"))
    )
    whole = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    both = _joined(sections, placed).withColumn("whole", whole).drop("text")
    none = {"carry": F.lit(""), "before": F.lit(None).cast("string")}
    ready = both.where("parts = 1").withColumns(none)
    if not placed.where("parts > 1").isEmpty():
        parted = settled(both.where("parts > 1"))  # few chapters
        ready = ready.unionByName(_joined(parted, _handed_on(parted, most, overlap, none)))
    cut = settled(_cut(ready, most).drop("whole", "text", "last", "parts"))  # the pieces, once: they are counted, then read
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    numbers = cut.select(*KEYS, "section", F.size("bodies").alias("n")).select(*KEYS, "section", first.alias("first"))
    pieces = (
        _joined(cut, numbers)
        .withColumn("ends", F.aggregate("bodies", F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.length(b)))))
        .select(*KEYS, (F.col("base") - F.length("carry")).alias("base"), "before", "bodies", "ends", "first", "chapter_chars", F.posexplode("bodies").alias("i", "body"))
    )
    back = F.when(F.col("i") > 0, F.expr("bodies[i - 1]")).otherwise(F.col("before"))
    lookback = F.regexp_extract(F.expr(f"right(previous, {overlap})"), lookback_pattern(overlap), 0) if overlap else F.lit("")
    return pieces.withColumn("previous", back).select(
        *KEYS,
        (F.col("first") + F.col("i")).cast("int").alias("piece_no"),
        (F.col("base") + F.expr("ends[i]")).alias("start_pos"),
        F.coalesce(lookback, F.lit("")).alias("overlap"),
        "body",
        "chapter_chars",
    )


def _cut(sections: DataFrame, most: int) -> DataFrame:
    """sections with text (what was handed on, and their own), bodies (the pieces that no later text can change) and rest (what to hand on)."""
    cut = sections.withColumn("text", F.concat("carry", "whole")).withColumn("all", F.regexp_extract_all("text", F.lit(piece_pattern(most)), F.lit(0)))
    # a piece is settled if the longest one from its start, and the character that decides about it, lie inside
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))
    step = lambda a, b: F.when(a["at"] + most + 2 <= F.length("text"), F.struct((a["n"] + 1).alias("n"), (a["at"] + F.length(b)).alias("at"))).otherwise(a)
    done = F.when(F.col("last"), F.struct(F.size("all").alias("n"), F.length("text").alias("at"))).otherwise(F.aggregate("all", start, step))
    return cut.withColumn("done", done).withColumns({"bodies": F.expr("slice(all, 1, done.n)"), "rest": F.expr("substring(text, done.at + 1)")}).drop("all", "done")


def _handed_on(parted: DataFrame, most: int, overlap: int, none: dict) -> DataFrame:
    """KEYS, section, carry (text that the section before couldn't finish, less than two pieces), before (the end of the piece before).

    All sections are cut at once with what the last round handed them, until nothing changes: after a round or two, as
    cuts from different starts soon fall together; at worst after as many rounds as a chapter has sections.
    """
    ordered = Window.partitionBy(*KEYS).orderBy("section")
    state = parted.select(*KEYS, "section", *(v.alias(k) for k, v in none.items()))
    while True:
        out = _cut(_joined(parted, state), most)
        tail = F.when(F.size("bodies") > 0, F.expr(f"right(bodies[size(bodies) - 1], {overlap})")).otherwise(F.col("before"))
        ends = out.select(*KEYS, "section", F.struct("carry", "before").alias("had"), "rest", tail.alias("tail"))
        new = settled(ends.select(*KEYS, "section", "had", F.coalesce(F.lag("rest").over(ordered), F.lit("")).alias("carry"), F.lag("tail").over(ordered).alias("before")))
        state = new.drop("had")
        if new.where(~F.struct("carry", "before").eqNullSafe(F.col("had"))).isEmpty():
            return state


def _joined(sections: DataFrame, facts: DataFrame) -> DataFrame:
    """sections with the facts about them; null keys meet as well."""
    right = facts.select(*(F.col(c).alias(f"r_{c}" if c in (*KEYS, "section") else c) for c in facts.columns))
    same = [sections[c].eqNullSafe(right[f"r_{c}"]) for c in (*KEYS, "section")]
    return sections.join(right, reduce(lambda a, b: a & b, same)).drop(*(f"r_{c}" for c in (*KEYS, "section")))


def found(blocks: DataFrame, limit: int = 2000) -> DataFrame:
    """Each chapter that had to be cut."""
    return split_chapters(blocks, limit).where("piece_no = 0").select("doc_id", "chapter_no")


def checks(blocks: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """doc_id, chapter_no, chapter_chars of every chapter that is cut, and what must hold: rebuilt (its pieces without overlaps are its text),
    within (no piece is over the limit) and repeated (each overlap is the end of the piece before, and not over its limit)."""
    rows = blocks.select(*KEYS, "block_no", "text").where("text is not null").distinct()
    texts = rows.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "\n").alias("text"))
    g = split_chapters(blocks, limit, overlap).groupBy(*KEYS, "chapter_chars").agg(F.array_sort(F.collect_list(F.struct("piece_no", "overlap", "body"))).alias("p"))
    both = texts.join(g, reduce(lambda a, b: a & b, [texts[k].eqNullSafe(g[k]) for k in KEYS])).select(*(texts[k] for k in KEYS), "text", "p", F.col("chapter_chars").cast("bigint").alias("chapter_chars"))
    rebuilt = F.array_join(F.transform("p", lambda x: x["body"]), "") == F.col("text")
    within = F.forall("p", lambda x: F.length(x["overlap"]) + F.length(x["body"]) <= limit)
    repeated = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.when(i == 0, F.get("p", i)["overlap"] == "").otherwise(F.endswith(F.get("p", i - 1)["body"], F.get("p", i)["overlap"]) & (F.length(F.get("p", i)["overlap"]) <= overlap)))
    return both.select(*KEYS, "chapter_chars", rebuilt.alias("rebuilt"), within.alias("within"), repeated.alias("repeated"))
