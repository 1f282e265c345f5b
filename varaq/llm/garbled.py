"""Problem 2: text decoded with the wrong encoding, found and restored.

Method: garbled records are joined with clean near-twins on their text stripped of non-ASCII characters, and
transformations are inferred from what is left: the characters that stand where others do. A pair of words is a twin if
their ASCII letters agree, or if both stand at the same place of the same ASCII pattern of a span. Twins are found for
all words at once by what a transformation leaves alone: the bytes. Every word meets the more frequent ones whose bytes
in one encoding are its own in another (written, then read wrongly, once or twice): an equality join, without pairs of a
place and without limits on candidates. Encodings outside the list are learned as well: twins by their ASCII letters are
aligned character by character, and characters that nearly always stand for one other become a mapping.

Transformations and mappings with enough different words are applied, in reverse, to all remaining words. A word is
garbled if that turns it into a word of the corpus that is far more frequent, or, where the transformation's own checks
suffice (several bytes to a character), into letters of the corpus. Only distinct words go through Python; spans are met
again by one join with the garbled words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .lookalike import LATIN_LOOKALIKES, PERSIAN_FOLDS

#: Encodings tried as writer and as reader.
CODECS = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1256", "iso8859_5", "iso8859_6", "koi8_r", "cp866", "cp874", "gbk", "cp932", "euc_jp", "cp949", "big5")
MULTI = ("utf-8", "gbk", "cp932", "euc_jp", "cp949", "big5")
MIN_WORDS, TIMES, MIN_TIMES, RATIO = 2, 5, 5, 3  # RATIO: how often the clean twin stands for each time of the garbled one
ALIGNED, MIN_ALIGNED, SURE = "aligned", 5, 0.9  # words that show a character mapping, and how many of a character's words must agree
_FOLDED, _FOLDS = ("".join(p[i] for p in PERSIAN_FOLDS.split()) for i in (0, 1))  # old encodings have the Arabic letters only
_ALIKE = {p[0]: p[1] for p in LATIN_LOOKALIKES.split() if "Ѐ" <= p[0] <= "ӿ"}
KEYS = ("doc_id", "page_no", "line_no", "span_no")
LOST = "\ufffd"
_LOST = r"[\x{fffd}\x{80}-\x{9f}]"  # never in a clean text
_RUN = "[^\\x00-\\x7F]+"
_TRIM = r"^[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+$"


_TABLES: dict[str, dict[int, str]] = {}


def _table(read: str) -> dict[int, str]:
    """Each character of a one-byte encoding as the character of its byte's number; what it lacks, but bytes without a character, can't be."""
    if read in _TABLES:
        return _TABLES[read]
    if read in ("cp1252", "cp1256", "cp1251", "cp874"):
        table = {i: chr(i) if i < 0xA0 or read == "cp1252" else "\uffff" for i in range(0x80, 0x100)}
    else:
        table = {i: "\uffff" for i in range(0x80, 0x100)}
    for i in range(0x80, 0x100):
        try:
            table[ord(bytes([i]).decode(read))] = chr(i)
        except UnicodeDecodeError:
            pass
    _TABLES[read] = table
    return table


def to_bytes(word: str, read: str) -> bytes | None:
    """The bytes that were read as this word; None if none can have been."""
    try:
        return word.encode(read) if read in MULTI else word.translate(_table(read)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def read_back(word: str, written: str, read: str) -> str | None:
    """What was written in one encoding, given what came of reading it in another; None if it can't have been so."""
    data = to_bytes(word, read)
    return None if data is None else from_bytes(data, written)


def from_bytes(data: bytes, written: str) -> str | None:
    try:
        return data.decode(written)
    except UnicodeDecodeError as e:
        if written == "utf-8" and len(data) > 3:  # a word cut inside a character, at either end, or one lost byte
            text = data.decode(written, "ignore")
            kept = len(text.encode(written))
            return text if kept >= max(len(data) - 4, 0.7 * len(data)) and len(text) * 2 <= len(data) + 2 and not text.isascii() else None
        if written == "utf-8" and len(data) > 1 and e.start == 0 and e.reason == "unexpected end of data":
            return LOST  # the start of one character
        return None


def undo(word: str, chain: str) -> str | None:
    """A chain is 'written>read', or two of them from the last to the first, joined by a space."""
    for step in chain.split(" "):
        back = read_back(word, *step.split(">"))
        if back is None or back == word:
            return None
        word = back
    return word


_TWICE = ("cp1252", "cp1256", "cp1251", "mac_roman", "cp437", "cp850")


def _loose(data: bytes) -> str:
    return "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in data)


def _beyond_ascii(text: F.Column) -> F.Column:
    return text.rlike("[^\\x00-\\x7F]")


def _beyond(column: str) -> F.Column:
    """Has a character beyond ASCII."""
    return _beyond_ascii(F.col(column))


def _unmixed(word: F.Column) -> F.Column:
    """With Latin letters for Cyrillic ones that look like them."""
    return F.translate(word, "".join(_ALIKE), "".join(_ALIKE.values()))


def words_of(spans: DataFrame) -> DataFrame:
    """word, n: the distinct words with a non-ASCII character (between plain spaces)."""
    words = spans.where(_beyond("text")).select(F.explode(F.split("text", " ")).alias("word")).where(_beyond("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


class _Encodings(dict):
    """Which of CODECS have a character, as bits, remembered: a word is in those that have all of its characters."""

    def __init__(self, test: Callable[[str, str], bool]):
        super().__init__()
        self.test = test

    def __missing__(self, char: str) -> int:
        self[char] = sum(1 << i for i, c in enumerate(CODECS) if self.test(char, c))
        return self[char]

    def of(self, word: str) -> list[str]:
        bits = -1
        for c in set(word):
            bits &= self[c]
        return [c for i, c in enumerate(CODECS) if bits >> i & 1]


def _writes(char: str, codec: str) -> bool:
    try:
        return bool(char.encode(codec))
    except UnicodeEncodeError:
        return False


def encodings() -> tuple[_Encodings, _Encodings]:
    """(those that a word may have been read in, those that it may be written in)."""
    return _Encodings(lambda c, r: to_bytes(c, r) is not None), _Encodings(_writes)


def encoded(word: str, n: int, read: _Encodings, write: _Encodings) -> list[tuple[str, str, bytes]]:
    """(side, label, bytes) of a word: what may have been read as it ('r') and, if it is frequent enough to be a twin, what it may have been written as ('w')."""
    out = [("r", r, b) for r in read.of(word) if (b := to_bytes(word, r)) is not None]
    if n >= RATIO:
        out += [("w", w, word.encode(w)) for w in write.of(word)]
        once = word.encode("utf-8", "ignore")
        for a in _TWICE:
            mid = _loose(once) if a == "cp1252" else once.decode(a, "ignore")
            out.append(("w", f"utf-8>{a} utf-8", mid.encode()))
    return out


def twins(spans: DataFrame, words: DataFrame) -> DataFrame:
    """garbled, clean, chain, n: each word and a word RATIO times as frequent whose bytes it has, with the same ASCII letters or at a place that both stand at."""

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = encodings()
        for pdf in batches:
            rows = [(w, n, side, label, b) for w, n in zip(pdf["word"], pdf["n"]) for side, label, b in encoded(w, n, *both)]
            yield pd.DataFrame(rows, columns=["word", "n", "side", "label", "b"])

    spread = spans.sparkSession.sparkContext.defaultParallelism  # a small table, but seconds of work
    whole = words.where(~F.col("word").rlike(_LOST)).select("word", "n", (F.length(F.regexp_replace("word", "[^A-Za-z]", "")) >= 3).alias("stripped"))
    runs = whole.where(~F.col("stripped")).select(F.explode(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    units = whole.where("stripped").select("word", "n").unionByName(runs)
    sides = units.repartition(spread, "word").mapInPandas(bytes_of, "word string, n bigint, side string, label string, b binary")
    sides = settled(sides.select("word", "n", "side", "label", F.xxhash64("b").alias("h1"), F.hash("b").alias("h2")))
    write, read = sides.where("side = 'w'").select(F.col("word").alias("clean"), F.col("n").alias("top"), F.col("label").alias("w"), "h1", "h2"), sides.where("side = 'r'").select(F.col("word").alias("garbled"), "n", F.col("label").alias("r"), "h1", "h2")
    met_ = read.join(write, ["h1", "h2"]).where((F.col("garbled") != F.col("clean")) & (F.col("top") >= RATIO * F.col("n")) & ((F.length("garbled") > 1) | (F.length("clean") > 1)))
    first, second = F.split("w", " ").getItem(0), F.split("w", " ").getItem(1)
    double = F.contains("w", F.lit(" "))
    chain = F.when(double & F.col("r").isin(*_TWICE), F.concat(second, F.lit(">"), F.col("r"), F.lit(" "), first)).when(~double & (F.col("w") != F.col("r")), F.concat("w", F.lit(">"), "r"))
    pairs = settled(met_.select("garbled", "clean", chain.alias("chain"), "n").where("chain is not null"))
    stripped = F.col("garbled").rlike("[A-Za-z]")  # bytes agree, so these letters do
    # the words of a span by their place in the span's ASCII pattern: letters and digits in runs, so that names and numbers agree
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^\\x20-\\x7e]", ""), "[A-Za-z]+", "a"), "[0-9]+", "0")
    mostly = F.length(F.regexp_replace("text", "[^A-Za-z]", "")) * 2 < F.length("text")
    lines = spans.where(F.col("text").rlike("[A-Za-z0-9]") & _beyond("text") & mostly & ~F.col("text").rlike(_LOST)).select(pattern.alias("pattern"), F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)).alias("w"))
    places = settled(lines.select(F.posexplode("w").alias("at", "word"), F.xxhash64("pattern", F.size("w")).alias("pattern")).distinct())
    open_ = pairs.where(~stripped).select("garbled", "clean").distinct()
    at_garbled = places.join(open_, places["word"] == open_["garbled"]).select("pattern", "at", "garbled", "clean")
    shared = at_garbled.join(places.select("pattern", "at", F.col("word").alias("clean")), ["pattern", "at", "clean"], "left_semi").select("garbled", "clean").distinct()
    return pairs.where(stripped).unionByName(pairs.where(~stripped).join(shared, ["garbled", "clean"], "left_semi"))


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """What stands for which character: stretches beyond ASCII between the same ASCII ones, one or as many characters to each."""
    parts, others = (_STRETCH.split(x) for x in (garbled, clean))
    if parts[::2] != others[::2]:
        return []
    out = []
    for g, c in zip(parts[1::2], others[1::2]):
        k, rest = divmod(len(g), len(c))
        if rest or not k:
            return []
        out += [(g[i * k : i * k + k], x) for i, x in enumerate(c)]
    return out


_STRETCH = re.compile("([^\\x00-\\x7f]+)")


def same_look(a: str, b: str) -> bool:
    """Whether two stretches differ by accents, invisible characters and forms of the same characters only, so that no wrong decoding lies between them."""
    fold = lambda s: "".join(_LOOKS.get(c, c) for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf"))
    return fold(a) == fold(b)


_LOOKS = {p[0]: p[1] for p in (PERSIAN_FOLDS + " " + LATIN_LOOKALIKES).split()}


def mappings(words: DataFrame) -> dict[str, str]:
    """Characters, or stretches of them, that stand for one other in SURE of at least MIN_ALIGNED twins by ASCII letters: encodings that are in no list."""
    key = F.regexp_replace("word", "[^\\x21-\\x7e]", "")
    keyed = words.where(~F.col("word").rlike(_LOST)).withColumn("key", key).where("length(regexp_replace(key, '[^A-Za-z]', '')) >= 3")
    best = keyed.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("clean"), F.max("n").alias("top"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(g, a, b) for g, c in zip(pdf["word"], pdf["clean"]) for a, b in aligned(g, c) if a != b and b.isalpha() and not same_look(a, b)]
            yield pd.DataFrame(out, columns=["word", "old", "new"])

    pairs = keyed.join(best, "key").where((F.col("word") != F.col("clean")) & (F.col("top") >= RATIO * F.col("n"))).select("word", "clean")
    shown = pairs.mapInPandas(align, "word string, old string, new string").groupBy("old", "new").agg(F.count_distinct("word").alias("words"))
    total = shown.groupBy("old").agg(F.sum("words").alias("all"), F.max_by("new", F.struct("words", "new")).alias("new"), F.max("words").alias("words"))
    seen = total.where((F.col("words") >= MIN_ALIGNED) & (F.col("words") >= SURE * F.col("all"))).select("old", "new")
    return {r["old"]: r["new"] for r in seen.collect()}  # at most one row a character or short stretch


def learn(spans: DataFrame, words: DataFrame, min_words: int = MIN_WORDS) -> list[str]:
    """The transformations that at least min_words different twins (or MIN_TIMES times the same) agree on, the best supported first."""
    votes = twins(spans, words).groupBy("chain").agg(F.count_distinct("garbled").alias("words"), F.sum("n").alias("n"))
    rows = votes.where((F.col("words") >= min_words) | (F.col("n") >= MIN_TIMES)).orderBy(F.desc("words"), "chain").collect()  # at most one row a chain
    return [r["chain"] for r in rows]


def garbled_words(words: DataFrame, learned: list[str], mapped: dict[str, str] | None = None) -> DataFrame:
    """word, restored (null where characters are lost), chain, of every garbled word."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = [(k, k.split(" ")[0].split(">"), k.partition(" ")[2]) for k in learned]
        by_reader: dict[str, list] = {}
        for k, first, rest in steps:
            by_reader.setdefault(first[1], []).append((k, first[0], rest, k.split(">")[0] in MULTI))
        read, _ = encodings()
        known = re.compile("|".join(map(re.escape, sorted(mapped, key=lambda x: (-len(x), x))))) if mapped else None
        for pdf in batches:
            out = []
            for w, n in zip(pdf["word"], pdf["n"]):
                for reader in read.of(w):
                    if reader not in by_reader or (data := to_bytes(w, reader)) is None:
                        continue
                    for k, written, rest, multi in by_reader[reader]:
                        r = from_bytes(data, written)
                        if r is not None and r not in (w, LOST) and rest:
                            r = undo(r, rest)
                        if r is not None and r != w and (r == LOST and k == "utf-8>cp1252" or (r.isprintable() or "\u200c" in r) and LOST not in r):
                            out.append((w, n, r, k, multi))
                if known and known.search(w) and w != (r := known.sub(lambda m: mapped[m[0]], w)):
                    out.append((w, n, r, ALIGNED, False))
            yield pd.DataFrame(out, columns=["word", "n", "restored", "chain", "multi"])

    lost = words.where(F.col("word").rlike(_LOST)).select("word", F.lit(None).cast("string").alias("restored"), F.lit(None).cast("string").alias("chain"), F.lit(0.0).alias("score"))
    tried = words.mapInPandas(apply, "word string, n bigint, restored string, chain string, multi boolean")
    bare = lambda c: F.translate(F.regexp_replace(c, _TRIM, ""), _FOLDED, _FOLDS)
    vocabulary = words.where(~F.col("word").rlike(_LOST)).groupBy(bare("word").alias("bare")).agg(F.sum("n").alias("known"))
    # letters of the corpus: bounded by Unicode
    letters = words.where(~F.col("word").rlike(_LOST)).select(F.explode(F.split("word", "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("k"))
    common = letters.where(_beyond("c")).agg(F.sum("k").alias("all"), F.collect_list(F.struct("c", "k")).alias("l")).select(F.array_sort(F.expr("transform(filter(l, x -> x.k >= 20 and x.k >= all * 0.00001), x -> x.c)")).alias("common"))
    joined = (
        tried.withColumn("bare", bare("restored"))
        .join(vocabulary, "bare", "left")
        .join(vocabulary.select(F.col("bare").alias("own"), F.col("known").alias("seen")), bare("word") == F.col("own"), "left")
        .crossJoin(F.broadcast(common))  # one row
        .withColumn("known", F.coalesce("known", F.lit(0)))
        .withColumn("seen", F.greatest(F.coalesce("seen", F.lit(0)), "n"))
    )
    legible = F.size(F.array_except(F.filter(F.array_distinct(F.split("restored", "")), lambda c: c.rlike("[^\\x00-\\x7F]")), F.col("common"))) == 0
    shorter = F.length("restored") < F.length("word")
    wide = F.col("chain").startswith("utf-8") | (~F.col("word").rlike("[A-Za-z]") & F.col("restored").rlike("[^\\x00-\\x7F]{2}"))
    # a short word that look-alike letters alone keep from being ASCII is no garbled one
    mixed = ~_beyond_ascii(_unmixed(F.col("word"))) & (F.length("word") <= 4)
    thai = F.col("chain").startswith("cp874>") & legible & ~F.col("word").rlike("[A-Za-z]") & F.col("word").rlike("[\\x{c0}-\\x{ff}].*[\\x{c0}-\\x{ff}]") & F.col("restored").rlike("[\\x{e01}-\\x{e5b}]{4}")
    often = ~mixed & ~F.col("restored").rlike("\\p{S}") & (F.col("known") >= 4) & (F.col("known") >= F.when(F.length("bare") > 1, TIMES).otherwise(20 * TIMES) * F.col("seen"))
    good = (F.col("multi") & wide & legible & shorter & _beyond("restored")) | ((F.length("bare") > 0) & often) | thai | (F.col("restored") == LOST)
    hits = joined.where(good).select("word", F.nullif("restored", F.lit(LOST)).alias("restored"), "chain", (F.log1p("known") + F.when(F.col("multi"), 5.0).otherwise(0.0)).alias("score"))
    return hits.unionByName(lost).groupBy("word").agg(F.max_by(F.struct("restored", "chain"), F.struct("score", "restored", "chain")).alias("b")).select("word", "b.restored", "b.chain")


def repaired(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, text, restored, lost: every span with a garbled word; restored is its text with all words put right that can be.

    Null texts are never garbled; equal rows count once; other columns are ignored. `lost` says that characters are gone for good.
    """
    rows = spans.where("text is not null").select(*keys, "text")
    words = settled(words_of(rows))
    bad = settled(garbled_words(words, learn(rows, words), mappings(words)))
    some = rows.where(_beyond("text")).distinct()
    parts = some.select(*keys, "text", F.posexplode(F.split("text", " ")).alias("at", "word")).where(_beyond("word"))
    hits = parts.join(bad, "word").groupBy(*keys, "text").agg(F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("restored", "word")))).alias("fixed"), F.max(F.col("restored").isNull()).alias("lost"))
    return hits.select(*keys, "text", F.array_join(F.expr("transform(split(text, ' '), (w, i) -> coalesce(fixed[i], w))"), " ").alias("restored"), "lost")


def found(spans: DataFrame) -> DataFrame:
    """The keys of every span with a garbled word."""
    rows = spans.where("text is not null").select(*KEYS, "text")
    words = settled(words_of(rows))
    bad = settled(garbled_words(words, learn(rows, words), mappings(words)).select("word"))
    parts = rows.where(_beyond("text")).select(*KEYS, F.explode(F.array_distinct(F.split("text", " "))).alias("word")).where(_beyond("word"))
    return parts.join(bad, "word", "left_semi").select(*KEYS).distinct()
