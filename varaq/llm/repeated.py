"""Problem 4: lines that come back in book after book of one source.

Method: distributed PrefixSpan over line-identifier sequences. A sequence is a page's lines in order; items are line
texts without case and non-letters; support is the number of distinct books of the source. The first level keeps the
frequent single lines, and sequences are projected onto them. Each further level extends every frequent prefix by the
items that stand anywhere after its first match (patterns may have gaps), counts them in the projected database
(prefix, book, suffix) and projects that again, until nothing is frequent. Lines that never stand without each other,
one right after the other, grow as one item, so that a long notice is one pattern and not all of its parts. The
occurrences of the frequent sequences, single lines included, are what is found and removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

MIN_BOOKS, MIN_SHARE = 4, 0.2
BROADCAST_ROWS, SALTS = 200_000, 16  # rows of some numbers each that go to every task; beyond that, salted joins


def line_key(text: F.Column) -> F.Column:
    """What is compared: the letters, in one case. Empty if there are none."""
    return F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}]+", "")


def _sources(books: DataFrame) -> DataFrame:
    """Each book and its source, once; site is the source, with null as a site of its own."""
    site = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return books.where("doc_id is not null").select("doc_id", site.alias("site"), "source").distinct()


def met(big: DataFrame, small: DataFrame, on: list[str], by: str = "doc_id") -> DataFrame:
    """An equality join whose keys may be hot in `big`: a settled `small` is sent to every task if its rows, counted, are few; else keys are salted."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def _enough(min_books: int, min_share: float) -> F.Column:
    return (F.col("support") >= min_books) & (F.col("support") >= F.col("books") * min_share - 1e-9)


def frequent_lines(page_lines: DataFrame, books: DataFrame, min_books: int = MIN_BOOKS, min_share: float = MIN_SHARE) -> DataFrame:
    """The first level: site, source, doc_id, page_no, line_no, item, books, support of every line whose item is frequent.

    Rows without letters, of books that are not in `books`, or with a null book or text never count. A null
    source is a source of its own. Repeated rows count once, for support and for books.
    """
    owner = _sources(books)
    size = owner.groupBy("site").agg(F.count_distinct("doc_id").alias("books"))
    lines = settled(  # numbers only; counted, then read again
        page_lines.select("doc_id", "page_no", "line_no", line_key(F.col("text")).alias("key")).where("doc_id is not null and key <> ''")
        .select("doc_id", "page_no", "line_no", F.xxhash64("key").alias("item"), F.hash("key").alias("check"))
    )
    # distinct books first, spread over (book, item), so that no hot source meets in one task; then partial counts
    support = lines.select("doc_id", "item", "check").distinct().join(owner, "doc_id").groupBy("site", "item", "check").agg(F.count("*").alias("support"))
    items = settled(support.where(F.col("support") >= min_books).join(size, "site").where(_enough(min_books, min_share)))
    return met(lines.join(owner, "doc_id"), items, ["site", "item", "check"]).drop("check").distinct()


def _sequences(frequent: DataFrame) -> DataFrame:
    """site, source, books, doc_id, seq: the distinct sequences of each book's pages; an element is a run of lines that never part."""
    page = ["site", "source", "books", "doc_id", "page_no"]
    order = Window.partitionBy(*page).orderBy("line_no", "item")
    rows = settled(frequent.select(*page, "line_no", "item", F.lag("item").over(order).alias("before"), F.lead("item").over(order).alias("after")))
    only = lambda key, other, name: (  # noqa: E731  the one neighbour that an item has wherever it stands
        rows.select("site", key, other).distinct().groupBy("site", key).agg(F.count("*").alias("n"), F.max(other).alias(name), F.count(other).alias("known")).where("n = 1 and known = 1")
    )
    nexts = only("item", "after", "next").select("site", F.col("item").alias("before"), F.col("next").alias("item"))
    previous = only("item", "before", "previous").select("site", F.col("previous").alias("before"), "item")
    bound = settled(nexts.join(previous, ["site", "before", "item"]).withColumn("bound", F.lit(1)))
    tied = met(rows.where("before is not null"), bound, ["site", "before", "item"]).select(*page, "line_no", "item", "bound")
    free = rows.select(*page, "line_no", "item", F.lit(0).alias("bound"))
    marked = free.unionByName(tied).groupBy(*page, "line_no", "item").agg(F.max("bound").alias("bound"))
    run = F.sum(1 - F.col("bound")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    in_order = lambda c, what: F.transform(F.array_sort(c), lambda x: x[what])
    runs = marked.withColumn("run", run).groupBy(*page, "run").agg(in_order(F.collect_list(F.struct("line_no", "item")), "item").alias("items"))
    pages = runs.groupBy(*page).agg(in_order(F.collect_list(F.struct("run", "items")), "items").alias("seq"))
    return pages.select("site", "source", "books", "doc_id", "seq").distinct()


def frequent_sequences(page_lines: DataFrame, books: DataFrame, min_books: int = MIN_BOOKS, min_share: float = MIN_SHARE, frequent: DataFrame | None = None) -> DataFrame:
    """source, pattern (array of item hashes), length, support: the frequent sequences of lines of a page, of any length, gaps allowed.

    Every frequent sequence is here, or is part of one with the same support whose lines never part; single lines all
    are. `frequent`: the first level, if it is known. An empty table gives an empty result.
    """
    first = settled(frequent_lines(page_lines, books, min_books, min_share)) if frequent is None else frequent
    singles = first.select("site", "source", F.array("item").alias("pattern"), "support").distinct()
    found = [singles]
    nothing = F.array().cast("array<bigint>")
    database = settled(_sequences(first).withColumn("prefix", nothing))  # the projection on the empty prefix
    while True:
        grown = database.select("*", F.explode(F.array_distinct("seq")).alias("step"))
        key = ["site", "source", "books", "prefix", "step"]
        support = grown.select(*key, "doc_id").distinct().groupBy(*key).agg(F.count("*").alias("support")).where(_enough(min_books, min_share))
        level = settled(support)
        if level.isEmpty():
            break
        found.append(level.select("site", "source", F.concat("prefix", "step").alias("pattern"), "support").where("size(pattern) > 1"))
        kept = met(grown.drop("source", "books"), level.drop("source", "books", "support"), ["site", "prefix", "step"])
        suffix = F.expr("slice(seq, array_position(seq, step) + 1, size(seq))")  # after the first match: what PrefixSpan projects on
        named = kept.select("site", "doc_id", F.concat("prefix", "step").alias("prefix"), suffix.alias("seq")).where("size(seq) > 0").distinct()
        facts = level.select("site", "source", "books").distinct()
        database = settled(named.join(facts, "site"))
    return reduce(DataFrame.unionByName, found).select("source", "pattern", F.size("pattern").alias("length"), "support", "site").distinct().drop("site")


def repeated_lines(page_lines: DataFrame, books: DataFrame, min_books: int = MIN_BOOKS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, page_no, line_no, source, support, length (of the longest frequent sequence it is part of) of every line in an occurrence of a frequent sequence.

    A sequence is frequent only if its lines are, so its occurrences are occurrences of its lines wherever these stand.
    """
    first = settled(frequent_lines(page_lines, books, min_books, min_share))
    patterns = frequent_sequences(page_lines, books, min_books, min_share, first)
    lines = settled(patterns.select("source", F.explode("pattern").alias("item"), "length").groupBy("source", "item").agg(F.max("length").alias("length")).withColumn("site", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"))
    return met(first, lines, ["site", "item"]).select("doc_id", "page_no", "line_no", "source", "support", "length").distinct()


def without_repeats(page_lines: DataFrame, books: DataFrame, min_books: int = MIN_BOOKS, min_share: float = MIN_SHARE) -> DataFrame:
    """page_lines, all its columns, without the occurrences of frequent sequences."""
    gone = repeated_lines(page_lines, books, min_books, min_share).select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "page_no", "line_no"))).distinct()
    same = [page_lines[c].eqNullSafe(gone[f"__{c}"]) for c in ("doc_id", "page_no", "line_no")]
    return page_lines.join(gone, reduce(lambda a, b: a & b, same), "left_anti")


def found(page_lines: DataFrame, books: DataFrame) -> DataFrame:
    return repeated_lines(page_lines, books).select("doc_id", "page_no", "line_no").distinct()
