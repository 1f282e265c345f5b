"""Chapters and outline from blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

HEADING = r"^h[1-3]$"


def plain_blocks(blocks: DataFrame) -> DataFrame:
    """Each stored block once, as the outline operators read it; a null text is an empty one. One shuffle by document serves all that follows."""
    return blocks.select("doc_id", "block_no", "kind", "level", "page_no", F.coalesce("text", F.lit("")).alias("text"), "first_line_indent_em", "space_before_em").repartition("doc_id").distinct()


def cut_levels(blocks: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, cut, chapters, lead: the heading level at which a book is cut.

    The first level from `level` down that is there and gives two chapters, else the last there is; 0 without headings.
    `lead` blocks stand before the first such heading; they are a chapter of their own only if they are more than one.
    """
    order = Window.partitionBy("doc_id").orderBy("block_no")
    rows = blocks.select("doc_id", "block_no", "kind", (F.row_number().over(order) - 1).alias("at"))
    stats = [F.count("*").alias("blocks")]
    for k in (1, 2, 3):
        mine = F.col("kind") == f"h{k}"
        stats += [F.count_if(mine).alias(f"n{k}"), F.min(F.when(mine, F.col("at"))).alias(f"lead{k}")]
    g = rows.groupBy("doc_id").agg(*stats)
    made = {k: F.col(f"n{k}") + F.when(F.col(f"lead{k}") > 1, 1).otherwise(0) for k in (1, 2, 3)}
    there = {k: F.col(f"n{k}") > 0 for k in (1, 2, 3)}
    deepest = F.greatest(*(F.when(there[k], k).otherwise(0) for k in (1, 2, 3)))
    last = F.when(deepest >= level, deepest).otherwise(deepest)
    first_good = F.coalesce(*(F.when(there[k] & (made[k] >= 2), k) for k in (1, 2, 3) if k >= level), last) if level <= 3 else last
    g = g.withColumn("cut", first_good.cast("int"))
    pick = lambda f, other: reduce(lambda acc, k: F.when(F.col("cut") == k, f(k)).otherwise(acc), (1, 2, 3), other)
    return g.select("doc_id", "cut", pick(lambda k: made[k], F.lit(1)).cast("int").alias("chapters"), pick(lambda k: F.col(f"lead{k}"), F.lit(0)).cast("int").alias("lead"))


def chapters(blocks: DataFrame, level: int = 1) -> DataFrame:
    """blocks with chapter (from 1), cut and chapter_title; a single block before the first chapter heading is left out."""
    cuts = cut_levels(blocks, level)
    order = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum((F.col("kind") == F.concat(F.lit("h"), F.col("cut"))).cast("int")).over(order)
    rows = blocks.join(cuts.select("doc_id", "cut", "lead"), "doc_id").withColumn("n", at).where((F.col("cut") == 0) | (F.col("n") > 0) | (F.col("lead") > 1))
    rows = rows.withColumn("chapter", (F.col("n") + F.when((F.col("lead") > 1) | (F.col("cut") == 0), 1).otherwise(0)).cast("int"))
    start = (F.col("kind") == F.concat(F.lit("h"), F.col("cut"))) & (F.col("cut") > 0)
    title = F.max(F.when(start, T.clean(F.col("text")))).over(Window.partitionBy("doc_id", "chapter"))
    return rows.withColumn("chapter_title", F.coalesce(title, F.lit(""))).drop("n", "lead")


def anchors(chaptered: DataFrame) -> DataFrame:
    """doc_id, entry_no (from 0), level, title, chapter, anchor, block_no of every heading with a text, in reading order."""
    heads = chaptered.where(F.col("kind").rlike(HEADING)).withColumn("title", T.clean(F.col("text"))).where("title <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no"))
    return heads.select("doc_id", (n - 1).alias("entry_no"), F.substring("kind", 2, 1).cast("int").alias("level"), "title", "chapter", F.concat(F.lit("h"), n).alias("anchor"), "block_no")


def nested(outline: DataFrame) -> DataFrame:
    """outline with parent (the nearest earlier entry of a smaller level, null at the top) and depth (from 0).

    Levels are 1 to 3, so three running maxima find the parent; no recursion is needed.
    """
    before = Window.partitionBy("doc_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("entry_no"))).over(before) for k in (1, 2)}
    rows = outline.withColumns({"l1": last[1], "l2": last[2]})
    none = F.lit(None).cast("int")
    parent = F.when(F.col("level") == 2, F.col("l1")).when(F.col("level") == 3, F.greatest("l1", "l2")).otherwise(none)
    # a level-2 parent has a parent itself if any level-1 entry comes before it
    second = (F.col("l2").isNotNull()) & (F.col("l2") > F.coalesce("l1", F.lit(-1))) & F.col("l1").isNotNull()
    depth = F.when(parent.isNull(), 0).when((F.col("level") == 3) & second, 2).otherwise(1)
    return rows.withColumn("parent", parent).withColumn("depth", depth).drop("l1", "l2")


def play_order(outline: DataFrame) -> DataFrame:
    """Navigation points in reading order, which is preorder, and the book's depth (its deepest level)."""
    book = Window.partitionBy("doc_id")
    return outline.select("doc_id", "entry_no", (F.row_number().over(book.orderBy("entry_no"))).alias("play_order"), F.max("level").over(book).alias("depth"))


def chapter_href(chapter: F.Column, anchor: F.Column) -> F.Column:
    href = F.format_string("text/ch%03d.xhtml", chapter)
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(href, F.lit("#"), anchor)).otherwise(href)
