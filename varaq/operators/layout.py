"""Lines, pages and documents from positioned, styled spans; classes of lines.

A document is the unit of order: windows run over one book's lines, so the largest book bounds a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled

LINE, PAGE = ("doc_id", "page_no", "line_no"), ("doc_id", "page_no")
# Shares of the body size and of the page, limits, and words in font names.
HEADING_RATIO, NOTE_RATIO, NOTE_REGION, FOLIO_REGION, RUNNING_PAGES, RUNNING_CHARS = 1.12, 0.94, 0.55, 0.85, 3, 60
SCANNED_CHARS = 40
BOLD, ITALIC = "(?i)bold|black|heavy|semibold|demi", "(?i)italic|oblique"


def is_bold(font: Column) -> Column:
    """By the font's name alone."""
    return F.coalesce(font.rlike(BOLD), F.lit(False))


def is_italic(font: Column) -> Column:
    return F.coalesce(font.rlike(ITALIC), F.lit(False))


def distinct_spans(spans: DataFrame, *by: str) -> DataFrame:
    """Each span once; a null text is an empty one. One shuffle, by the keys that the next step needs (document and page)."""
    columns = spans.select("doc_id", "page_no", "line_no", "span_no", F.coalesce("text", F.lit("")).alias("text"), "size", "font", "x0", "top", "x1", "bottom")
    return columns.repartition(*(by or PAGE)).distinct()


def lines(spans: DataFrame) -> DataFrame:
    """One row per line: text, size (that of most characters, to a tenth, ties to the first span), bold and italic (of the longest
    span, ties to the first), chars, box, x_center, fonts (in order of appearance) and runs (the spans in order)."""
    part = F.struct("span_no", "text", F.round("size", 1).alias("size"), "font")
    rows = spans.withColumn("text", F.coalesce("text", F.lit("")))
    grouped = rows.groupBy(*LINE).agg(  # repeated rows fall together in the set, so one shuffle does
        F.array_sort(F.collect_set(part)).alias("runs"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")
    )
    sizes = F.array_distinct(F.transform("runs", lambda r: r["size"]))
    weight = lambda z: F.aggregate(F.filter("runs", lambda r: r["size"].eqNullSafe(z)), F.lit(0), lambda n, r: n + F.length(r["text"]))
    longest = F.transform("runs", lambda r: F.length(r["text"]))
    return (
        grouped.withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
        .withColumns({"sizes": sizes, "weights": F.transform(sizes, weight), "dominant": F.element_at("runs", F.array_position(longest, F.array_max(longest)).cast("int"))})
        .select(
            *LINE, "text", F.element_at("sizes", F.array_position("weights", F.array_max("weights")).cast("int")).alias("size"),
            is_bold(F.col("dominant.font")).alias("bold"), is_italic(F.col("dominant.font")).alias("italic"), F.length("text").alias("chars"),
            "x0", "top", "x1", "bottom", ((F.col("x0") + F.col("x1")) / 2).alias("x_center"), F.array_distinct(F.transform("runs", lambda r: r["font"])).alias("fonts"), "runs",
        )
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy(*PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))


def centered(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """The lines whose centre is within 6 % of the page's; never where the width or the right edge is missing."""
    near = (F.col("width") != 0) & (F.col("x1") != 0) & (F.abs(F.col("x_center") - F.col("width") / 2) < F.col("width") * 0.06)
    return lines_.join(distinct_pages(pages), list(PAGE), "left").select(*LINE, F.coalesce(near, F.lit(False)).alias("centered"))


def page_facts(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """Characters of each page's lines, and whether it looks scanned (fewer than 40)."""
    chars = lines_.groupBy(*PAGE).agg(F.sum("chars").alias("chars"))
    return distinct_pages(pages).join(chars, list(PAGE), "left").select(*PAGE, F.coalesce("chars", F.lit(0)).alias("chars"), (F.coalesce("chars", F.lit(0)) < SCANNED_CHARS).alias("scanned"))


def document_facts(page_facts_: DataFrame) -> DataFrame:
    """pages, scanned_pages, born_digital (fewer than half of the pages look scanned)."""
    g = page_facts_.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("scanned").alias("scanned_pages"))
    return g.withColumn("born_digital", F.col("scanned_pages") / F.col("pages") < 0.5)


def size_histogram(lines_: DataFrame) -> DataFrame:
    """Characters by line size; `first` is where the size first stands in reading order."""
    return lines_.groupBy("doc_id", "size").agg(F.sum("chars").alias("chars"), F.min(F.struct("page_no", "line_no")).alias("first"))


def body_size(histogram: DataFrame) -> DataFrame:
    """The size of most characters, ties to the first in reading order."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first"))
    return histogram.withColumn("rank", rank).where("rank = 1").select("doc_id", F.col("size").alias("body"))


def top_sizes(histogram: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "first"))
    return histogram.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "size", "chars")


def size_tiers(histogram: DataFrame, body: DataFrame) -> DataFrame:
    """tiers: heading sizes, largest first, sizes within 0.6 of the last kept one left out, three at most."""
    big = histogram.join(body, "doc_id").where((F.col("size") >= F.col("body") * HEADING_RATIO) & (F.col("chars") >= 8))
    kept = F.aggregate(F.sort_array(F.collect_list("size"), False), F.array().cast("array<double>"), lambda out, s: F.when((F.size(out) > 0) & (F.abs(F.element_at(out, -1) - s) <= 0.6), out).otherwise(F.concat(out, F.array(s))))
    return big.groupBy("doc_id").agg(F.slice(kept, 1, 3).alias("tiers"))


def heading_level(size: Column, tiers: Column) -> Column:
    """The tier's rank, at most 3; 3 for a size that is no tier."""
    at = F.array_position(F.transform(tiers, lambda t: F.abs(size - t) < 0.05), True)
    return F.coalesce(F.when(at > 0, at.cast("int")), F.lit(3))


def running_heads(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, text of the short lines that come back on enough pages (2, or 3 in books of nine pages and more)."""
    n = distinct_pages(pages).groupBy("doc_id").agg(F.count("*").alias("pages"))
    seen = lines_.select("doc_id", "page_no", T.strip(F.col("text")).alias("text")).where(F.length("text").between(1, RUNNING_CHARS)).distinct().groupBy("doc_id", "text").agg(F.count("*").alias("on_pages"))
    least = F.greatest(F.lit(2), F.least(F.lit(RUNNING_PAGES), F.floor(F.greatest(F.lit(1), F.coalesce("pages", F.lit(1))) / 3)))
    return seen.where("on_pages >= 2").join(n, "doc_id", "left").where((F.col("on_pages") >= least) & (T.is_folio(F.col("text")) | (F.length("text") > 3))).select("doc_id", "text", "on_pages")


def page_leading(lines_: DataFrame) -> DataFrame:
    """median_gap: the upper median of the gaps between neighbouring lines of a page, those over 1.25 times the larger size left out."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    gap = F.greatest(F.lit(0.0), F.lead("top").over(order) - F.col("bottom"))
    gaps = lines_.select(*PAGE, "size", F.lead("size").over(order).alias("next"), F.when(F.lead("top").over(order).isNotNull(), gap).alias("gap"))
    plain = gaps.where((F.col("gap").isNotNull()) & (F.col("gap") <= F.greatest("size", "next") * 1.25))
    return plain.groupBy(*PAGE).agg(F.sort_array(F.collect_list("gap")).alias("g")).select(*PAGE, F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1).alias("median_gap"))


def page_right_edge(lines_: DataFrame, body: DataFrame) -> DataFrame:
    """right_edge: the upper quartile, by index, of the right ends of a page's lines of about body size."""
    near = F.abs(F.col("size") - F.col("body")) <= F.greatest(F.lit(0.6), F.col("body") * 0.08)
    edges = lines_.join(body, "doc_id").where((F.col("x1") > F.col("x0")) & near)
    at = F.least(F.size("e"), F.floor(F.size("e") * 0.75).cast("int") + 1)
    return edges.groupBy(*PAGE).agg(F.sort_array(F.collect_list("x1")).alias("e")).select(*PAGE, F.element_at("e", at).alias("right_edge"))


def classified(lines_: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with body, tiers, median_gap, right_edge and class: blank, running, folio, note, heading or body.

    The lines are written once to shared storage: six figures of theirs are computed, each in a pass of its own over few columns.
    """
    lines_ = settled(lines_)
    histogram = size_histogram(lines_)
    body = body_size(histogram)
    heads = running_heads(lines_, pages).select("doc_id", F.col("text").alias("stripped"), F.lit(True).alias("running"))
    # what is known of documents and of pages comes together first, so that the lines meet each once
    documents = body.join(size_tiers(histogram, body), "doc_id", "left")
    parts = [distinct_pages(pages).select(*PAGE, "height"), page_leading(lines_), page_right_edge(lines_, body)]
    by_page = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy(*PAGE).agg(*(F.max(c).alias(c) for c in ("height", "median_gap", "right_edge")))
    facts = (
        lines_.withColumn("stripped", T.strip(F.col("text")))
        .join(documents, "doc_id", "left")
        .join(by_page, list(PAGE), "left")
        .join(heads, ["doc_id", "stripped"], "left")
        .withColumns({"height": F.coalesce("height", F.lit(0.0)), "tiers": F.coalesce("tiers", F.array().cast("array<double>")), "median_gap": F.coalesce("median_gap", F.lit(0.0)), "right_edge": F.coalesce("right_edge", F.lit(0.0))})
    )
    stripped, size = F.col("stripped"), F.col("size")
    large = size >= F.col("body") * HEADING_RATIO
    heading = (F.col("chars") <= 200) & (large | (~T.is_numbering(stripped) & T.has_heading_form(stripped)))
    kind = (
        F.when(stripped == "", "blank")
        .when(F.col("running"), "running")
        .when(T.is_folio(stripped) & (F.col("top") > F.col("height") * FOLIO_REGION), "folio")
        .when((size <= F.col("body") * NOTE_RATIO) & (F.col("top") >= F.col("height") * NOTE_REGION), "note")
        .when(heading, "heading")
        .otherwise("body")
    )
    level = F.when(large, heading_level(size, F.col("tiers"))).otherwise(F.lit(3))
    return facts.withColumn("class", kind).withColumn("level", F.when(F.col("class") == "heading", level).otherwise(F.lit(0))).drop("running")
