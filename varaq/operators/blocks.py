"""Blocks (headings, paragraphs, notes) from classified lines: gaps and islands over one ordered window per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import classified, is_bold, is_italic, lines

MOST_EM = 3.0


def indent_em(x1: Column, right_edge: Column, body: Column) -> Column:
    """How far the right end lies inside the page's right edge, in em; 0 under half an em or 4 points."""
    points = F.greatest(F.lit(0.0), right_edge - x1)
    void = (right_edge == 0) | (body == 0) | body.isNull() | (x1 == 0) | (points < F.greatest(F.lit(4.0), body * 0.5))
    return F.when(void, 0.0).otherwise(F.least(F.lit(MOST_EM), F.round(points / body, 2)))


def space_em(gap: Column, median_gap: Column, body: Column) -> Column:
    """The gap beyond the page's leading, in em; 0 under a fifth of an em or 2 points, or without a line before."""
    extra = F.greatest(F.lit(0.0), gap - median_gap)
    void = gap.isNull() | (body == 0) | body.isNull() | (extra < F.greatest(F.lit(2.0), body * 0.2))
    return F.when(void, 0.0).otherwise(F.least(F.lit(MOST_EM), F.round(extra / body, 2)))


def assigned(classified_: DataFrame, keep_notes: bool = True) -> DataFrame:
    """The lines that stand in blocks, with block_no (from 0), kind, indent and space.

    Running heads, folios and blank lines are passed over without closing a paragraph; headings stand alone; a
    paragraph may go on to the next page; a dropped note closes it. Paragraphs open at a wide gap or a new indent.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    rows = classified_.where("class in ('note', 'heading', 'body')")
    last = {c: F.lag(c).over(order) for c in ("class", "page_no", "bottom", "x1")}
    live = (last["class"] == "body") | ((last["class"] == "note") & F.lit(keep_notes))
    rows = rows.withColumns({"p_class": F.when(live, last["class"]), "p_page": last["page_no"], "p_bottom": F.when(live, last["bottom"]), "p_x1": F.when(live, last["x1"])})
    gap = F.when(F.col("p_class").isNotNull(), F.greatest(F.lit(0.0), F.col("top") - F.col("p_bottom")))
    rows = rows.withColumns({
        "gap": gap,
        "indent": indent_em(F.col("x1"), F.col("right_edge"), F.col("body")),
        "p_indent": F.when(F.col("p_class").isNotNull(), indent_em(F.col("p_x1"), F.col("right_edge"), F.col("body"))).otherwise(F.lit(0.0)),
    }).withColumn("space", space_em(F.col("gap"), F.col("median_gap"), F.col("body")))
    other = lambda c: F.coalesce(F.col("p_class") != c, F.lit(True))
    opens = (
        F.when(F.col("class") == "heading", True)
        .when(F.col("class") == "note", other("note") | (F.col("p_page") != F.col("page_no")))
        .otherwise(other("body") | (F.col("gap") > F.greatest(F.lit(2.0), F.col("median_gap") * 1.6)) | ((F.col("indent") > 0) & (F.col("p_indent") == 0)))
    )
    if not keep_notes:
        rows = rows.withColumn("opens", opens & (F.col("class") != "note"))
    else:
        rows = rows.withColumn("opens", opens)
    numbered = rows.withColumn("block_no", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    kind = F.when(F.col("class") == "heading", F.concat(F.lit("h"), F.col("level"))).when(F.col("class") == "note", "note").otherwise("p")
    return numbered.where(F.lit(keep_notes) | (F.col("class") != "note")).withColumn("kind", kind)


def blocks(classified_: DataFrame, keep_notes: bool = True) -> DataFrame:
    """doc_id, block_no, kind, level, page_no (of the first line), text, first_line_indent_em, space_before_em (paragraphs only), runs."""
    spans = F.transform(F.filter("runs", lambda r: r["text"] != ""), lambda r: F.struct(r["text"].alias("text"), r["font"].alias("font")))
    line = F.struct("page_no", "line_no", spans.alias("runs"), "kind", "level", "indent", "space")
    g = assigned(classified_, keep_notes).groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(line)).alias("lines")).withColumn("first", F.element_at("lines", 1))
    gap = F.array(F.struct(F.lit(" ").alias("text"), F.lit("").alias("font")))
    joined = F.aggregate("lines", F.array().cast("array<struct<text:string,font:string>>"), lambda out, l: F.when(F.size(out) == 0, l["runs"]).when(F.size(l["runs"]) == 0, out).otherwise(F.concat(out, gap, l["runs"])))
    paragraph = F.col("first.kind") == "p"
    return g.withColumn("runs", joined).select(
        "doc_id", F.col("block_no").cast("int").alias("block_no"), "first.kind", "first.level", "first.page_no", T.squeeze(F.array_join(F.transform("runs", lambda r: r["text"]), "")).alias("text"),
        F.when(paragraph, F.col("first.indent")).alias("first_line_indent_em"), F.when(paragraph, F.col("first.space")).alias("space_before_em"), "runs",
    )


def style_runs(blocks_: DataFrame) -> DataFrame:
    """blocks with styled: array of (text, bold, italic), neighbouring spans of one style as one."""
    styled = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), is_bold(r["font"]).alias("bold"), is_italic(r["font"]).alias("italic")))
    start = F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>")

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.concat(last["text"], r["text"]).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"))))
        return F.when((F.size(out) > 0) & (last["bold"] == r["bold"]) & (last["italic"] == r["italic"]), grown).otherwise(F.concat(out, F.array(r)))

    return blocks_.withColumn("styled", F.aggregate(styled, start, add))


def build(spans: DataFrame, pages: DataFrame, keep_notes: bool = True) -> DataFrame:
    return blocks(classified(lines(spans), pages), keep_notes)


def block_counts(blocks_: DataFrame) -> DataFrame:
    return blocks_.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def run_stats(classified_: DataFrame, keep_notes: bool = True) -> DataFrame:
    """doc_id, dropped_running, dropped_folio, dropped_notes (none where notes are kept), blocks, and the blocks of each kind."""
    n = lambda c: F.count_if(F.col("class") == c)
    dropped = classified_.groupBy("doc_id").agg(n("running").alias("dropped_running"), n("folio").alias("dropped_folio"), (F.lit(0).cast("bigint") if keep_notes else n("note")).alias("dropped_notes"))
    firsts = assigned(classified_, keep_notes).groupBy("doc_id", "block_no").agg(F.min("kind").alias("kind"))
    kinds = firsts.groupBy("doc_id").agg(F.count("*").alias("blocks"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("h1", "h2", "h3", "p", "note")))
    return dropped.join(kinds, "doc_id", "left").na.fill(0, ["blocks", "h1", "h2", "h3", "p", "note"])
