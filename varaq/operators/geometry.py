"""Page geometry below the line: segments with character ranges, bands of one baseline, gaps that stand for spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import PAGE, distinct_pages, distinct_spans

# Points, a share of the size, and the punctuation and marks beside which no space is missing.
Y_TOLERANCE, GAP_FLOOR, GAP_RATIO = 4.0, 2.5, 0.20
TIGHT = "[«»()\\[\\]{}.,،؛؟!:;…ً-ٰٕ]"


def segments(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments of a page from its spans, with running character offsets and boxes that count from the bottom."""
    order = Window.partitionBy(*PAGE).orderBy("line_no", "span_no")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = distinct_spans(spans).where("text <> ''").join(distinct_pages(pages).select(*PAGE, "height"), list(PAGE))
    return rows.select(*PAGE, (F.row_number().over(order) - 1).alias("seg_no"), before.cast("int").alias("loc"), F.length("text").alias("len"), "text", "font", "size", "x0", "x1", (F.col("height") - F.col("bottom")).alias("y0"), (F.col("height") - F.col("top")).alias("y1"))


def line_segments(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """The same with one segment a line, whose characters may differ in style: runs is its array of (text, size, font) in order."""
    rows = distinct_spans(spans).where("text <> ''").groupBy(*PAGE, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("span_no", "text", "size", "font"))).alias("runs"), *(F.min(c).alias(c) for c in ("x0", "top")), *(F.max(c).alias(c) for c in ("x1", "bottom")))
    rows = rows.join(distinct_pages(pages).select(*PAGE, "height"), list(PAGE)).withColumn("text", F.array_join(F.transform("runs", lambda r: r["text"]), ""))
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["size"].alias("size"), F.coalesce(r["font"], F.lit("")).alias("font")))
    return rows.select(*PAGE, (F.row_number().over(order) - 1).alias("seg_no"), before.cast("int").alias("loc"), F.length("text").alias("len"), "text", runs.alias("runs"), "x0", "x1", (F.col("height") - F.col("bottom")).alias("y0"), (F.col("height") - F.col("top")).alias("y1"))


def without_contained(segments_: DataFrame) -> DataFrame:
    """Segments whose character range lies in no longer one, nor in an equal one that comes earlier.

    Ranges by start, longest first: a range lies in an earlier one exactly if it ends no later than the farthest end so
    far, so one running maximum per page does what a self-join would.
    """
    end = F.col("loc") + F.col("len")
    order = Window.partitionBy(*PAGE).orderBy("loc", F.desc("len"), "seg_no")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return segments_.withColumn("reach", reach).where(F.col("reach").isNull() | (end > F.col("reach"))).drop("reach")


def bands(segments_: DataFrame) -> DataFrame:
    """segments with band (from 0, from the top): a segment more than 4 points below its band's first one opens the next.

    The band's first segment is the anchor, so this is a fold over the page's segments, not a comparison of neighbours.
    """
    page = segments_.groupBy(*PAGE).agg(F.array_sort(F.collect_set(-F.col("y1"))).alias("downs"))
    none = F.array().cast("array<double>")
    # the fold goes over the different heights of a page and keeps one number a band; a segment's band is how many of them lie above it
    opens = lambda acc, d: (F.size(acc) == 0) | (d - F.element_at(acc, -1) > Y_TOLERANCE)
    anchors = F.aggregate("downs", none, lambda acc, d: F.when(opens(acc, d), F.concat(acc, F.array(d))).otherwise(acc))
    found = page.select(*PAGE, anchors.alias("anchors"))
    above = F.size(F.filter("anchors", lambda a: a <= -F.col("y1")))
    return segments_.join(found, list(PAGE)).withColumn("band", above - 1).drop("anchors")


def band_boxes(banded: DataFrame, pages: DataFrame) -> DataFrame:
    """The union of a band's boxes, counted from the top."""
    box = banded.groupBy(*PAGE, "band").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return box.join(distinct_pages(pages).select(*PAGE, "height"), list(PAGE)).select(*PAGE, "band", "x0", (F.col("height") - F.col("y1")).alias("top"), "x1", (F.col("height") - F.col("y0")).alias("bottom"))


def interval_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The distance between two intervals, 0 where they overlap."""
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def unbroken(runs: Column) -> Column:
    """runs with a space for each line feed between two characters of the segment that aren't white space, in the style of the
    character before; other line feeds go."""
    text = lambda i: F.coalesce(F.get(runs, i)["text"], F.lit(""))
    # a line feed that a run starts with is the run's before: it would take its style
    own = lambda r, i: F.when(i > 0, F.regexp_replace(r["text"], "^\n+", "")).otherwise(r["text"])
    moved = F.transform(runs, lambda r, i: F.struct(F.concat(own(r, i), F.regexp_extract(text(i + 1), "^(\n*)", 1)).alias("text"), r["size"].alias("size"), r["font"].alias("font")))
    moved = F.filter(moved, lambda r: r["text"] != "")

    def joined(r: Column, i: Column, all_: Column) -> Column:
        edge = lambda c, side: F.translate(side(F.coalesce(c["text"], F.lit("")), F.lit(1)), "\n", " ")
        before, after = edge(F.get(all_, i - 1), F.right), edge(F.get(all_, i + 1), F.left)
        whole = F.regexp_replace(F.regexp_replace(F.concat(before, r["text"], after), "(?U)(?<=\\S)\n(?=\\S)", " "), "\n", "")
        inside = F.substring(whole, F.length(before) + 1, F.length(whole) - F.length(before) - F.length(after))
        return F.struct(inside.alias("text"), r["size"].alias("size"), r["font"].alias("font"))

    once = F.when(F.exists(runs, lambda r: F.contains(r["text"], F.lit("\n"))), F.transform(moved, lambda r, i: joined(r, i, moved))).otherwise(runs)
    return F.filter(once, lambda r: r["text"] != "")


def merged(runs: Column) -> Column:
    """runs with neighbours of equal size and font as one."""
    start = F.array().cast("array<struct<text:string,size:double,font:string>>")

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        same = (F.size(out) > 0) & last["size"].eqNullSafe(r["size"]) & last["font"].eqNullSafe(r["font"])
        longer = F.struct(F.concat(last["text"], r["text"]).alias("text"), last["size"].alias("size"), last["font"].alias("font"))
        return F.when(same, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(r)))

    return F.when(F.size(runs) > 1, F.aggregate(runs, start, add)).otherwise(runs)


def band_spans(banded: DataFrame) -> DataFrame:
    """doc_id, page_no, band, span_no, text, size, font: bands as styled spans.

    Segments in character order; each gives a span for every run of characters of equal size and font (its `runs`, or all of
    it), with a space before it if it stands apart from the one before (by more than 2.5 points and a fifth of the size)
    unless white space, punctuation or a mark is at either edge; a line feed between two characters counts as a space.
    """
    style = F.struct("text", F.col("size").cast("double").alias("size"), F.coalesce("font", F.lit("")).alias("font")) if "runs" not in banded.columns else None
    runs = F.array(style) if style is not None else F.transform("runs", lambda r: F.struct(r["text"].alias("text"), r["size"].cast("double").alias("size"), F.coalesce(r["font"], F.lit("")).alias("font")))
    rows = banded.select(*PAGE, "band", "loc", "seg_no", "x0", "x1", runs.alias("raw")).withColumn("clean", unbroken(F.col("raw"))).withColumn("spans", merged(F.col("clean"))).where("size(spans) > 0")
    order = Window.partitionBy(*PAGE, "band").orderBy("loc", "seg_no")
    last = F.element_at("spans", -1)
    prev = {k: F.lag(v).over(order) for k, v in {"text": last["text"], "size": last["size"], "x0": F.col("x0"), "x1": F.col("x1")}.items()}
    apart = interval_gap(prev["x0"], prev["x1"], F.col("x0"), F.col("x1")) > F.greatest(F.lit(GAP_FLOOR), prev["size"] * GAP_RATIO)
    edge = lambda c: c.rlike(f"(?U)^(?:\\s|{TIGHT})$")
    space = F.coalesce(apart & ~edge(F.right(prev["text"], F.lit(1))) & ~edge(F.left(F.get("spans", 0)["text"], F.lit(1))), F.lit(False))
    rows = rows.withColumn("space", space).withColumn("p_size", prev["size"])
    blank = F.array(F.struct(F.lit(" ").alias("text"), F.col("p_size").alias("size"), F.lit("").alias("font")))
    pieces = rows.select(*PAGE, "band", "loc", "seg_no", F.posexplode(F.when(F.col("space"), F.concat(blank, F.col("spans"))).otherwise(F.col("spans"))).alias("k", "p"))
    return pieces.select(*PAGE, "band", (F.row_number().over(Window.partitionBy(*PAGE, "band").orderBy("loc", "seg_no", "k")) - 1).cast("int").alias("span_no"), "p.text", "p.size", "p.font")


def filled_fonts(characters: DataFrame, order: str = "at") -> DataFrame:
    """Characters without a font take the last known one of their page."""
    w = Window.partitionBy(*PAGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return characters.withColumn("font", F.last("font", ignorenulls=True).over(w))


def newline_lines(texts: DataFrame) -> DataFrame:
    """The fallback without geometry: doc_id, line_no, text of the lines of each text that aren't blank."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")).where(~F.col("text").rlike("(?U)^\\s*$"))


def newline_spans(texts: DataFrame) -> DataFrame:
    """The same with styles: texts has doc_id, page_no and runs, (text, size, font) of a page in order, line feeds in them; gives
    doc_id, page_no, line_no, span_no, text, size, font, a span for every run of characters of equal size and font of a line."""
    size, font = F.coalesce(F.col("r.size").cast("double"), F.lit(0.0)), F.coalesce(F.col("r.font"), F.lit(""))
    cut = texts.select(*PAGE, F.posexplode("runs").alias("n", "r")).select(*PAGE, "n", size.alias("size"), font.alias("font"), F.posexplode(F.split("r.text", "\n", -1)).alias("k", "text"))
    order = Window.partitionBy(*PAGE).orderBy("n", "k")
    lines_ = cut.withColumn("line_no", F.sum((F.col("k") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("text <> ''")
    runs = F.transform(F.array_sort(F.collect_list(F.struct("n", "text", "size", "font"))), lambda r: F.struct(r["text"].alias("text"), r["size"].alias("size"), r["font"].alias("font")))
    whole = lines_.groupBy(*PAGE, "line_no").agg(runs.alias("runs")).where(~F.array_join(F.transform("runs", lambda r: r["text"]), "").rlike("(?U)^\\s*$"))
    return whole.select(*PAGE, F.col("line_no").cast("int").alias("line_no"), F.posexplode(merged(F.col("runs"))).alias("span_no", "p")).select(*PAGE, "line_no", "span_no", "p.text", "p.size", "p.font")


def baseline_ids(lines_: DataFrame) -> DataFrame:
    """block_id: one number per page and top (to a tenth), in the order in which they first appear."""
    first = lines_.withColumn("y", F.round("top", 1)).groupBy(*PAGE, "y").agg(F.min("line_no").alias("first"))
    ids = first.withColumn("block_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_no", "first")) - 1)
    return lines_.withColumn("y", F.round("top", 1)).join(ids, [*PAGE, "y"]).select(*PAGE, "line_no", "block_id")
