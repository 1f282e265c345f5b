"""What a run did, per document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import document_facts


def conversion_report(books: DataFrame, page_facts: DataFrame, blocks: DataFrame, repairs: DataFrame | None = None, font: str | None = None, font_open: bool = True, output: str = "epub", requested: str | None = None) -> DataFrame:
    """doc_id, title, author, pages_read, pages_total, scanned_pages, blocks, headings, counts, warnings, primary_path.

    Books come once each, with their latest load. repairs: doc_id, brackets_repaired (true sums over the spans). primary_path is
    the file that the route makes, the second format before the first.
    """
    latest = books.groupBy("doc_id").agg(F.max_by(F.struct("path", "title", "author", "total_pages"), F.struct("loaded_at", "path", "title", "author")).alias("b"))
    named = latest.select("doc_id", "b.*").withColumn("ta", T.title_author(F.col("title"), F.col("author"), F.col("path")))
    kinds = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind").rlike("^h[1-3]$")).alias("headings"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("h1", "h2", "h3", "note", "p")))
    rows = named.join(document_facts(page_facts), "doc_id", "left").join(kinds, "doc_id", "left")
    fixes = repairs if repairs is not None else books.sparkSession.createDataFrame([], "doc_id long, brackets_repaired long")
    rows = rows.join(fixes, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    warnings = F.filter(F.array(
        F.when(n("scanned_pages") > 0, F.concat(F.col("scanned_pages"), F.lit(" pages have no text layer"))),
        F.lit(None if font else "no font for the script was found"),
        F.lit(None if font_open or not font else f"the licence of {font} is unknown"),
        F.when(n("brackets_repaired") > 0, F.concat(F.col("brackets_repaired"), F.lit(" brackets were repaired"))),
    ), lambda w: w.isNotNull())
    counts = F.map_from_arrays(F.array(*map(F.lit, ("h1", "h2", "h3", "note", "p"))), F.array(*(n(k).cast("bigint") for k in ("h1", "h2", "h3", "note", "p"))))
    epub, mobi = _route(output, requested)
    return rows.select("doc_id", "ta.title", "ta.author", n("pages").alias("pages_read"), n("total_pages").alias("pages_total"), n("scanned_pages").alias("scanned_pages"), n("blocks").alias("blocks"), n("headings").alias("headings"), counts.alias("counts"), warnings.alias("warnings"), F.coalesce(mobi, epub).alias("primary_path"))


OUTPUTS = ("epub", "mobi", "both")


def routed(paths: DataFrame, output: str, requested: str | None = None) -> DataFrame:
    """path with epub_path and mobi_path (null if not made): a `converted` folder beside the source unless a path is requested."""
    epub, mobi = _route(output, requested)
    return paths.select("path", epub.alias("epub_path"), mobi.alias("mobi_path"))


def _route(output: str, requested: str | None) -> tuple[F.Column, F.Column]:
    """The two paths of each `path`."""
    kind = output.strip().lower()
    if kind not in OUTPUTS:
        raise ValueError(f"unknown output format: {output}")
    folder = F.concat(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.lit("converted/"))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "(?<=.)\\.[^.]+$", "")
    beside = lambda suffix: F.concat(folder, stem, F.lit(suffix))
    none = F.lit(None).cast("string")
    base, suffix = re.fullmatch(r"(.*?[^/])(\.[^./]*)?", requested).groups() if requested else ("", None)
    wanted = {".epub": F.lit(requested if suffix and suffix.lower() != ".mobi" else f"{base}.epub"), ".mobi": F.lit(requested if suffix and suffix.lower() == ".mobi" else f"{base}.mobi")}
    path = lambda suffix: wanted[suffix] if requested else beside(suffix)
    return (none if kind == "mobi" else F.lit(requested) if requested and kind == "epub" else path(".epub")), (none if kind == "epub" else path(".mobi"))
