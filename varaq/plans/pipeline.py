"""From spans to books: the whole plan in one place."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import layout, outline, package, render
from ..sources.readers import first_pages, guarded


def repaired(spans: DataFrame, options: T.NormalizeOptions = T.NormalizeOptions()) -> DataFrame:
    """spans with repaired texts and the counts of repairs; a span is a fragment of a line, so a space at its ends stays."""
    return T.normalized(spans, "text", replace(options, whole_lines=False))


def repairs(spans: DataFrame, options: T.NormalizeOptions = T.NormalizeOptions()) -> DataFrame:
    """doc_id and the sums of what was repaired in its spans (each span once)."""
    rows = repaired(spans.where("text is not null").select("doc_id", "page_no", "line_no", "span_no", "text").distinct(), options)
    return rows.groupBy("doc_id").agg(*(F.sum(F.col(c).cast("int")).alias(c) for c in T.REPAIRS))


def built_blocks(spans: DataFrame, pages: DataFrame, keep_notes: bool = True, max_pages: int | None = None, options: T.NormalizeOptions | None = T.NormalizeOptions()) -> DataFrame:
    sound, _ = guarded(first_pages(spans, max_pages))
    return B.build(repaired(sound, options) if options else sound, first_pages(pages, max_pages), keep_notes)


def books(blocks: DataFrame, titles: DataFrame, options: render.RenderOptions = render.RenderOptions(), fonts: dict[str, tuple[str, bytes]] | None = None) -> DataFrame:
    """doc_id, epub, bytes from blocks (with runs or without), titles (doc_id, title, author) and the files of a font by face."""
    styled = B.style_runs(blocks) if "runs" in blocks.columns else blocks
    chaptered = outline.chapters(styled, options.chapter_break_at)
    heads = outline.anchors(chaptered)
    nested = outline.nested(heads)
    documents = render.chapter_documents(render.rendered_blocks(chaptered, heads, options), options)
    return package.packages(documents, nested, render.contents(nested), titles, options, fonts=fonts)


def titles(book_rows: DataFrame) -> DataFrame:
    """doc_id, title, author of each book's latest load, guessed from the file's name where the metadata has none."""
    latest = book_rows.groupBy("doc_id").agg(F.max_by(F.struct("path", "title", "author"), F.struct("loaded_at", "path", "title", "author")).alias("b"))
    return latest.select("doc_id", T.title_author(F.col("b.title"), F.col("b.author"), F.col("b.path")).alias("t")).select("doc_id", "t.*")
