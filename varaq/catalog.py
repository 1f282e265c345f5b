"""The queries of the core operators: each a function of (spark, directory of tables) over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import blocks as B
from .operators import fonts as FT
from .operators import geometry as G
from .operators import layout as L
from .operators import outline as O
from .operators import package as PK
from .operators import render as R
from .operators import report as RP
from .operators.layout import distinct_spans
from .oracles import ORACLES
from .plans import pipeline as PL
from .session import read_table
from .sources import readers as RD
from .sources import sfnt as SF

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("doc_id", "page_no", "line_no", "span_no")
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _on_spans(name: str, **columns: Callable[[Column], Column]) -> None:
    """A query that shows Column functions on the text of every span."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = F.col("text")
        return read_table(spark, d, "spans").where("text is not null").select(*KEYS, *(f(t).alias(c) for c, f in columns.items())).distinct()

    _QUERIES[name] = run


_swapped = lambda t: F.translate(t, "()[]", ")(][")  # noqa: E731  brackets the wrong way round, for the repair to find

_on_spans("n01_strip_bidi", out=T.strip_bidi)
_on_spans("n02_presentation_forms", out=T.presentation_forms)
_on_spans("n03_fold_letters", out=T.fold_letters)
_on_spans("n04_ascii_digits", out=T.ascii_to_persian_digits)
_on_spans("n05_drop_tatweel", out=T.drop_tatweel)
_on_spans("n07_unmirror", out=T.unmirror)
_on_spans("n08_brackets", out=lambda t: T.mirrored_brackets(_swapped(t)), repaired=lambda t: T.count_mirrored_brackets(_swapped(t)).cast("int"))
_on_spans("n09_detached_marks", out=T.detached_marks)
_on_spans("n10_zwnj", out=T.repair_zwnj)
_on_spans("n11_prefixes", out=T.split_prefixes)
_on_spans("n13_collapse_lines", out=T.collapse_lines)
_on_spans("n14_collapse_fragment", out=T.collapse_fragment)
_on_spans("n15_typography", out=T.typography)
_on_spans("n17_has_arabic_script", out=T.has_arabic_script)
_on_spans("n19_escape", out=T.escape)
_on_spans("n20_clean", out=T.clean)
_on_spans("x01_private_use", out=lambda t: T.has_private_use(F.translate(t, "zq", "\ue001\U00100001")), points=lambda t: F.array_join(T.private_use(F.translate(t, "zq", "\ue001\U00100001")).cast("array<string>"), ","))
_on_spans("pred_numbering", out=T.is_numbering)
_on_spans("pred_folio", out=T.is_folio)
_on_spans("pred_heading_form", out=T.has_heading_form)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return L.lines(read_table(spark, d, "spans"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages_geom")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return L.classified(_lines(spark, d), _pages(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return O.plain_blocks(read_table(spark, d, "blocks"))


def _outline(spark: SparkSession, d: str) -> DataFrame:
    return O.anchors(O.chapters(_stored(spark, d)))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return G.segments(read_table(spark, d, "spans"), _pages(spark, d))


@_query
def n06_looks_mirrored(spark, d):
    """Blocks as they are, and read backwards."""
    b = read_table(spark, d, "blocks").where("text is not null").select("block_id", "text").distinct()
    return b.select("block_id", T.looks_mirrored(F.col("text")).alias("mirrored"), T.looks_mirrored(F.reverse("text")).alias("backwards"))


@_query
def n16_normalize(spark, d):
    s = read_table(spark, d, "spans").where("text is not null").select(*KEYS, "text").distinct()
    return T.normalized(s, "text", T.NormalizeOptions(whole_lines=False))


@_query
def n18_repairs(spark, d):
    return PL.repairs(read_table(spark, d, "spans"))


@_query
def n21_title_author(spark, d):
    b = read_table(spark, d, "books").select("doc_id", "path", T.title_author(F.col("title"), F.col("author"), F.col("path")).alias("t"), T.title_author(F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat_ws("، ", "author", "title", F.lit("چاپ ۲.pdf"))).alias("u")).distinct()
    return b.select("doc_id", "path", "t.title", "t.author", F.col("u.title").alias("file_title"), F.col("u.author").alias("file_author"))


@_query
def n22_versions(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), F.col("p_size") % 3, F.lit("."), F.col("p_size"), F.lit("."), F.col("p_partkey") % 7).alias("version"))
    return p.select("p_partkey", "version", T.is_newer(F.col("version"), F.lit("1.25")).alias("newer"))


@_query
def x03_guard(spark, d):
    s = read_table(spark, d, "spans").withColumn("text", F.translate("text", "zq", "\ue001\U00100001"))
    return RD.guarded(s)[1]


@_query
def x04_fill_fonts(spark, d):
    s = read_table(spark, d, "spans").select("doc_id", "page_no", "line_no", "span_no", "font").distinct().withColumn("at", F.struct("line_no", "span_no"))
    return G.filled_fonts(s).drop("at")


@_query
def x05_without_contained(spark, d):
    """Segments and, for the operator to drop, the inner part of every second one."""
    s = _segments(spark, d).select("doc_id", "page_no", "seg_no", "loc", "len")
    inner = s.where("seg_no % 2 = 0 and len > 2").select("doc_id", "page_no", (F.col("seg_no") + 100000).alias("seg_no"), (F.col("loc") + 1).alias("loc"), (F.col("len") - 2).alias("len"))
    return G.without_contained(s.unionByName(inner))


@_query
def x06_bands(spark, d):
    return G.bands(_segments(spark, d)).select("doc_id", "page_no", "seg_no", "band")


@_query
def x07_band_boxes(spark, d):
    return G.band_boxes(G.bands(_segments(spark, d)), _pages(spark, d))


@_query
def x08_interval_gaps(spark, d):
    s = read_table(spark, d, "spans").select(*KEYS, "x0", "x1").distinct()
    return s.select(*KEYS, G.interval_gap(F.lit(200.0), F.lit(300.0), F.col("x0"), F.col("x1")).alias("gap"))


@_query
def x09_band_spans(spark, d):
    """Lines of several styles, by band."""
    return G.band_spans(G.bands(G.line_segments(read_table(spark, d, "spans"), _pages(spark, d))))


@_query
def x10_newline_lines(spark, d):
    return G.newline_lines(read_table(spark, d, "documents").where("text is not null").select("doc_id", "text"))


@_query
def x10_newline_spans(spark, d):
    """Pages as one text, each line's spans and a line feed, cut again."""
    s = distinct_spans(read_table(spark, d, "spans"))
    ends = s.groupBy("doc_id", "page_no", "line_no").agg(F.max("span_no").alias("span_no")).withColumns({"text": F.lit("\n"), "size": F.lit(0.0), "font": F.lit("")})
    rows = s.select("doc_id", "page_no", "line_no", "span_no", F.lit(0).alias("k"), "text", "size", "font").unionByName(ends.withColumn("k", F.lit(1)))
    return G.newline_spans(rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "k", "text", "size", "font"))).alias("runs")))


@_query
def x12_baseline_ids(spark, d):
    return G.baseline_ids(_lines(spark, d))


@_query
def x13_lines(spark, d):
    """Size, dominant style, characters, box and fonts of every line."""
    return _lines(spark, d).drop("runs").withColumn("fonts", F.array_join(F.transform("fonts", lambda f: F.coalesce(f, F.lit("-"))), "|"))


@_query
def x16_centered(spark, d):
    return L.centered(_lines(spark, d), _pages(spark, d))


@_query
def x17_pages(spark, d):
    return L.page_facts(_lines(spark, d), _pages(spark, d))


@_query
def x17_documents(spark, d):
    return L.document_facts(L.page_facts(_lines(spark, d), _pages(spark, d)))


@_query
def x18_size_histogram(spark, d):
    return L.size_histogram(_lines(spark, d)).drop("first")


@_query
def x19_body_size(spark, d):
    return L.body_size(L.size_histogram(_lines(spark, d)))


@_query
def x20_top_sizes(spark, d):
    return L.top_sizes(L.size_histogram(_lines(spark, d)))


@_query
def a01_size_tiers(spark, d):
    h = L.size_histogram(_lines(spark, d))
    return L.size_tiers(h, L.body_size(h)).withColumn("tiers", F.array_join(F.col("tiers").cast("array<string>"), ","))


@_query
def a03_running_heads(spark, d):
    return L.running_heads(_lines(spark, d), _pages(spark, d))


@_query
def a04_page_leading(spark, d):
    return L.page_leading(_lines(spark, d))


@_query
def a05_right_edge(spark, d):
    n = _lines(spark, d)
    return L.page_right_edge(n, L.body_size(L.size_histogram(n)))


@_query
def line_classes(spark, d):
    """Running heads, folios, notes, headings (with their level) and body lines."""
    return _classified(spark, d).select(*L.LINE, "class", "level")


@_query
def a07_run_stats(spark, d):
    return B.run_stats(_classified(spark, d))


@_query
def a07_without_notes(spark, d):
    return B.run_stats(_classified(spark, d), keep_notes=False)


@_query
def w05_block_numbers(spark, d):
    return B.assigned(_classified(spark, d)).select(*L.LINE, F.col("block_no").cast("int").alias("block_no"), "kind", "indent", "space")


@_query
def w05_without_notes(spark, d):
    return B.assigned(_classified(spark, d), keep_notes=False).select(*L.LINE, F.col("block_no").cast("int").alias("block_no"), "kind")


@_query
def blocks(spark, d):
    """Headings, paragraphs and notes of every book from its raw spans."""
    return B.build(read_table(spark, d, "spans"), _pages(spark, d)).drop("runs")


@_query
def blocks_normalized(spark, d):
    """The same from repaired spans: the plan that books are made by."""
    return PL.built_blocks(read_table(spark, d, "spans"), _pages(spark, d)).drop("runs")


@_query
def w06_style_runs(spark, d):
    b = B.style_runs(B.build(read_table(spark, d, "spans"), _pages(spark, d)))
    return b.select("doc_id", "block_no", F.posexplode("styled").alias("run_no", "r")).select("doc_id", "block_no", "run_no", "r.*")


@_query
def a06_block_counts(spark, d):
    return B.block_counts(_stored(spark, d))


@_query
def a08_report(spark, d):
    spans = read_table(spark, d, "spans").withColumn("text", _swapped(F.col("text")))
    out = RP.conversion_report(read_table(spark, d, "books"), L.page_facts(_lines(spark, d), _pages(spark, d)), _stored(spark, d), PL.repairs(spans), "Nastaran", False, "both")
    return out.withColumns({"counts": F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), "warnings": F.array_join("warnings", "; ")})


@_query
def a08_routes(spark, d):
    return RP.routed(read_table(spark, d, "books").select("path").distinct(), "both")


@_query
def a09_font_families(spark, d):
    return FT.families(read_table(spark, d, "fonts"))


def _font_faces(spark: SparkSession, d: str) -> DataFrame:
    """Files made from the font table, as many Arabic characters in each as its coverage says, read by their bytes."""

    def files(batches):
        points = [c for a, b in SF.ARABIC_RANGES for c in range(a, b + 1)]
        for pdf in batches:
            made = []
            for family, licence, n in zip(pdf["family"], pdf["license_text"], pdf["coverage"]):
                records = ([(1, family)] if family else []) + ([(13, licence)] if licence else [])
                made.append(SF.written(points[:n] + [0x200C] * (n % 3 == 0), records, ("init", "fina") if n % 4 else ()))
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    table = read_table(spark, d, "fonts").where("coverage is not null").select("path", "family", "license_text", "coverage").distinct()
    return SF.font_faces(table.mapInPandas(files, "path string, content binary"))


@_query
def a10_font_faces(spark, d):
    return _font_faces(spark, d).select("path", "face_no", "family", "coverage", "probe", "core", "persian_only", "zwnj", "presentation_forms", "features", "license_text", "units")


@_query
def a11_font_table(spark, d):
    return SF.font_table(_font_faces(spark, d))


@_query
def a12_font_audit(spark, d):
    return SF.audited(_font_faces(spark, d)).select("path", "face_no", "verdict")


@_query
def pred_redistributable(spark, d):
    f = read_table(spark, d, "fonts").distinct()
    named = F.when(F.col("coverage") % 3 == 0, F.concat(F.coalesce("license_text", F.lit("")), F.lit(" (SIL Open Font License)"))).otherwise(F.col("license_text"))
    return f.select("path", FT.redistributable(named).alias("open"))


@_query
def font_pick(spark, d):
    names = read_table(spark, d, "spans").select(F.regexp_replace(F.coalesce("font", F.lit("")), "^[A-Z]{6}[+]|-.*$", "").alias("wanted")).distinct()
    return FT.pick(FT.families(read_table(spark, d, "fonts")), names)


@_query
def s12_face_files(spark, d):
    return FT.face_files(FT.families(read_table(spark, d, "fonts")))


@_query
def s06_probe(spark, d):
    return RD.probed(read_table(spark, d, "page_lines").select("doc_id", "page_no", "line_no", "text").distinct())


@_query
def pred_arabic_corpus(spark, d):
    """The 30 books with the largest share of Arabic script: a top-k report."""
    return RD.arabic_corpus(RD.probed(read_table(spark, d, "page_lines").select("doc_id", "page_no", "line_no", "text").distinct()))


@_query
def pred_new_files(spark, d):
    b = read_table(spark, d, "books")
    return RD.new_files(b.select(F.upper("path").alias("path")).union(b.select("path")), b.where("total_pages > 2").select("path"))


@_query
def c01_cut_levels(spark, d):
    return O.cut_levels(_stored(spark, d))


@_query
def c02_chapters(spark, d):
    return O.chapters(_stored(spark, d)).select("doc_id", "block_no", "cut", "chapter", "chapter_title")


@_query
def c03_anchors(spark, d):
    return _outline(spark, d)


@_query
def c04_nested(spark, d):
    return O.nested(_outline(spark, d)).select("doc_id", "entry_no", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth")


@_query
def c04_stored_outline(spark, d):
    """The stored outline nested again: its own parents should come out."""
    o = read_table(spark, d, "outline").select("doc_id", "entry_no", "level", "parent_no").distinct()
    return O.nested(o).select("doc_id", "entry_no", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("parent_no", F.lit(-1)).alias("parent_no"))


@_query
def c05_play_order(spark, d):
    return O.play_order(_outline(spark, d))


@_query
def c06_hrefs(spark, d):
    return _outline(spark, d).select("doc_id", "entry_no", O.chapter_href(F.col("chapter"), F.col("anchor")).alias("href"))


@_query
def r01_inline(spark, d):
    b = B.style_runs(B.build(read_table(spark, d, "spans"), _pages(spark, d)))
    return b.select("doc_id", "block_no", R.inline(F.col("styled")).alias("markup"))


@_query
def r02_block_markup(spark, d):
    c = O.chapters(_stored(spark, d))
    return R.rendered_blocks(c, O.anchors(c)).drop("chapter_title")


@_query
def r03_chapter_documents(spark, d):
    c = O.chapters(_stored(spark, d))
    return R.chapter_documents(R.rendered_blocks(c, O.anchors(c)))


@_query
def r04_contents(spark, d):
    return R.contents(O.nested(_outline(spark, d)))


@_query
def r07_title_pages(spark, d):
    t = PL.titles(read_table(spark, d, "books"))
    return t.select("doc_id", R.title_page(F.col("title"), F.col("author")).alias("page"))


@_query
def s08_packages(spark, d):
    """The members of every book's package, read back from its file."""
    return PK.unpacked(PL.books(_stored(spark, d), PL.titles(read_table(spark, d, "books"))))


@_query
def s11_preview(spark, d):
    c = O.chapters(_stored(spark, d))
    return R.preview(R.rendered_blocks(c, O.anchors(c)), PL.titles(read_table(spark, d, "books")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _QUERIES}
