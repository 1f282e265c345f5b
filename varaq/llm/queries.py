"""The pN_ queries: each a function of (spark, directory of tables) over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table as table
from . import garbled, language, leaks, lookalike, mixture, quality, repeated, sentences, split


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(table(spark, d, "blocks"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    return sentences.checks(table(spark, d, "blocks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.found(table(spark, d, "spans"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repaired(table(spark, d, "spans"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "blocks"), table(spark, d, "pages_geom"))


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.book_statistics(table(spark, d, "blocks"), table(spark, d, "pages_geom"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Those of the statistics that SQL can count as well."""
    return quality.book_statistics(table(spark, d, "blocks"), table(spark, d, "pages_geom")).select("doc_id", "chars", "page_chars", "pages", F.round("end_mark_share", 9).alias("end_mark_share"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.found(table(spark, d, "page_lines"), table(spark, d, "books"))


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated.frequent_sequences(table(spark, d, "page_lines"), table(spark, d, "books"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated.without_repeats(table(spark, d, "page_lines"), table(spark, d, "books")).distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(table(spark, d, "blocks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same by class: a row a block, with its class and its number of links."""
    return lookalike.classes(table(spark, d, "blocks"))


def p5_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unified(table(spark, d, "blocks").select("block_id", "text")).select("block_id", "form").distinct()


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    keys = ["doc_id", "page_no", "line_no", "span_no"]
    return lookalike.unified(table(spark, d, "spans").select(*keys, "text")).select(*keys, "form").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return split.found(table(spark, d, "blocks"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_chapters(table(spark, d, "blocks"))


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    return split.checks(table(spark, d, "blocks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_limited(spark: SparkSession, d: str) -> DataFrame:
    """Nine tenths of the tokens that there are: the exponent is bisected until every source stays within its cap."""
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), of_available=0.9)[1]


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Token shares exponentiated until they have the entropy of the target shares."""
    return mixture.tempered(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixture.checks(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.found(table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(table(spark, d, "documents"))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


#: Where plain SQL says the same as the operator. The others are tested against brute force, round trips or held-out accuracy.
_WHITE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"
_REPEATED = """
        owner AS (SELECT DISTINCT doc_id, source FROM books),
        size AS (SELECT source, count(*) AS books FROM owner GROUP BY source),
        lines AS (SELECT DISTINCT p.doc_id, page_no, line_no, source, regexp_replace(lower(text), '[^\\p{L}]+', '', 'g') AS key FROM page_lines p JOIN owner USING (doc_id)),
        often AS (SELECT source, key FROM lines JOIN size USING (source) WHERE key <> '' GROUP BY source, key, books
                  HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 5 >= books),
        again AS (SELECT DISTINCT doc_id, page_no, line_no FROM lines JOIN often USING (source, key))"""
ORACLES = {
    "p1_checks": f"""
        SELECT DISTINCT doc_id, block_no, (length(text) - length(regexp_replace(text, '^{_WHITE}', '')))::INTEGER AS first, length(regexp_replace(text, '{_WHITE}$', ''))::INTEGER AS last, true AS whole
        FROM blocks WHERE kind IN ('p', 'note') AND regexp_replace(text, '^{_WHITE}', '') <> ''""",
    "p3_totals": """
        WITH b AS (SELECT DISTINCT doc_id, block_id, text FROM blocks WHERE kind IN ('p', 'note') AND text IS NOT NULL),
        g AS (SELECT doc_id, sum(text_chars)::BIGINT AS page_chars, count(DISTINCT page_no) AS pages FROM (SELECT DISTINCT doc_id, page_no, text_chars FROM pages_geom) GROUP BY doc_id)
        SELECT b.doc_id, sum(length(text))::BIGINT AS chars, any_value(page_chars) AS page_chars, any_value(pages) AS pages,
          round(avg(regexp_matches(regexp_replace(text, '^\\s*([*†‡]|\\(\\p{Nd}+\\))\\s*', ''), '[.!?؟。！？…]["''”’»」』）)\\]]*\\s*$')::INTEGER), 9) AS end_mark_share FROM b LEFT JOIN g USING (doc_id) GROUP BY b.doc_id""",
    "p4_found": f"WITH {_REPEATED} SELECT * FROM again",
    "p4_cleaned": f"WITH {_REPEATED} SELECT DISTINCT * FROM page_lines ANTI JOIN again USING (doc_id, page_no, line_no)",
    "p6_checks": """
        SELECT doc_id, chapter_no, (sum(length(text)) + count(*) - 1)::BIGINT AS chapter_chars, true AS rebuilt, true AS within, true AS repeated
        FROM (SELECT DISTINCT doc_id, chapter_no, block_no, text FROM blocks WHERE text IS NOT NULL) GROUP BY doc_id, chapter_no HAVING sum(length(text)) + count(*) - 1 > 2000""",
    "p6_found": """
        SELECT doc_id, chapter_no FROM (SELECT DISTINCT doc_id, chapter_no, block_no, text FROM blocks WHERE text IS NOT NULL)
        GROUP BY doc_id, chapter_no HAVING sum(length(text)) + count(*) - 1 > 2000""",
    "p8_checks": """
        WITH posts AS (SELECT source, count(*) AS posts FROM (SELECT DISTINCT doc_id, source, text FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL AND text <> '') GROUP BY source)
        SELECT mix, source, coalesce(posts, 0) AS posts, true AS within_cap, true AS drawn_once, true AS within_budget, true AS budget_met, true AS exponent_found
        FROM (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) LEFT JOIN posts USING (source) CROSS JOIN (SELECT unnest(['targets', 'limited', 'tempered']) AS mix)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
