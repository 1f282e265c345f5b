"""Sources: span tables, page-limited documents with a guard, files on disk, corpus probes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .schemas import PAGES, SPANS

# Font files, the least size of a document, the pages that a probe reads, and Arabic script.
FONT_SUFFIXES, SMALLEST_FILE, PROBE_PAGES = ("ttf", "otf", "ttc"), 20_000, 4
ARABIC = "[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPANS).parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def first_pages(table: DataFrame, max_pages: int | None) -> DataFrame:
    """Pages below the limit; the limit comes before every figure of a document."""
    return table if max_pages is None else table.where(F.col("page_no") < max_pages)


def guarded(spans: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans of sound documents, quarantine): documents with private-use characters are kept apart, or fail the query if strict.

    quarantine: doc_id, page_no (the first such page), sample (its first eight code points as U+XXXX).
    """
    marked = spans.where(T.has_private_use(F.col("text")))
    points = T.private_use(F.concat_ws("", F.collect_list("text")))
    pages = marked.groupBy("doc_id", "page_no").agg(points.alias("points"))
    hexed = F.array_join(F.transform(F.slice("points", 1, 8), lambda p: F.concat(F.lit("U+"), F.lpad(F.hex(p.cast("bigint")), F.greatest(F.lit(4), F.length(F.hex(p.cast("bigint")))), F.lit("0")))), " ")
    quarantine = pages.withColumn("sample", hexed).groupBy("doc_id").agg(F.min(F.struct("page_no", "sample")).alias("m")).select("doc_id", "m.page_no", "m.sample")
    if strict:
        return spans.withColumn("text", F.when(T.has_private_use(F.col("text")), F.raise_error(F.concat(F.lit("private-use characters on page "), F.col("page_no") + 1))).otherwise(F.col("text"))), quarantine
    return spans.join(quarantine.select("doc_id"), "doc_id", "left_anti"), quarantine


def read_documents(spark: SparkSession, path: str, extract: Callable[[str, bytes], Iterable[tuple]], pattern: str = "*.pdf") -> DataFrame:
    """Spans from binary files by an extractor of the caller: (path, content) to rows of the span table. A file that fails gives
    one row with a null doc_id and the reason as its text, so that other files go on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        for pdf in batches:
            out: list[tuple] = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += list(extract(p, content))
                except Exception as e:  # one bad file
                    out.append((None, None, None, None, p, f"failed: {e}", None, None, None, None, None, None))
            yield pd.DataFrame(out, columns=names)

    return files.mapInPandas(work, SPANS)


def corpus_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", smallest: int = SMALLEST_FILE, skipped: tuple[str, ...] = ()) -> DataFrame:
    """path, length of the files that are large enough and in no skipped folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    for name in skipped:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    return files.where(F.col("length") >= smallest)


def font_files(spark: SparkSession, folders: list[str], bundled: str | None = None) -> DataFrame:
    """path, length of font files in sorted order; collections count in system folders only, hidden files never."""
    def scan(folder: str, suffixes: tuple[str, ...]) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
        return rows.where(F.lower(F.regexp_extract("path", "\\.([^.]+)$", 1)).isin(*suffixes) & ~F.regexp_replace("path", "^.*/", "").startswith("."))

    parts = [scan(f, FONT_SUFFIXES) for f in folders] + ([scan(bundled, FONT_SUFFIXES[:2])] if bundled else [])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("path")


def probed(lines: DataFrame, pages: int = PROBE_PAGES) -> DataFrame:
    """doc_id, chars, arabic, ratio, text_layer from each document's first pages; documents without text are left out."""
    g = lines.where(F.col("page_no") < pages).groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit(ARABIC))).alias("arabic")).where("chars > 0")
    return g.select("doc_id", "chars", "arabic", (F.col("arabic") / F.col("chars")).alias("ratio"), (F.col("chars") > 200).alias("text_layer"))


def arabic_corpus(probes: DataFrame, k: int = 30) -> DataFrame:
    """The k documents with the largest share of Arabic script, of those with more than a quarter and 400 characters of it."""
    return probes.where("ratio > 0.25 and arabic > 400").orderBy(F.desc("ratio"), "doc_id").limit(k)


def new_files(added: DataFrame, listed: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """path of the added files of the kind that aren't listed yet, each once."""
    return added.select("path").where(F.endswith(F.lower("path"), F.lit(suffix))).join(listed.select("path"), "path", "left_anti").distinct()
