"""Fonts: admission, faces of a family, ranking and choice, over a table of font files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_COVERAGE = 40
# Families made for Persian, the best first; marks of open licences.
PREFERRED = (
    "vazirmatn", "vazir", "iransans", "iranyekan", "yekan bakh", "sahel", "shabnam", "samim", "tanha", "gandom", "parastoo", "estedad", "dana",
    "peyda", "morabba", "mikhak", "shahab", "bnazanin", "inazanin", "nazanin", "bmitra", "imitra", "mitra", "btitr", "titr", "amiri",
    "noto naskh arabic", "noto sans arabic", "scheherazade", "markazi text", "kalameh", "dubai",
)
OPEN_LICENCES = ("sil open font license", "open font license", "scripts.sil.org/ofl", "openfontlicense", "apache license, version 2.0", "apache.org/licenses/license-2.0")
BOLD_FILE = "(?i)(^|[^a-z])(bd|bold|black|heavy|semibold|demibold)([^a-z]|$)"
ITALIC_FILE = "(?i)(italic|oblique|it([^A-Za-z0-9_]|$))"
NOT_REGULAR = "(?i)(light|thin|ultra|black|medium|heavy|semi|demi|bd|bold)"
FACES = ("regular", "bold", "italic", "bold_italic")


def redistributable(license_text: Column) -> Column:
    """Whether the licence text names an open licence; a missing text doesn't."""
    low = F.lower(F.coalesce(license_text, F.lit("")))
    return F.exists(F.array(*map(F.lit, OPEN_LICENCES)), lambda m: F.contains(low, m))


def admitted(fonts: DataFrame, least: int = MIN_COVERAGE) -> DataFrame:
    """Fonts with enough Arabic letters and a family name that isn't hidden."""
    return fonts.distinct().where((F.col("coverage") >= least) & (F.coalesce("family", F.lit("")) != "") & ~F.col("family").startswith("."))


def name_rank(family: Column) -> Column:
    """The place of the first preferred name that the family's name holds; after all of them without one."""
    low = F.lower(F.trim(family))
    hits = F.filter(F.sequence(F.lit(0), F.lit(len(PREFERRED) - 1)), lambda i: F.contains(low, F.element_at(F.array(*map(F.lit, PREFERRED)), i + 1)))
    return F.coalesce(F.get(hits, 0), F.lit(len(PREFERRED)))


def families(fonts: DataFrame) -> DataFrame:
    """One row per family: its four faces, coverage and probe of its widest file, whether all files may be passed on, and rank.

    Files are looked at by length of name, then name. A file that is bold and italic stands for that face if it is still open,
    and so on; one that finds its face taken may still be the regular face if nothing in its name says otherwise.
    """
    name = F.regexp_replace("path", "^.*/", "")
    stem = F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")
    rows = admitted(fonts).select("family", "path", F.length(name).alias("l"), name.alias("name"), stem.rlike(BOLD_FILE).alias("b"), stem.rlike(ITALIC_FILE).alias("i"), stem.rlike(NOT_REGULAR).alias("odd"), "coverage", "probe", redistributable(F.col("license_text")).alias("open"))
    g = rows.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("l", "name", "path", "b", "i", "odd", "coverage", "probe"))).alias("files"), F.bool_and("open").alias("redistributable"))
    none = F.lit(None).cast("string")
    start = F.struct(*(none.alias(f) for f in FACES))

    def place(acc: Column, f: Column) -> Column:
        face = (
            F.when(f["b"] & f["i"] & acc["bold_italic"].isNull(), "bold_italic").when(f["b"] & acc["bold"].isNull(), "bold")
            .when(f["i"] & acc["italic"].isNull(), "italic").when(acc["regular"].isNull() & ~f["odd"], "regular")
        )
        return F.struct(*(F.when(face == x, f["path"]).otherwise(acc[x]).alias(x) for x in FACES))

    widest = F.array_max(F.transform("files", lambda f: f["coverage"]))
    first = F.element_at(F.filter("files", lambda f: f["coverage"] == widest), 1)
    g = g.withColumn("faces", F.aggregate("files", start, place))
    out = g.select("family", F.coalesce("faces.regular", F.element_at("files", 1)["path"]).alias("regular"), "faces.bold", "faces.italic", "faces.bold_italic", widest.alias("coverage"), first["probe"].alias("probe"), "redistributable")
    best = [name_rank(F.col("family")), F.desc("probe"), F.desc("redistributable"), F.desc("coverage"), F.lower("family"), F.col("family")]
    # as many rows as there are families
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*best)))


def pick(choices: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each distinct `wanted` with the family chosen: by name, by part of the name, else the first; null if there is none.

    A name that holds the wanted one holds its first three letters, so the families meet by their short substrings.
    """
    named = choices.select("family", "rank", F.lower(F.trim("family")).alias("name"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name") - n + 1)), lambda i: F.substring(F.col("name"), i, n))))
    keyed = named.select("family", "rank", "name", F.explode(F.array_distinct(pieces)).alias("key"))
    names = wanted.select("wanted").distinct().withColumn("w", F.lower(F.trim("wanted")))
    hits = names.where("w <> ''").withColumn("key", F.left("w", F.lit(3))).join(keyed, "key").where(F.contains("name", F.col("w")))
    best = hits.groupBy("wanted").agg(F.min_by("family", F.struct(F.col("name") != F.col("w"), "rank")).alias("found"))
    first = choices.agg(F.min_by("family", "rank").alias("first"))  # one row
    return names.join(best, "wanted", "left").crossJoin(F.broadcast(first)).select("wanted", F.coalesce("found", "first").alias("family"))


def face_files(choices: DataFrame) -> DataFrame:
    """family, face, path of the faces that there are."""
    pairs = ", ".join(f"'{f}', {f}" for f in FACES)
    return choices.select("family", F.expr(f"stack({len(FACES)}, {pairs}) AS (face, path)")).where("path is not null")
