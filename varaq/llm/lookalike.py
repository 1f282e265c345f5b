"""Problem 5: texts that look the same, brought to one form.

Method: words are exploded to positioned code points; two broadcast joins bring decompositions and look-alike
letters, and canonical classes; marks are ordered by class within their cluster; clusters are recomposed by a
broadcast join; strings are rebuilt in order. That is done once for each distinct word beyond ASCII (between plain
spaces, across which nothing is reordered or joined); texts then take the forms of the words that change, by one join
of their exploded words with the changed ones, and texts without any such word are their own form.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO
from ..session import settled
from .repeated import SALTS, met

#: Letters of other scripts that look like Latin ones: fixed values, in pairs.
LATIN_LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ԌG ҺH ԚQ ԜW ӀI ѴV "
    "οo νv αa ρp ιi υu γy κk χx ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC ɑa ɡg ıi օo սu հh ցg ոn ѡw кk"
)
#: Arabic letters folded into Persian ones by the text repair, and other letters of the same shapes: fixed values, in pairs.
PERSIAN_FOLDS = " ".join(a + b for a, b in zip(FOLD_FROM, FOLD_TO)) + " ہه ەه ھه ڪک ۓی"
#: Arabic-Indic digits whose Persian twins look the same: fixed values, in pairs.
SAME_DIGITS = "٠۰ ١۱ ٢۲ ٣۳ ٧۷ ٨۸ ٩۹"
#: Arabic letters that never join to the next letter: fixed values.
NO_JOIN_AFTER = "ءآأؤإاةدذرزوٱٲٳٵٶٷڈډڊڋڌڍڎڏڐڑڒړڔڕږڗژڙۀۃۄۅۆۇۈۉۊۋۍۏەۮۯ"
INVISIBLE = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}\x{200d}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{e0000}-\x{e0fff}"
_KEPT_KINDS = {"wide", "narrow", "compat", "noBreak", "isolated", "initial", "medial", "final"}
#: Where characters that stay as they are get looked for; all others take the way through the tables, in rows of their own.
_STILL_BLOCKS = ((0x0A, 0x0A), (0x20, 0x7E), (0xA1, 0xFF), (0x60C, 0x6D3), (0x200C, 0x200C), (0x2010, 0x2026), (0xE01, 0xE4C), (0x3001, 0x3002), (0x3041, 0x3096), (0x30A1, 0x30FC), (0x4E00, 0x9FFF))
_CLASS = {0x0E4D: 106}  # the Thai ring is drawn below the tone mark, whichever is typed first


def _class(ch: str) -> int:
    return _CLASS.get(ord(ch), unicodedata.combining(ch))


def _pairs(text: str) -> dict[str, str]:
    return {p[0]: p[1] for p in text.split()}


def _decomposed(ch: str) -> str:
    """Compatibility decomposition by the kinds that keep the look; canonical ones always."""
    d = unicodedata.decomposition(ch)
    if not d or 0x2100 <= ord(ch) <= 0x214F or ch == "ſ":
        return ch
    parts = d.split()
    if parts[0][0] == "<":
        if parts[0][1:-1] not in _KEPT_KINDS:
            return ch
        parts = parts[1:]
    out = "".join(chr(int(p, 16)) for p in parts)
    if len(out) > 1 and out[0] == " ":
        return ch
    return "".join(_decomposed(c) for c in out)


@lru_cache(1)
def tables() -> tuple[list[tuple[str, int, str, int]], list[tuple[str, str]], str]:
    """(mapping rows (c, k, out, class), compositions (cluster, composed), class of characters that surely stay).

    Made from the Unicode data of the running Python; their size is bounded by Unicode, some thousands of rows.
    """
    folds = _pairs(LATIN_LOOKALIKES) | _pairs(PERSIAN_FOLDS) | _pairs(SAME_DIGITS)
    rows, compose = [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF or cp > 0x1FFFF and not 0x2F800 <= cp <= 0x2FA1F:
            continue
        ch = chr(cp)
        out = folds.get(ch) or "".join(folds.get(c, c) for c in _decomposed(ch))
        if unicodedata.category(ch) == "Zs":
            out = " "
        elif ch == "‐":
            out = "-"
        if _class(ch) or out != ch:
            rows += [(ch, k, c, _class(c)) for k, c in enumerate(out)]
        if len(out) > 1 and not _class(out[0]) and all(map(_class, out[1:])):
            compose.setdefault(_sorted(out), ch)
    for cluster in list(compose):  # the composed character is the one Unicode prefers, if it has one
        nfc = unicodedata.normalize("NFC", cluster)
        compose[cluster] = nfc if len(nfc) == 1 else compose[cluster]
    fixed = {ch for ch in {r[0] for r in rows} if compose.get(_sorted("".join(r[2] for r in rows_of(rows, ch)))) == ch}
    moving = {ord(c) for c in {r[0] for r in rows} - fixed}
    still = [cp for a, b in _STILL_BLOCKS for cp in range(a, b + 1) if cp not in moving and unicodedata.category(chr(cp))[0] != "M"]
    return rows, sorted(compose.items()), _ranges(still)


_index: dict[int, dict[str, list]] = {}


def rows_of(rows: list[tuple], ch: str) -> list[tuple]:
    at = _index.get(id(rows))
    if at is None:
        at = _index[id(rows)] = {}
        for r in rows:
            at.setdefault(r[0], []).append(r)
    return at[ch]


def _sorted(cluster: str) -> str:
    return cluster[0] + "".join(sorted(cluster[1:], key=_class))


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


def _visible(text: F.Column) -> F.Column:
    """Without invisible characters, and without non-joiners that change nothing."""
    bare = F.regexp_replace(text, f"[{INVISIBLE}]+", "")
    bare = F.regexp_replace(bare, "\\x{200c}{2,}", "‌")
    joins = rf"[\p{{IsArabic}}&&\p{{L}}&&[^{NO_JOIN_AFTER}]]"
    return F.when(F.contains(bare, F.lit("‌")), F.regexp_replace(bare, rf"(?<!{joins}\p{{Mn}}{{0,4}})\x{{200c}}|\x{{200c}}(?!\p{{Mn}}*[\p{{IsArabic}}&&\p{{L}}&&[^ء]])", "")).otherwise(bare)


def word_forms(words: DataFrame) -> DataFrame:
    """word, form: one row per distinct word of the column `word` whose form is another; null has none."""
    spark = words.sparkSession
    rows, compose, still = tables()
    mapping = spark.createDataFrame(rows, "c string, k int, out string, class int")
    composed = spark.createDataFrame(compose, "cluster_text string, composed string")
    seen = words.where("word is not null").distinct().select("word", _visible(F.col("word")).alias("text"))
    changes = F.col("text").rlike(f"[^{still}]")
    pieces = F.when(changes, F.regexp_extract_all("text", F.lit(f"(?:[{still}](?!\\p{{M}})){{1,500}}|[\\s\\S]"), F.lit(0))).otherwise(F.array("text"))
    exploded = seen.select("word", F.posexplode(pieces).alias("pos", "c"))
    mapped = exploded.join(F.broadcast(mapping), "c", "left").select("word", "pos", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("out", "c").alias("out"), F.coalesce("class", F.lit(0)).alias("class"))
    order = Window.partitionBy("word").orderBy("pos", "k")
    clusters = (
        mapped.withColumn("cluster", F.sum((F.col("class") == 0).cast("int")).over(order))
        .groupBy("word", "cluster")
        .agg(F.min(F.when(F.col("class") == 0, F.col("out"))).alias("base"), F.collect_list(F.when(F.col("class") > 0, F.struct("class", "pos", "k", "out"))).alias("marks"))
        .withColumn("cluster_text", F.concat(F.coalesce("base", F.lit("")), F.array_join(F.transform(F.array_sort("marks"), lambda m: m["out"]), "")))
    )
    return (
        clusters.join(F.broadcast(composed), "cluster_text", "left")
        .groupBy("word")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", F.coalesce("composed", "cluster_text").alias("t")))), lambda c: c["t"]), "").alias("form"))
        .where("form <> word")
    )


def _beyond_ascii(column: str) -> F.Column:
    return F.octet_length(column) > F.length(column)


def forms(texts: DataFrame) -> DataFrame:
    """h1, h2 (hashes of the text), form: one row per distinct text of the column `text`; null has none, the empty text is its own form."""
    known = texts.where("text is not null")
    words = known.where(_beyond_ascii("text")).select(F.explode(F.split("text", " ")).alias("word")).where(_beyond_ascii("word"))
    changed = settled(word_forms(words))
    one = known.select(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"), "text").dropDuplicates(["h1", "h2"])
    placed = one.where(_beyond_ascii("text")).select("h1", "h2", F.posexplode(F.split("text", " ")).alias("at", "word")).where(_beyond_ascii("word"))
    forms_at = F.map_from_entries(F.collect_list(F.struct("at", "form")))
    fixes = met(placed, changed, ["word"], "h1").groupBy("h1", "h2").agg(forms_at.alias("forms"))
    form = F.when(F.col("forms").isNull(), F.col("text")).otherwise(F.array_join(F.expr("transform(split(text, ' '), (w, i) -> coalesce(forms[i], w))"), " "))
    return one.join(fixes, ["h1", "h2"], "left").select("h1", "h2", form.alias("form"))


def unified(df: DataFrame, column: str = "text", into: str = "form") -> DataFrame:
    """df with the one form of `column`; null stays null; every row of df stays, repeated ones too."""
    table = forms(df.select(F.col(column).alias("text"))).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("form").alias("__form"))
    keyed = df.withColumns({"__a": F.xxhash64(F.col(column)), "__b": F.xxhash64(F.col(column), F.lit(7))})
    out = keyed.join(table, F.when(F.col(column).isNotNull(), F.col("__a")).eqNullSafe(F.col("__h1")) & (F.col("__b") == F.col("__h2")), "left")
    return out.withColumn(into, F.col("__form")).drop("__a", "__b", "__h1", "__h2", "__form")


def _classes(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, kept): block_id with the hashes of its text, distinct; and the hashes of texts with those of their forms (f1, f2), of forms
    that several texts share. Only ids and hashes are shuffled once the forms are known."""
    rows = blocks.where("block_id is not null and text is not null").select("block_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2")).distinct()
    form = settled(forms(blocks.where("block_id is not null").select("text")).select("h1", "h2", F.xxhash64("form").alias("f1"), F.xxhash64("form", F.lit(7)).alias("f2")))  # four numbers a text, read twice
    several = settled(form.groupBy("f1", "f2").agg(F.count("*").alias("texts")).where("texts > 1"))
    return rows, met(form, several, ["f1", "f2"], "h1")


def same_look_pairs(blocks: DataFrame) -> DataFrame:
    """block_a, block_b (smaller id first): blocks whose texts have one form but are stored differently.

    Forms with a single text drop out before the join, and the texts of a form are spread over SALTS tasks. Equal rows
    count once; null ids or texts never pair; an id with two texts pairs with others, never with itself.
    """
    rows, kept = _classes(blocks)
    kept = settled(kept)
    # texts meet texts first, then their blocks: many copies of one text are never compared with each other
    one = kept.select("f1", "f2", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.pmod("h1", F.lit(SALTS)).alias("salt"))
    other = kept.select("f1", "f2", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    texts = one.join(other, ["f1", "f2", "salt"]).where("a1 < b1 or (a1 = b1 and a2 < b2)").select("a1", "a2", "b1", "b2")
    left = rows.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("block_id").alias("x"))
    right = rows.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("block_id").alias("y"))
    pairs = texts.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b")).distinct()


def same_look_classes(blocks: DataFrame) -> DataFrame:
    """block_id, class_id (the smallest block_id of its class), blocks and texts (in the class), links (blocks of the class stored
    differently): one row per block that looks like another one stored differently. Grows with the blocks, not with their pairs."""
    rows, kept = _classes(blocks)
    members = settled(rows.join(kept, ["h1", "h2"]).select("block_id", "h1", "h2", "f1", "f2", "texts"))
    classes = members.groupBy("f1", "f2").agg(F.min("block_id").alias("class_id"), F.count_distinct("block_id").alias("blocks"))
    same = members.groupBy("f1", "f2", "h1", "h2").agg(F.count("*").alias("same"))
    facts = settled(same.join(classes, ["f1", "f2"]))
    out = met(members, facts, ["f1", "f2", "h1", "h2"], "block_id")
    return out.groupBy("block_id", "class_id", "blocks", "texts").agg((F.first("blocks") - F.max("same")).alias("links"))


def found(blocks: DataFrame) -> DataFrame:
    return same_look_pairs(blocks.where("kind in ('p', 'note')"))


def classes(blocks: DataFrame) -> DataFrame:
    return same_look_classes(blocks.where("kind in ('p', 'note')"))
