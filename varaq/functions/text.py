"""Text repair as Column functions; the order of the steps in `normalized` is part of the meaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters and words that the rules are about.
ZWNJ, ZWJ, TATWEEL, NBSP, ZWSP = "\u200c", "\u200d", "\u0640", "\u00a0", "\u200b"
BIDI_CONTROLS = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff"
FOLD_FROM, FOLD_TO = "يىكةۀے", "ییکههی"
ARABIC_DIGITS, PERSIAN_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
TYPOGRAPHY_FROM, TYPOGRAPHY_TO = ",;?", "،؛؟"
MARKS = "\u064b-\u0655\u0670"
PUNCTUATION = "«»()\\[\\]{}،؛؟!.:"
PREFIXES = ("نمی", "می")
PREFIX_EXCEPTIONS = (
    "میان", "میز", "میزان", "میلی", "میلیون", "میلیارد", "مینا", "میرا", "میراث", "میوه", "میکا", "میکرب", "میکروسکوپ", "میگو", "میدان", "میل",
    "میله", "میم", "مینی", "میهن", "میخ", "میر", "میزبان", "میکرو", "میانگین", "میانسال", "نمیان", "میزنم",
)
LETTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءآأإئؤة۰۱۲۳۴۵۶۷۸۹"
FUNCTION_WORDS = (
    "و", "در", "به", "از", "که", "این", "را", "با", "برای", "است", "یک", "آن", "تا", "هم", "بود", "شد", "بر", "خود", "او", "ما", "شما", "ولی", "اما",
    "یا", "اگر", "چون", "همه", "هر", "دو", "سه", "نیز", "بی", "چند", "روی",
)
HEADING_WORDS = (
    "فصل", "بخش", "گفتار", "دفتر", "پیشگفتار", "پیش\u200cگفتار", "مقدمه", "دیباچه", "ضمیمه", "کتابنامه", "منابع", "نمایه", "پیوست", "نتیجه",
)
EDITION_WORDS = (
    "نسخه", "نسخهٔ", "ویرایش", "چاپ",
)
PRESENTATION_RANGES = ((0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
_HOLD = "\ue000"  # stands for "keep this mark"; private-use text never gets this far (see has_private_use)

PAIRS = (("(", ")"), ("[", "]"), ("{", "}"))
HEADINGS = (
    "^(?:" + "|".join(HEADING_WORDS) + ")([^\\p{L}\\p{N}_]|$)",
    "^[۰-۹0-9]+[.\u200c\\-–][\\s\\p{Z}]*[^۰-۹0-9]",
    "^[۰-۹0-9]+([.][۰-۹0-9]+)+[\\s\\p{Z}]",
    "^[۰-۹0-9]+[)][\\s\\p{Z}]",
    "^[IVXLC]+[.][\\s\\p{Z}]",
)
FOLIO = "^[۰-۹0-9]{1,4}$"


@dataclass(frozen=True)
class NormalizeOptions:
    """What `normalize` does. fold and persian_digits switch on one and the same step, either alone suffices."""

    strip_bidi: bool = True
    presentation_forms: bool = True
    fold: bool = True
    persian_digits: bool = True
    ascii_digits: bool = False
    drop_tatweel: bool = True
    drop_zwj: bool = True
    unmirror: bool = True
    brackets: bool = True
    marks: bool = True
    zwnj: bool = True
    prefixes: bool = True
    whitespace: bool = True
    whole_lines: bool = True  # False: a fragment of a line keeps a space at its ends
    typography: bool = False


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def strip_bidi(text: Column, drop_zwj: bool = True) -> Column:
    return F.translate(text, BIDI_CONTROLS + (ZWJ if drop_zwj else ""), "")


def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else "".join(unicodedata.normalize("NFKC", c) if any(a <= ord(c) <= b for a, b in PRESENTATION_RANGES) else c for c in s))


def presentation_forms(text: Column) -> Column:
    """Arabic presentation forms as letters (NFKC in those blocks only); the one step that needs Python, on Arrow batches."""
    udf = F.pandas_udf(_compatible, "string")
    touched = text.rlike("[\ufb50-\ufdff\ufe70-\ufeff]")
    return F.when(touched, udf(F.when(touched, text))).otherwise(text)


def fold_letters(text: Column) -> Column:
    return F.translate(text, FOLD_FROM + ARABIC_DIGITS, FOLD_TO + PERSIAN_DIGITS)


def ascii_to_persian_digits(text: Column) -> Column:
    return F.translate(text, ASCII_DIGITS, PERSIAN_DIGITS)


def drop_tatweel(text: Column) -> Column:
    return F.translate(text, TATWEEL, "")


def looks_mirrored(text: Column, threshold: float = 1.6, least: int = 30) -> Column:
    """Whether words read backwards are function words more often than words read forwards."""
    words = F.filter(F.split(text, "(?U)\\s+"), lambda w: w.rlike("^\\p{L}+$"))
    known = F.array(*map(F.lit, FUNCTION_WORDS))
    forward = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    backward = F.size(F.filter(words, lambda w: F.array_contains(known, F.reverse(w))))
    return (F.size(words) >= least) & (backward > 0) & (forward < backward * threshold)


def unmirror(text: Column) -> Column:
    """Each line turned round, with runs of Latin letters, digits and ._-@:/ as they were."""
    runs = lambda line: F.array_join(F.transform(F.regexp_extract_all(F.reverse(line), F.lit("([A-Za-z0-9._\\-@:/]+|[^A-Za-z0-9._\\-@:/])"), F.lit(1)), F.reverse), "")
    return F.array_join(F.transform(F.split(text, "\n", -1), runs), "\n")


def mirrored_brackets(text: Column) -> Column:
    """Words in brackets that stand the wrong way round."""
    for opening, closing in PAIRS:
        text = F.regexp_replace(text, f"(?U)(?<!\\S)\\{closing}(\\S+)\\{opening}(?!\\S)", f"\\{opening}$1\\{closing}")
    return text


def count_mirrored_brackets(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(f"(?U)(?<!\\S)\\{c}\\S+\\{o}(?!\\S)")) for o, c in PAIRS), F.lit(0))


def detached_marks(text: Column) -> Column:
    """A combining mark stays if a letter or the like stands before it, at most one space away (which then follows it)."""
    kept = F.regexp_replace(text, f"(?U)([^\\s A-Za-z{MARKS}])( ?)([{MARKS}])", f"$1{_HOLD}$3$2")
    return F.translate(F.regexp_replace(kept, f"({_HOLD}[{MARKS}])|[{MARKS}]", "$1"), _HOLD, "")


def repair_zwnj(text: Column) -> Column:
    """No doubled non-joiner, none at the ends or beside white space and punctuation, and no joiner."""
    text = F.translate(F.replace(text, F.lit(ZWNJ * 2), F.lit(ZWNJ)), ZWJ, "")
    text = F.regexp_replace(text, f"(?U)(?<![^\\s{PUNCTUATION}]){ZWNJ}|{ZWNJ}(?![^\\s{PUNCTUATION}])", "")
    return F.regexp_replace(text, f"^{ZWNJ}+|{ZWNJ}+$", "")


def split_prefixes(text: Column) -> Column:
    """A non-joiner after the verb prefixes that are written together with their verb."""

    def one(token: Column) -> Column:
        core = F.regexp_replace(token, f"^[{PUNCTUATION}]+|[{PUNCTUATION}]+$", "")
        glued = core.rlike(f"^(?:{'|'.join(PREFIXES)})[{LETTERS}][\\s\\S]") & ~F.contains(core, F.lit(ZWNJ)) & ~core.isin(*PREFIX_EXCEPTIONS)
        return F.when(glued, F.regexp_replace(token, f"^([{PUNCTUATION}]*)({'|'.join(PREFIXES)})", f"$1$2{ZWNJ}")).otherwise(token)

    return F.array_join(F.transform(F.split(text, " ", -1), one), " ")


def collapse_lines(text: Column) -> Column:
    """White space of whole lines: runs as one space, none at the ends, at most one empty line."""
    text = F.regexp_replace(F.translate(text, NBSP + ZWSP, " "), "(?U)[\\s&&[^\\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " ?\\n ?", "\n"), "\\n{3,}", "\n\n"), "^ | $", "")


def collapse_fragment(text: Column) -> Column:
    """White space of a part of a line: runs as one space, also at the ends."""
    return F.regexp_replace(text, "(?U)[\\s&&[^\\n]]+", " ")


def typography(text: Column) -> Column:
    return F.translate(text, TYPOGRAPHY_FROM, TYPOGRAPHY_TO)


REPAIRS = ("mirrored", "brackets_repaired", "marks_removed", "zwnj_removed", "zwnj_added")


def normalized(df: DataFrame, column: str = "text", options: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """df with `column` normalized by all chosen steps in their order, and with what was repaired: mirrored (boolean),
    brackets_repaired, marks_removed, zwnj_removed, zwnj_added. Null stays null, with null counts.

    Each step is a projection of its own: a text that a step reads several times is computed once.
    """
    o = options
    clash = [c for c in REPAIRS if c in df.columns and c != column]
    if clash:
        raise ValueError(f"columns in the way: {clash}")
    text = F.col(column)
    if o.strip_bidi:
        text = strip_bidi(text, o.drop_zwj)
    if o.presentation_forms:
        df, text = df.withColumn(column, text), F.col(column)
        text = presentation_forms(text)
        df, text = df.withColumn(column, text), F.col(column)
    if o.fold or o.persian_digits:
        text = fold_letters(text)
    if o.ascii_digits:
        text = ascii_to_persian_digits(text)
    if o.drop_tatweel:
        text = drop_tatweel(text)
    df = df.withColumn(column, text)
    t = F.col(column)
    df = df.withColumn("mirrored", looks_mirrored(t) if o.unmirror else F.lit(False))
    if o.unmirror:
        df = df.withColumn(column, F.when(F.col("mirrored"), unmirror(t)).otherwise(t))
    if o.brackets:
        df = df.withColumns({"brackets_repaired": count_mirrored_brackets(t), column: mirrored_brackets(t)})
    else:
        df = df.withColumn("brackets_repaired", F.lit(0))

    def counted(df: DataFrame, name: str, what: str, change: Callable[[Column], Column], sign: int) -> DataFrame:
        n = F.regexp_count(t, F.lit(what))
        return df.withColumns({name: n, column: change(t)}).withColumn(name, (F.col(name) - n) * sign)

    keep = lambda c: c
    df = counted(df, "marks_removed", f"[{MARKS}]", detached_marks if o.marks else keep, 1)
    df = counted(df, "zwnj_removed", ZWNJ, repair_zwnj if o.zwnj else keep, 1)
    df = counted(df, "zwnj_added", ZWNJ, split_prefixes if o.prefixes else keep, -1)
    text = t
    if o.whitespace:
        text = collapse_lines(text) if o.whole_lines else collapse_fragment(text)
    if o.typography:
        text = typography(text)
    return df.withColumn(column, text)


def has_private_use(text: Column) -> Column:
    return text.rlike("\\p{Co}")


def private_use(text: Column) -> Column:
    """The distinct private-use code points, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("\\p{Co}"), F.lit(0)), F.ascii)))


def has_arabic_script(text: Column) -> Column:
    return text.rlike("[\u0600-\u06ff]")


def escape(text: Column) -> Column:
    """For XML; quotes stay."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clean(text: Column) -> Column:
    return strip(F.regexp_replace(text, "[ \\t]+", " "))


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return strip(F.regexp_replace(text, "(?U)\\s+", " "))


def is_numbering(text: Column) -> Column:
    """Digits, points and spaces only."""
    return text.rlike("^[۰-۹0-9. ]+$")


def is_folio(text: Column) -> Column:
    return text.rlike(FOLIO)


def has_heading_form(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in HEADINGS))


def title_author(title: Column, author: Column, path: Column) -> Column:
    """struct(title, author): from the metadata if it has a title, else from the file's name, 'author, title' or a title alone."""
    title, author = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(author, F.lit("")))
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), "(?<=.)\\.[^.]+$", "")
    stem = strip(F.regexp_replace(stem, f"(?U)\\s*[(\\[]?(?:{'|'.join(EDITION_WORDS)})[^)\\]]*[)\\]]?$", ""))
    parts = F.filter(F.transform(F.split(stem, "(?U)\\s*[،,]\\s*"), strip), lambda p: p != "")
    named = (F.size(parts) >= 2) & (author == "")
    guess = F.when(named, F.array_join(F.slice(parts, 2, F.size(parts)), "، ")).otherwise(stem)
    return F.struct(F.when(title != "", title).otherwise(guess).alias("title"), F.when((title == "") & named, F.element_at(parts, 1)).otherwise(author).alias("author"))


def version_parts(version: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(version), "^[vV]+", ""), "\\.", -1), lambda p: F.coalesce(F.regexp_replace(p, "[^0-9]", "").try_cast("int"), F.lit(0)))


def is_newer(candidate: Column, mine: Column) -> Column:
    """Whether a version is higher, part by part, missing parts counting as 0."""
    a, b = version_parts(candidate), version_parts(mine)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0), n - F.size(x)))
    return pad(a) > pad(b)
