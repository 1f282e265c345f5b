"""Text repair: rules against small cases and against sequential specifications on random strings."""

import random

import pytest
from pyspark.sql import functions as F

from varaq.functions import text as T


def applied(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "rule, given, expected",
    [
        (T.strip_bidi, "a‏b‍‪﻿c", "abc"),
        (T.strip_bidi, "a‌b", "a‌b"),
        (T.fold_letters, "كتاب علي ٣", "کتاب علی ۳"),
        (T.presentation_forms, "ﺳﻼم ﬁ²", "سلام ﬁ²"),
        (T.drop_tatweel, "کـــتاب", "کتاب"),
        (T.mirrored_brackets, "سال )۱۸۸۲( بود", "سال (۱۸۸۲) بود"),
        (T.mirrored_brackets, ") ( )a]", ") ( )a]"),
        (T.detached_marks, "دشمن ِِ ما", "دشمنِ  ما"),
        (T.detached_marks, "Latinَ ", "Latin "),
        (T.repair_zwnj, "‌می‌‌روم‌ .", "می‌روم ."),
        (T.split_prefixes, "میروم نمیدانم میز (میشود) می", "می‌روم نمی‌دانم میز (می‌شود) می"),
        (T.collapse_lines, "  a  b \n\n\n\n c​ ", "a b\n\nc"),
        (T.collapse_fragment, "  a \t b ", " a b "),
        (T.typography, "a, b; c?", "a، b؛ c؟"),
        (T.escape, '<a & "b">', '&lt;a &amp; "b"&gt;'),
        (T.unmirror, "abc 12 مالس", "سلام 12 abc"),
        (T.clean, "\t a  b ", "a b"),
    ],
)
def test_rules(spark, rule, given, expected):
    assert applied(spark, rule, [given, None, ""]) == [expected, None, ""]


#: (given, expected of a whole line): what the chain of all rules has to give.
WHOLE = [
    ("يك", "یک"), ("مدينه", "مدینه"), ("١٢٣٤", "۱۲۳۴"), ("ﻻ", "لا"), ("ﻲ", "ی"), ("ﬁ", "ﬁ"), ("abc\u200fdef", "abcdef"), ("a\u202ab\u202c", "ab"), ("می\u200cرود", "می\u200cرود"),
    ("ســـلام", "سلام"), ("a\u00a0b", "a b"), ("a   b\n\n\n\nc", "a b\n\nc"), ("می\u200c\u200cرود", "می\u200cرود"), ("می \u200cرود", "می رود"), ("کتاب\u200c،", "کتاب،"),
    ("میروم", "می\u200cروم"), ("نمیخواهم", "نمی\u200cخواهم"), ("میان", "میان"), ("میز", "میز"), (")1882(", "(1882)"), ("(1882)", "(1882)"), ("]12[", "[12]"), (")", ")"),
    ("گفت (به نظر من) خوب", "گفت (به نظر من) خوب"), ("دشمن ِمردم", "دشمنِ مردم"), ("دشمن ِِ مردم", "دشمنِ مردم"), ("دشمن ِ ِمردم ِ", "دشمنِ مردمِ"), ("Madjid Omraniِِِ", "Madjid Omrani"),
    ("میرومِ", "می\u200cرومِ"), ("مدّرس", "مدّرس"), (" a ", "a"), ("a, b?", "a, b?"), ("1400", "1400"),
]
PIECES = [("هنریک ", "هنریک "), (" ایبسن", " ایبسن"), (" ", " "), ("a   b", "a b"), (" a  b ", " a b ")]


def test_the_whole_chain(spark):
    lines = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(WHOLE)], "i int, text string")
    got = [r["text"] for r in T.normalized(lines).orderBy("i").collect()]
    assert got == [e for _, e in WHOLE]
    pieces = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(PIECES)], "i int, text string")
    assert [r["text"] for r in T.normalized(pieces, "text", T.NormalizeOptions(whole_lines=False)).orderBy("i").collect()] == [e for _, e in PIECES]
    asked = spark.createDataFrame([(0, "a, b?"), (1, "1400")], "i int, text string")
    assert [r["text"] for r in T.normalized(asked, "text", T.NormalizeOptions(typography=True, ascii_digits=True)).orderBy("i").collect()] == ["a، b؟", "۱۴۰۰"]
    counted = T.normalized(spark.createDataFrame([(0, "می‌گفت )1369("), (1, "Omraniِِ"), (2, "میروم")], "i int, text string")).orderBy("i").collect()
    assert (counted[0]["brackets_repaired"], counted[1]["marks_removed"], counted[2]["zwnj_added"]) == (1, 2, 1)


def test_mirror_detection(spark):
    line = "این کتاب را از آن خانه که در شهر بود به ما داد و رفت تا با او در راه خود باشد ولی اگر هم چند روز نیز بی او بود"
    backwards = " ".join(w[::-1] for w in line.split())
    assert applied(spark, T.looks_mirrored, [line, backwards, "کوتاه"]) == [False, True, False]


def marks_by_hand(s):
    marks, out = set("ًٌٍَُِّْٰٕٓٔ"), []
    for ch in s:
        if ch not in marks:
            out.append(ch)
            continue
        gap = bool(out) and out[-1] == " "
        if gap:
            out.pop()
        prev = out[-1] if out else ""
        if prev and prev not in marks and not prev.isspace() and not (prev.isascii() and prev.isalpha()):
            out.append(ch)
        if gap:
            out.append(" ")
    return "".join(out)


def test_detached_marks_against_a_fold(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("ab ابِّ .\n", k=rnd.randint(0, 12))) for _ in range(3000)]
    assert applied(spark, T.detached_marks, texts) == [marks_by_hand(t) for t in texts]


def test_heading_forms(spark):
    got = applied(spark, T.has_heading_form, ["فصل اول", "فصلنامه", "۱- آغاز", "1.2 x", "3) y", "IV. z", "متن", "۱۲"])
    assert got == [True, False, True, True, True, True, False, False]


def test_titles_from_names(spark):
    rows = spark.createDataFrame([(None, None, "/a/ایبسن، خانه عروسک (چاپ ۲).pdf"), ("T", None, "/a/x.pdf"), ("", "A", "/a/b, c.pdf"), (None, None, "/a/.hidden")], "t string, a string, p string")
    got = [tuple(r["x"]) for r in rows.select(T.title_author(F.col("t"), F.col("a"), F.col("p")).alias("x")).collect()]
    assert got == [("خانه عروسک", "ایبسن"), ("T", ""), ("b, c", "A"), (".hidden", "")]


def test_versions(spark):
    rows = spark.createDataFrame([("v1.2.10", "1.2.9"), ("1.2", "1.2.0"), ("2.x", "2.0.1"), ("0.10", "0.9.9")], "a string, b string")
    assert [r["n"] for r in rows.select(T.is_newer(F.col("a"), F.col("b")).alias("n")).collect()] == [True, False, False, True]


def test_normalized_counts(spark):
    rows = spark.createDataFrame([(1, "كتاب )۱۲( میروم‌ ."), (2, None)], "i int, text string")
    got = T.normalized(rows).orderBy("i").collect()
    assert got[0]["text"] == "کتاب (۱۲) می‌روم ." and (got[0]["brackets_repaired"], got[0]["zwnj_removed"], got[0]["zwnj_added"]) == (1, 1, 1)
    assert got[1]["text"] is None
    again = T.normalized(T.normalized(rows).select("i", "text")).orderBy("i").first()
    assert again["text"] == got[0]["text"]
    with pytest.raises(ValueError):
        T.normalized(rows.withColumn("mirrored", F.lit(1)))


def test_private_use(spark):
    assert applied(spark, T.private_use, ["a\U00100001", "x"]) == [[0xE001, 0x100001], []]
