"""The nine operators on small fixtures: results, brute force, round trips, held-out accuracy and odd input."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from varaq.llm import garbled, language, leaks, lookalike, mixture, quality, repeated, sentences, split

BLOCK = "block_id bigint, doc_id bigint, block_no int, chapter_no int, kind string, text string, h1 string, `key` int, `text2` string"
LONG = "word " * 60_000


def blocks(spark, rows):
    """(block_id, doc_id, block_no, kind, text), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, d, n, 0, k, t, "x", 1, None) for i, d, n, k, t in rows], BLOCK)


# 1 ------------------------------------------------------------------------------------------------------------

def model(spark):
    """Statistics of a corpus in which Dr. and p. stand inside sentences and etc. at their ends."""
    lines = ["According to Dr. Smith the market was open. It was late, ropes, tar, etc.", "The old tower fell on p. 12 of the book. Nobody saw it fall.", "They bought nails, ropes, etc. The ship left at noon!", "The day was long. It ended well."] * 60
    return sentences.fit(blocks(spark, [(i, i, 0, "p", t) for i, t in enumerate(lines)]))


@pytest.fixture(scope="module")
def fitted(spark):
    return model(spark)


@pytest.mark.parametrize("text, expected", [
    ("According to Dr. Smith it fell. It did.", ["According to Dr. Smith it fell.", "It did."]),
    ("They had ropes, etc. The ship left.", ["They had ropes, etc.", "The ship left."]),
    ("See p. 12 of it. It cost 3.5 coins!", ["See p. 12 of it.", "It cost 3.5 coins!"]),
    ("“It is late. Go home,” said Bob. He left.", ["“It is late. Go home,” said Bob.", "He left."]),
    ("\"It is late!\" cried Ann; they left.", ["\"It is late!\" cried Ann; they left."]),
    ("Bob wrote: \"The tower fell.\" The day ended.", ["Bob wrote: \"The tower fell.\"", "The day ended."]),
    ("It fell ... or so it seemed. The end.", ["It fell ... or so it seemed.", "The end."]),
    ("The tower fell.The day ended.", ["The tower fell.", "The day ended."]),
    ("It fell. notes.txt names it twice.", ["It fell.", "notes.txt names it twice."]),
    ("Who fell?! The tower.", ["Who fell?!", "The tower."]),
    ("(1) The tower fell. It did.", ["(1) The tower fell.", "It did."]),
    ("他走了。“太晚了！”她说，门开了。", ["他走了。", "“太晚了！”她说，门开了。"]),
    ("ไปตลาด ราคา 12.5 บาท กลับบ้าน", ["ไปตลาด", "ราคา 12.5 บาท", "กลับบ้าน"]),
    ("no end mark", ["no end mark"]), ("   ", []), ("", []),
])
def test_sentences(fitted, text, expected):
    assert [text[a:b] for a, b in sentences.split(text, fitted)] == expected


def test_sentences_odd_input(spark, fitted):
    rows = [(1, 1, 0, "p", None), (2, 1, 1, "p", ""), (3, 1, 2, "note", "One. Two"), (3, 1, 2, "note", "One. Two"), (4, 1, 3, "h1", "No. Not this"), (5, None, None, "p", "Lone."), (6, 2, 0, "p", LONG), (7, 2, 1, "p", "“" * 20_000 + "."), (8, 2, 2, None, "x")]
    got = {tuple(r) for r in sentences.found(blocks(spark, rows)).collect()}
    assert {(1, 2, 0, 4), (1, 2, 5, 8), (None, None, 0, 5), (2, 0, 0, len(LONG) - 1), (2, 1, 0, 20_001)} == got
    assert sentences.found(blocks(spark, []).limit(0)).count() == 0
    for t in ("a. b. c", "Dr. No. x"):
        cut = sentences.split(t, fitted)
        assert "".join(t[a:b] for a, b in cut).replace(" ", "") == t.replace(" ", "")


@pytest.mark.parametrize("words", [5, 60, 400])
def test_quotations_of_any_length(fitted, words):
    text = f"“{'The tower fell there. ' * words}Go home,” said Bob. He left."
    assert [text[a:b] for a, b in sentences.split(text, fitted)] == [text[:-9], "He left."]


def test_words_of_any_length(fitted):
    text = f"{'x' * 5000}.txt fell. It did so at {'y' * 300}.txt, {'z' * 900}. The end."
    assert len(sentences.split(text, fitted)) == 3


def test_totals_count_everything(spark):
    """The ratios rest on all words and points, rare ones too, and agree with the formula."""
    import math

    rows = [("en", "p", "dr", "upper", 9), ("en", "p", "house", "end", 30), ("en", "p", "house", "upper", 20), ("en", "w", "house", "", 200)] + [("en", "w", f"w{i}", "", 1) for i in range(800)]
    model = sentences.collected(sentences.statistics(spark.createDataFrame(rows, "lang string, kind string, key string, sub string, n bigint")))
    rate = 59 / (59 + 1000)
    assert 2 * 9 * math.log(0.99 / rate) > sentences.CHI2 and ("en", "dr") in model["short"] and ("en", "dr") in model["pure"] and ("en", "house") not in model["short"]


def test_salted_statistics_give_the_same(spark, monkeypatch):
    lines = ["According to Dr. Smith the market was open. It was late, see p. 12, etc.", "They bought nails ... and ropes, etc. The ship left. A. B. Smith saw it!"] * 40
    table = blocks(spark, [(i, i, 0, "p", t) for i, t in enumerate(lines)])
    want = set(map(tuple, sentences.found(table).collect()))
    monkeypatch.setattr(repeated, "BROADCAST_ROWS", 0)
    assert set(map(tuple, sentences.found(table).collect())) == want
    model = sentences.fit(table)
    assert want == {(i, 0, a, b) for i, t in enumerate(lines) for a, b in sentences.split(t, model)}


# 2 ------------------------------------------------------------------------------------------------------------

SPAN = "doc_id bigint, page_no int, line_no int, span_no int, text string, font string, n int, word string, chain string"


def spans(spark, texts):
    return spark.createDataFrame([(1, 0, i, 0, t, "F", 1, "w", None) for i, t in enumerate(texts)], SPAN)


def test_garbled_words_are_found_and_restored(spark):
    clean = ["préparé le déjà café été naïve élève", "die größere Tür für müde Gäste hört", "он видел новый дом там где 12 был", "در کنار رودخانه سال 15 خانه قدیمی"] * 40
    wrong = [("préparé le café", "utf-8", "cp1252"), ("die größere Tür", "utf-8", "cp1252"), ("café élève naïve", "latin-1", "cp437"), ("где 12 был новый дом", "cp1251", "latin-1")]
    bad = [t.encode(a).decode(b) for t, a, b in wrong]
    more = [w.encode("utf-8").decode("cp1252") for w in ("été", "naïve", "élève", "größere", "müde", "Gäste")] + [w.encode("latin-1").decode("cp437") for w in ("préparé", "élève", "déjà")]
    legit = ["ATENÇÃO NÃO ABRA", "À L’ÂGE", "ВНИМАНИЕ НЕТ"]
    rows = clean + bad[:3] + more + legit + ["lost caf�"]
    got = {r["line_no"]: r for r in garbled.repaired(spans(spark, rows)).collect()}
    first = len(clean)
    assert [got[first + i]["restored"] for i in range(3)] == [t for t, _, _ in wrong[:3]]
    assert got[len(rows) - 1]["lost"] and not set(range(first + 3 + len(more), len(rows) - 1)) & set(got)
    assert not set(range(first)) & set(got)


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp1256"), ("cp1256", "cp1252"), ("cp1251", "koi8_r"), ("cp1251", "cp1252"), ("utf-8", "cp1251")])
def test_every_transformation_goes_back(written, read):
    word = {"cp1256": "قديمي", "cp1251": "старый"}.get(written, "größeréñ")
    loose = word.encode(written).decode(read, "replace")
    if "�" not in loose:
        assert garbled.read_back(loose, written, read) == word
        read_as, written_as = ({(label, b) for side, label, b in garbled.encoded(w, 9, *garbled.encodings()) if side == s} for w, s in ((loose, "r"), (word, "w")))
        assert any(r == read and w == written and a == b for r, a in read_as for w, b in written_as)


def test_an_encoding_in_no_list_is_learned(spark):
    """Letters swapped as by an unknown table: the mapping is inferred by aligning twins, and applied to words without one."""
    swap = {"é": "Ŧ", "è": "Ħ", "ö": "Ŋ", "ü": "Ɖ", "ñ": "Ɣ"}
    clean = ["préparé dépassé étroit désolé isolé musée sévère mères pères frère après procès", "größere müde hölzerne schöne", "pequeño mañana español señal"] * 40
    wrong = ["".join(swap.get(c, c) for c in t) for t in clean[:3]]
    legit = ["preparе́ dépassé", "dé­passé mus​ée"] * 3
    got = {r["line_no"]: r["restored"] for r in garbled.repaired(spans(spark, clean + legit + wrong[:1])).collect()}
    assert got == {len(clean + legit): clean[0]}
    assert garbled.aligned("rencontrĦre", "rencontrère") == [("Ħ", "è")] and garbled.aligned("a√©b√®", "aébè") == [("√©", "é"), ("√®", "è")] and garbled.aligned("aéb", "acé") == []


def test_spans_of_many_runs(spark):
    """Nothing depends on the number of stretches of a span, nor on how many texts stand at one place of it."""
    words = [f"{a}{b}{c}щий" for a in "бвгд" for b in "аоуи" for c in "клмн"]
    clean = [" 1 ".join(random.Random(i).choices(words, k=30)) for i in range(60)]
    bad = " 1 ".join(words[:30]).encode("cp1251").decode("koi8_r")
    got = {r["line_no"]: r["restored"] for r in garbled.repaired(spans(spark, clean + [bad])).collect()}
    assert got == {60: " 1 ".join(words[:30])}


def test_garbled_odd_input(spark):
    assert garbled.found(spans(spark, [None, "", "plain", LONG])).count() == 0
    assert garbled.found(spans(spark, []).limit(0)).count() == 0
    again = spans(spark, ["caf�"]).union(spans(spark, ["caf�"]))
    assert garbled.found(again).count() == 1


# 3 ------------------------------------------------------------------------------------------------------------

PROSE = "The old tower stood near the river, and nobody in the town had seen it for most of the year. It was late when they came to the bridge."
LISTING = "the old tower, the grey bridge, the heavy stove, the narrow mill, the wooden gate, the silent market"
TABLE = "mill Drov | 4413 | - | 3153 | 22 | 9% tower Wex | 5703 | - | 3878 | 5888.5 | 3099"
JUNK = "]*+*[}}/{ |#{#=~% _/}_^ ~[>|+<= ]%]_|% ]]%^[#* ^[|+ +=]="


def test_prose_and_its_opposites(spark):
    rows = [(i, d, i, "p", t) for i, (d, t) in enumerate([(1, PROSE), (1, PROSE + " Again."), (2, LISTING), (2, LISTING), (3, TABLE), (4, JUNK), (5, "word " * 30), (6, PROSE), (6, LISTING), (7, None), (8, "")])]
    pages = spark.createDataFrame([(1, 0, 10), (1, 0, 10), (2, 0, None)], "doc_id bigint, page_no int, text_chars int")
    stats = {r["doc_id"]: r for r in quality.book_statistics(blocks(spark, rows), pages).collect()}
    assert {d: r["structure"] for d, r in stats.items() if d in (1, 2, 3, 4)} == {1: "prose", 2: "list", 3: "table", 4: "junk"}
    assert stats[1]["page_chars"] == 10 and stats[1]["pages"] == 1 and stats[8]["prose_share"] is None and 7 not in stats
    assert {r["doc_id"] for r in quality.found(blocks(spark, rows), pages).collect()} >= {2, 3, 4} and stats[1]["prose_share"] == 1.0
    assert quality.found(blocks(spark, []).limit(0), pages).count() == 0
    assert quality.book_statistics(blocks(spark, [(1, 1, 0, "p", "1." * 50_000), (2, 1, 1, "note", LONG)])).count() == 1


def test_divergence_is_zero_for_a_profile_itself(spark):
    cols = ["lang", *quality.CLASSES]
    p = quality.PROFILES["table"][0]
    row = spark.createDataFrame([("en", *map(float, p))], ", ".join(f"`{c}` {'string' if c == 'lang' else 'double'}" for c in cols))
    got = quality.classify_blocks(row).first()
    assert got["structure"] == "table" and abs(got["divergence"]) < 1e-9


def test_counts_of_a_text():
    import numpy as np

    texts = ["The cat, and the dog: 12.5% of 3 dogs. dog dog", "", "a | Wex | 9 ... 7", "他说了。", "x=1; y", "Chapter ..... 12 ,"]
    got = [dict(zip(quality._RAW, r)) for r in quality._counts(texts, quality.Tokens()).tolist()]
    assert got[0]["f_en"] == 4 and got[0]["number"] == 2 and got[0]["ends"] == 1 and got[0]["comma"] == 1 and got[0]["again"] == 1 and got[0]["capital"] == 0
    assert not any(got[1].values()) and got[2]["capital"] == 1 and got[2]["symbol"] == 2 and got[2]["leader"] == 1 and got[2]["number"] == 2
    assert got[3]["cjk"] == 3 and got[3]["f_zh"] == 2 and got[4]["mixed"] == 0 and got[5]["leader"] == 1
    slow = quality.Tokens()
    for token in ("word", "word.", "Wort;", "été,", "слово!", "کتاب؟", "کتاب،", "naïve:", "İx", "a", "é", "字", "字。", "ไป,", "x2.", "ß?", "ΑΒ.", "a=b", "-", "3.5%", "۱۲،", "Ⅷ", "x½", "a|b;", "...7", "می‌رود،", "é…"):
        row = slow.rows[slow[token]]
        assert list(map(int, row[8:16])) == [len(r.findall(token)) for r in slow.counted.values()], token
    one = quality._counts(texts, known := quality.Tokens())
    assert np.array_equal(one, np.concatenate([quality._counts([t], known) for t in texts]))


def test_profiles_are_learned(spark):
    """A corpus whose lists look unlike the starting ones: their centre moves to them."""
    rnd = random.Random(1)
    words = "mill tower bridge stove gate market wood".split()
    rows = [(i, i, i, "p", " ; ".join(rnd.choices(words, k=9)) if i % 2 else PROSE) for i in range(80)]
    features = quality.block_features(blocks(spark, rows))
    learned = quality.learned_profiles(features)
    assert any(lang == "en" and name == "prose" for _, name, lang, _ in learned) and learned != quality.START
    far = lambda p: quality.classify_blocks(features, p).groupBy("structure").agg(F.avg("divergence").alias("d"), F.count("*").alias("n")).collect()
    before, after = ({r["structure"]: r for r in far(p)} for p in (None, learned))
    assert after["list"]["n"] == after["prose"]["n"] == 40 and after["list"]["d"] < before["list"]["d"] / 2 and after["prose"]["d"] < before["prose"]["d"]


# 4 ------------------------------------------------------------------------------------------------------------

LINES = "doc_id bigint, page_no int, line_no int, text string, x0 double, site string, books int"


def test_repeated_lines_against_counting(spark):
    rnd = random.Random(2)
    texts = ["Page 1 of 9", "PAGE 7 OF 12", "© rights", "body a", "body b", "body c", "12", None, ""]
    rows = [(d, 0, n, rnd.choice(texts), 0.0, "x", 1) for d in range(30) for n in range(4)]
    rows += rows[:9]
    books = spark.createDataFrame([(d, "s1" if d < 12 else "s2" if d < 27 else None, "x") for d in range(29)] + [(0, "s1", "x")], "doc_id bigint, source string, text string")
    owner = {r["doc_id"]: r["source"] for r in books.collect()}
    key = lambda t: "".join(c for c in (t or "").lower() if unicodedata.category(c)[0] == "L")
    where = {}
    for d, _, _, t, *_ in rows:
        if d in owner and key(t):
            where.setdefault((owner[d], key(t)), set()).add(d)
    size = {s: sum(v == s for v in owner.values()) for s in set(owner.values())}
    often = {k for k, v in where.items() if len(v) >= 4 and len(v) >= size[k[0]] / 5}
    want = {(d, p, n) for d, p, n, t, *_ in rows if d in owner and (owner[d], key(t)) in often}
    table = spark.createDataFrame(rows, LINES)
    assert {tuple(r) for r in repeated.found(table, books).collect()} == want
    left = repeated.without_repeats(table, books)
    assert left.columns == table.columns and left.count() == sum((r[0], r[1], r[2]) not in want for r in rows)
    assert repeated.found(table.limit(0), books).count() == 0 and repeated.found(table, books.limit(0)).count() == 0


def test_frequent_runs(spark):
    rows = [(d, 0, n, t, 0.0, "x", 1) for d in range(8) for n, t in enumerate(["all rights", f"own {'abcdefgh'[d] * 3}", "share this", "follow us"])]
    rows += [(d, 1, 0, "share this", 0.0, "x", 1) for d in range(5)]
    books = spark.createDataFrame([(d, "s") for d in range(8)], "doc_id bigint, source string")
    got = repeated.frequent_sequences(spark.createDataFrame(rows, LINES), books)
    assert sorted((r["length"], r["support"]) for r in got.collect()) == [(1, 8)] * 3 + [(2, 8)] * 3 + [(3, 8)]
    long = [(d, 0, n, "line " + "abcdefghijklmnopqrst"[n] * 3, 0.0, "x", 1) for d in range(6) for n in range(20)]  # one pattern, not all parts of it
    got = repeated.frequent_sequences(spark.createDataFrame(long, LINES), books).collect()
    assert sorted((r["length"], r["support"]) for r in got) == [(1, 6)] * 20 + [(20, 6)]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_frequent_sequences_against_all_subsequences(spark, monkeypatch, broadcast_rows):
    """Gapped sequences of any length, by listing all of them; both ways to join."""
    from itertools import combinations

    monkeypatch.setattr(repeated, "BROADCAST_ROWS", broadcast_rows)
    rnd = random.Random(11)
    pages = {(d, p): rnd.choices("abcdef", k=rnd.randint(0, 5)) for d in range(14) for p in range(2)}
    rows = [(d, p, n, c * 3, 0.0, "x", 1) for (d, p), cs in pages.items() for n, c in enumerate(cs)]
    books = spark.createDataFrame([(d, "s" if d < 9 else None) for d in range(14)], "doc_id bigint, source string")
    support = {}
    for (d, _), cs in pages.items():
        for n in range(1, len(cs) + 1):
            for x in set(combinations(cs, n)):
                support.setdefault(("s" if d < 9 else None, x), set()).add(d)
    want = {k: len(v) for k, v in support.items() if len(v) >= 4}
    names = {r["h"]: r["c"] for r in spark.createDataFrame([(c,) for c in "abcdef"], "c string").select("c", F.xxhash64(F.repeat("c", F.lit(3))).alias("h")).collect()}
    rows_got = repeated.frequent_sequences(spark.createDataFrame(rows, LINES), books).collect()
    got = {(r["source"], tuple(names[h] for h in r["pattern"])): r["support"] for r in rows_got}
    assert len(got) == len(rows_got) and all(want[k] == n for k, n in got.items())

    def inside(x, y):
        it = iter(y)
        return all(c in it for c in x)

    assert all(any(s == s2 and n == n2 and inside(x, y) for (s2, y), n2 in got.items()) for (s, x), n in want.items())


# 5 ------------------------------------------------------------------------------------------------------------

SAME_LOOK = [
    ("ｔｈｅ cat", "the cat", True), ("café", "café", True), ("the cat", "the cat", True), ("c​at", "cat", True), ("сaр", "cар", True), ("ﬁsh", "fish", True),
    ("علي كتاب", "علی کتاب", True), ("می‌روم", "میروم", False), ("کتاب‌ من", "کتاب من", True), ("در‌خانه", "درخانه", True), ("ﺳﻼم", "سلام", True), ("⽊屋", "木屋", True), ("น้ำ", "น้ํา", True),
    ("ẹ́", "ẹ́", True), ("Cat", "cat", False), ("cafe", "café", False), ("cat 1", "cat 2", False), ("x²", "x2", False), ("ガ", "ガ", True),
]


def test_same_look(spark):
    table = spark.createDataFrame([(2 * i + k, t) for i, (a, b, _) in enumerate(SAME_LOOK) for k, t in enumerate((a, b))], "i int, text string")
    forms = {r["i"]: r["form"] for r in lookalike.unified(table).collect()}
    for i, (a, b, same) in enumerate(SAME_LOOK):
        assert (forms[2 * i] == forms[2 * i + 1]) == same, (a, b)


def test_forms_match_unicode(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("aeẹ́́̈oñ ـاآٓｆﬁ", k=rnd.randint(0, 10))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["form"] for r in lookalike.unified(table).collect()}
    for i, t in enumerate(texts):
        assert unicodedata.normalize("NFD", got[i]) == unicodedata.normalize("NFKD", t), (t, got[i])


def test_pairs_and_odd_input(spark):
    rows = [(1, 1, 0, "p", "the cat"), (2, 1, 1, "p", "ｔhe cat"), (3, 1, 2, "note", "the cat"), (4, 1, 3, "h1", "thе cat"), (5, 1, 4, "p", None), (6, 1, 5, "p", ""), (2, 1, 1, "p", "ｔhe cat"), (7, 1, 6, "p", LONG), (8, 1, 7, "p", LONG.replace("word", "wоrd")), (None, 1, 8, "p", "the cat"), (9, 1, 9, "p", "​"), (10, 1, 10, "p", "á" * 40_000)]
    got = {tuple(r) for r in lookalike.found(blocks(spark, rows)).collect()}
    assert got == {(1, 2), (2, 3), (7, 8), (6, 9)}
    assert lookalike.found(blocks(spark, []).limit(0)).count() == 0
    out = lookalike.unified(blocks(spark, rows))
    assert out.count() == len(rows) and out.where("text is null and form is not null").count() == 0


def test_classes_against_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    variants = ["the cat sat", "ｔhe cat sat", "the​ cat sat", "thе cаt sat", "café x", "café x", "alone"]
    rows = [(i, 1, i, "p", rnd.choice(variants)) for i in range(60)] + [(3, 1, 3, "p", "again"), (None, 1, 9, "p", "the cat sat")]
    table = blocks(spark, rows)
    pairs = {tuple(r) for r in lookalike.found(table).collect()}
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    for few in (200_000, 0):
        monkeypatch.setattr(repeated, "BROADCAST_ROWS", few)
        got = {r["block_id"]: r for r in lookalike.classes(table).collect()}
        assert {i: r["links"] for i, r in got.items()} == {i: len(v) for i, v in links.items()}
        assert all(r["class_id"] == min([i, *links[i]] + [j for k in links[i] for j in links[k]]) for i, r in got.items())
        assert {tuple(r) for r in lookalike.found(table).collect()} == pairs


# 6 ------------------------------------------------------------------------------------------------------------

def test_pieces_go_back_to_the_text(spark):
    rnd = random.Random(6)
    texts = {1: ["Sentence one is here. " * 30 for _ in range(8)], 2: ["x" * 5000], 3: ["字。" * 1500], 4: ["short"], 5: ["a b " * 400, "", "c" * 300], 6: [LONG], 7: ["é́" * 1500]}
    rows = [(100 * d + n, d, n, "p", t) for d, v in texts.items() for n, t in enumerate(v)]
    rnd.shuffle(rows)
    table = blocks(spark, rows + rows[:3] + [(1, 4, 9, "p", None)])
    pieces = split.split_chapters(table).orderBy("doc_id", "piece_no").collect()
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {d for d, v in texts.items() if len("\n".join(v)) > 2000}
    for d, rs in by.items():
        whole = "\n".join(texts[d])
        assert "".join(r["body"] for r in rs) == whole and all(r["chapter_chars"] == len(whole) for r in rs)
        for k, r in enumerate(rs):
            assert len(r["overlap"]) + len(r["body"]) <= 2000 and len(r["overlap"]) <= 200
            assert whole[r["start_pos"] :].startswith(r["body"]) and whole[: r["start_pos"]].endswith(r["overlap"])
            assert (k == 0) == (r["overlap"] == "")
    assert all(r["body"].rstrip().endswith(".") for r in by[1])
    assert split.found(blocks(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_chapters(table, 100, 100)


@pytest.mark.parametrize("section", [1, 3, 512])
def test_sections_leave_no_trace(spark, monkeypatch, section):
    """Chapters around and far over the size of a section are cut as by one expression over all of their text."""
    monkeypatch.setattr(split, "SECTION", section)
    rnd = random.Random(8)
    parts = ["Short.", "A sentence is here. " * 12, "x" * 700, "字。" * 90, "", "word " * 500]
    sizes = {1: 511, 2: 512, 3: 513, 4: 1400, 5: 3} if section == 512 else {1: 14, 2: 5}
    texts = {d: [rnd.choice(parts) for _ in range(n)] for d, n in sizes.items()}
    rows = [(10_000 * d + n, d, n, "p", t) for d, v in texts.items() for n, t in enumerate(v)]
    got = {}
    for r in split.split_chapters(blocks(spark, rows)).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r["doc_id"], []).append(r)
    one = spark.createDataFrame([(d, "\n".join(v)) for d, v in texts.items()], "d int, t string")
    want = {r["d"]: r["p"] for r in one.select("d", F.regexp_extract_all("t", F.lit(split.piece_pattern(1800)), F.lit(0)).alias("p")).collect()}
    for d, v in texts.items():
        if len("\n".join(v)) <= 2000:
            assert d not in got
            continue
        assert [r["body"] for r in got[d]] == want[d] and [r["piece_no"] for r in got[d]] == list(range(len(want[d])))
        whole = "\n".join(v)
        for r in got[d]:
            assert whole[r["start_pos"] :].startswith(r["body"]) and whole[: r["start_pos"]].endswith(r["overlap"]) and len(r["overlap"]) <= 200


# 7 ------------------------------------------------------------------------------------------------------------

ITEM = "The wooden script left the wooden branch while the grey cache kept the heavy container (Lirwick, 4903). The northern market repaired the narrow ferry so the careful ledger held the wooden valley (Yarsund, 1603). The empty query reached the silent compiler."
DOCS = "doc_id bigint, text string, lang string, source string, share double, words int"


def test_leaks(spark):
    words = ITEM.split()
    half = " ".join(words[3 : 3 + len(words) // 2])
    edited = " ".join(w if k % 9 else "other" for k, w in enumerate(words))
    shuffled = sorted(words, key=lambda w: hash(w[::-1]) % 97)
    texts = {1: "Before. " + ITEM + " After.", 2: half.upper().replace(" ", "\n"), 3: edited, 4: " ".join(words[:8]), 5: " ".join(sorted(words)), 6: "Read this carefully.", 7: None, 8: "", 9: "<p>" + " ".join(f"<b>{w}</b>" for w in words) + "</p>", 10: LONG + half, 11: (ITEM + " ") * 300}
    docs = spark.createDataFrame([(d, t, "en", "s", 0.0, 1) for d, t in texts.items()] + [(1, texts[1], "en", "s", 0.0, 1), (None, ITEM, "", "", 0.0, 1)], DOCS)
    items = spark.createDataFrame([(1, "Read this carefully.\n" + ITEM), (1, "Read this carefully.\n" + ITEM), (2, None), (3, "too short"), (4, "")], "item_id bigint, text string")
    assert {tuple(r) for r in leaks.found(docs, items).collect()} == {(d, 1) for d in (1, 2, 3, 9, 10, 11)}
    assert leaks.found(docs.limit(0), items).count() == 0 and leaks.found(docs, items.limit(0)).count() == 0
    del shuffled


def test_blocks_find_every_fingerprint_within_the_radius():
    import numpy as np

    rnd = np.random.default_rng(1)
    for words in (60, 10, 3):
        index = leaks.Index([(1, [f"w{i}" for i in range(words)])])
        (size,) = index.sizes
        near = index.by_size[size][0].copy()
        for i in range(len(near)):
            for b in rnd.choice(64, leaks.RADIUS, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        w, _ = index.hits(near, size)
        assert set(w) >= set(range(len(near)))


def test_fingerprints_against_counting():
    import numpy as np

    h = leaks._Hashes().of([f"w{i % 9}" for i in range(40)])
    p = leaks._pairs(h)
    for size in range(1, 8):
        for i, f in enumerate(leaks.fingerprints(h, size)):
            votes = [int(x) for x in [*h[i : i + size], *p[i : i + size - 1]]]
            assert int(f) == sum((sum(v >> b & 1 for v in votes) * 2 > len(votes)) << b for b in range(64))
    assert leaks.fingerprints(h[:0], 3).size == 0 and len(leaks.fingerprints(h[:3], 3)) == 1


def test_leaks_against_aligning_everything(spark):
    """Every item against every post by alignment alone, and both ways that items travel."""
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = {i: rnd.choices(vocabulary, k=rnd.choice([3, 5, 8, 12, 16, 17, 40, 90])) for i in range(24)}
    texts = {}
    for d in range(160):
        q = items[d % 24]
        n = max(1, round(len(q) * rnd.choice([0.2, 0.45, 0.6, 1.0])))
        a = rnd.randint(0, len(q) - n)
        part = list(q[a : a + n])
        if rnd.random() < 0.4:
            part[8::9] = ["edited"] * len(part[8::9])
        texts[d] = " ".join(rnd.choices(vocabulary, k=30) + part + rnd.choices(vocabulary, k=30))
    docs = spark.createDataFrame([(d, t, "en", "s", 0.0, 1) for d, t in texts.items()], DOCS)
    table = spark.createDataFrame([(i, " ".join(q)) for i, q in items.items()], "item_id bigint, text string")
    want = set()
    for d, t in texts.items():
        for i, q in items.items():
            m, a, b = leaks.coverage(q, leaks.words(t))
            if m >= leaks.MIN_SHARE * len(q) - 1e-9 and m >= leaks.MIN_DENSITY * (b - a):
                want.add((d, i))
    got = {tuple(r) for r in leaks.found(docs, table).collect()}
    long = {(d, i) for d, i in want if len(items[i]) > 5}  # of the shortest, chance words apart from each other make a passage
    assert got <= want and len(got & long) >= 0.99 * len(long)
    assert {tuple(r) for r in leaks.leaks(docs, table, max_item_bytes=0).select("doc_id", "item_id").collect()} == got


def test_a_long_item_needs_little_memory():
    import tracemalloc

    q = [f"w{i % 3000}x{i}" for i in range(5000)]
    index = leaks.Index([(1, q)])
    tracemalloc.start()
    got = leaks._search([(7, ["before"] * 20_000 + q[:3000] + ["after"] * 20_000)], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(7, 1, 0.6, 3000)] and peak < 200e6


def test_coverage_against_longest_common_run():
    assert leaks.coverage(list("abcdef"), list("xxabcdefyy"))[0] == 6 and leaks.coverage(list("abcdef"), list("zzz"))[0] == 0
    assert leaks.coverage("a b c d e f g h".split(), "a b c d X e f g h".split()) == (8, 0, 9)


# 8 ------------------------------------------------------------------------------------------------------------

def posts(spark, spec):
    return spark.createDataFrame([(i, "token " * n, "en", s, 0.0, 1) for i, (s, n) in enumerate(spec)], DOCS)


def test_shares_and_caps(spark):
    docs = posts(spark, [("a", 10)] * 300 + [("b", 10)] * 40 + [("other", 10)] * 20 + [(None, 10)] * 5)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    draw, report = mixture.mixture(docs, targets)
    rep = {r["source"]: r for r in report.collect()}
    assert abs(rep["a"]["share"] - 5 / 9) < 0.01 and abs(rep["b"]["share"] - 4 / 9) < 0.01 and rep["none"]["share"] == 0
    most = draw.groupBy("source").agg(F.max("repeats").alias("m"), F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()
    assert {r["source"]: r["m"] for r in most} == {"a": 1, "b": 3} and {r["source"]: r["n"] for r in most} == {s: rep[s]["drawn_tokens"] for s in ("a", "b")}
    assert draw.count() == draw.select("doc_id").distinct().count()
    _, big = mixture.mixture(docs, targets, total=1e7)
    assert all(r["most_repeats"] <= r["max_repeats"] for r in big.collect())
    empty = mixture.mixture(docs.limit(0), targets)
    assert empty[0].count() == 0 and empty[1].count() == 3
    assert mixture.mixture(docs, targets.limit(0))[1].count() == 0
    odd = spark.createDataFrame([("a", None, None), ("b", 1.0, 1), (None, 1.0, 1)], targets.schema)
    assert {r["source"]: r["drawn_tokens"] > 0 for r in mixture.mixture(docs, odd)[1].collect()} == {"a": False, "b": True}


def test_exponent():
    w, a, total = mixture.weights({"a": 100, "b": 900}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1})
    assert a == 0 and w == {"a": 0.5, "b": 0.5} and total == 200
    w, a, _ = mixture.weights({"a": 100, "b": 900}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, total=400)
    assert 0 < a < 1 and w["a"] * 400 <= 100.001 and abs(w["a"] * 400 - 100) < 0.01
    w, a, total = mixture.weights({"a": 100, "b": 900}, {"a": 0.5, "b": 0.5}, {"a": 9, "b": 9}, entropy=0.8)
    assert 0 < a < 1 and abs(w["a"] / w["b"] - (1 / 9) ** a) < 1e-9 and total == pytest.approx(min(900 / w["a"], 8100 / w["b"]))
    assert mixture.weights({"a": 100, "b": 900}, {"a": 0.5, "b": 0.5}, {"a": 9, "b": 9}, entropy=2.0)[1] == 0.0
    assert mixture.weights({}, {"a": 1.0}, {"a": 1}) == ({}, 0.0, 0.0)


def test_blocks_follow_the_rows(spark, monkeypatch):
    docs = posts(spark, [("a", 3)] * 500)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    whole = {tuple(r) for r in mixture.mixture(docs, targets, total=900)[0].collect()}
    monkeypatch.setattr(mixture, "BLOCK_POSTS", 2)
    assert sum(r[2] for r in whole) <= 900 and sum(r["tokens"] for r in mixture.mixture(docs, targets, total=900)[0].collect()) > 890


# 9 ------------------------------------------------------------------------------------------------------------

SEEDS = {
    "en": "the old tower near the river was open and nobody had seen the grey bridge before the winter while they were still talking about it",
    "fr": "le vieux moulin près de la rivière était ouvert et personne n’avait vu le pont gris avant l’hiver pendant que nous parlions encore",
    "de": "der alte Turm am Fluss war offen und niemand hatte die graue Brücke vor dem Winter gesehen während sie noch darüber sprachen",
    "ru": "старый дом у реки был открыт и никто не видел серый мост до зимы пока они всё ещё говорили об этом в городе",
}


def sentences_of(lang, n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(SEEDS[lang].split(), k=12)).capitalize() + "." for _ in range(n)]


def test_held_out_languages(spark):
    rows = [(i, "\n\n".join(sentences_of(k, 3, i * 7 + j)), k if i % 10 else "en", "s", 0.0, 1) for j, k in enumerate(SEEDS) for i in range(j * 100, j * 100 + 40)]
    m = language.fit(spark.createDataFrame(rows, DOCS))
    tests = [(k, s) for k in SEEDS for s in sentences_of(k, 50, 99)]
    right = sum(m.classify(s, 0.0)[0] == k for k, s in tests)
    assert right >= 0.97 * len(tests)
    mixed = sentences_of("en", 1, 1)[0] + "\n\n" + sentences_of("fr", 1, 2)[0] + "\n\n```\nfor x in y: print(x)\n```\nhttps://a.example/le/la/les"
    docs = spark.createDataFrame([(1, mixed, "en_US", "s", 0.0, 1), (1, mixed, "en_US", "s", 0.0, 1), (2, None, "en", "s", 0.0, 1), (3, "", None, "s", 0.0, 1), (4, "12 345", "xx", "s", 0.0, 1), (5, sentences_of("de", 1, 3)[0], "DEU", "s", 0.0, 1), (6, " ".join(sentences_of("ru", 3000, 4)), "", "s", 0.0, 1), (None, sentences_of("de", 1, 5)[0], "en", "s", 0.0, 1)], DOCS)
    segs = language.segments(docs, m).collect()
    assert [(r["doc_id"], r["lang"]) for r in sorted(segs, key=lambda r: (r["doc_id"] or 99, r["segment_no"])) if r["doc_id"] in (1, 4, 5, 6)] == [(1, "en"), (1, "fr"), (4, None), (5, "de"), (6, "ru")]
    one = next(r for r in segs if r["doc_id"] == 1 and r["lang"] == "fr")
    assert mixed[one["start_pos"] : one["end_pos"]] == mixed.split("\n\n")[1] and one["confidence"] > 0
    assert language.segments(docs.limit(0), m).count() == 0


def test_code_is_learned(spark):
    """Lines like those that posts mark as code are code where nothing marks them; prose with a brace or an equals sign is prose."""
    rnd = random.Random(3)
    code = lambda: rnd.choice(["for (int i = 0; i < %d; i++) { total[i] = count(i); }", "const total = await count(%d).value;", "SELECT total, count(*) FROM items WHERE total >= %d", "def total(count): return [x for x in count if x > %d]"]) % rnd.randint(1, 999)
    rows = [(i, f"{sentences_of(k, 1, i)[0]}\n\n```\n{code()}\n{code()}\n```\n\n{sentences_of(k, 1, i + 9)[0]}", k, "s", 0.0, 1) for j, k in enumerate(SEEDS) for i in range(j * 100, j * 100 + 40)]
    m = language.fit(spark.createDataFrame(rows, DOCS))
    assert sum(m.classify(code())[0] == language.CODE for _ in range(40)) >= 38
    for text in ("we had seen the old tower { at } the river before the winter", "nobody = nobody, they were still talking about it near the river", "SELECT the old tower near the river and nobody had seen it before the winter"):
        assert m.classify(text)[0] == "en"
    long = ("x" * 5000 + "\n") * 3 + sentences_of("fr", 1, 3)[0]
    assert language.segments(spark.createDataFrame([(1, long, "en", "s", 0.0, 1)], DOCS), m).where("lang = 'fr'").count() == 1


def test_labels(spark):
    more = spark.createDataFrame([(g,) for g in ("swe", "pol", "iw", "cym", "wel", "en_US.UTF-8", "qq", "qqq", "srp", "ces", "NLD")], "l string")
    assert [r["x"] for r in more.select(language.label_language(F.col("l")).alias("x")).collect()] == ["sv", "pl", "he", "cy", "cy", "en", "qq", None, "sr", "cs", "nl"]
    given = ["en", "EN", "en-US", "en_us", "eng", "FRE", "ger", "zh_CN", "und", "xx", "unknown", "", None, "fas", "english", "zho-Hans"]
    rows = spark.createDataFrame([(g,) for g in given], "l string")
    got = [r["x"] for r in rows.select(language.label_language(F.col("l")).alias("x")).collect()]
    assert got == ["en", "en", "en", "en", "en", "fr", "de", "zh", None, None, None, None, None, "fa", None, "zh"]


def test_unlabelled_corpus(spark):
    docs = spark.createDataFrame([(1, "some words without any label at all", None, "s", 0.0, 1)], DOCS)
    assert language.found(docs).count() == 0 and language.document_languages(docs).count() == 1


@pytest.mark.parametrize("text, expected", [
    ("او رفت. ر.ک. ص. ۱۲، که آمد. نامه رسید.", ["او رفت.", "ر.ک. ص. ۱۲، که آمد.", "نامه رسید."]),
    ("月台遮住了⼭⾕。沃拉姆说好。", ["月台遮住了⼭⾕。", "沃拉姆说好。"]),
    ("彼が運んた゛。次の日。", ["彼が運んた゛。", "次の日。"]),
    ("It fell. vel­tek.txt names it.", ["It fell.", "vel­tek.txt names it."]),
    ("谁会相信？！ｐｏｍ.ｔｘｔ里有４个！", ["谁会相信？！", "ｐｏｍ.ｔｘｔ里有４个！"]),
])
def test_sentences_in_disguise(text, expected):
    """With the statistics that a Persian corpus gives, and with characters that only look like others."""
    stats = {"pure": {("fa", "ک"), ("fa", "ص")}, "short": set(), "on": set(), "number": {("fa", ""), ("en", "")}}
    assert [text[a:b] for a, b in sentences.split(text, stats)] == expected


def test_empty_tables_everywhere(spark):
    """Every operator gives an empty result, or a report of nothing, for tables without rows and for tables of nulls alone."""
    none = blocks(spark, []).limit(0)
    nulls = spark.createDataFrame([(None,) * 9] * 2, BLOCK)
    lines, books = spark.createDataFrame([], LINES), spark.createDataFrame([], "doc_id bigint, source string")
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for table in (none, nulls):
        for made in (sentences.found(table), sentences.checks(table), lookalike.classes(table), lookalike.found(table), split.split_chapters(table), split.checks(table), quality.found(table, spark.createDataFrame([], "doc_id bigint, page_no int, text_chars int"))):
            assert made.count() == 0
    null_lines = spark.createDataFrame([(None,) * 7] * 2, LINES)
    for table in (lines, null_lines):
        assert repeated.frequent_sequences(table, books).count() == 0 and repeated.found(table, books).count() == 0 and repeated.without_repeats(table, books).count() == table.count()
    null_docs, null_items = spark.createDataFrame([(None,) * 6] * 2, DOCS), spark.createDataFrame([(None, None)], "item_id bigint, text string")
    for d, i in ((docs, items), (null_docs, null_items)):
        assert leaks.leaks(d, i).count() == 0 and leaks.leaks(d, i, max_item_bytes=-1).count() == 0
        draw, report = mixture.tempered(d, targets)
        assert draw.count() == 0 and report.first()["share"] == 0.0 and mixture.checks(d, targets).count() == 3
        assert language.found(d).count() == 0 and language.segments(d).count() == 0
    null_spans = spark.createDataFrame([(None,) * 9] * 2, SPAN)
    for table in (spans(spark, []).limit(0), null_spans):
        assert garbled.found(table).count() == 0 and garbled.repaired(table).count() == 0


def test_hot_groups_keep_their_results(spark):
    """A third of all rows under one key: the same rows as from the key's parts."""
    rows = [(i, 1 if i % 3 == 0 else i, i, "p", ("the cat sat", "ｔhe cat sat", "thе cat sat", f"text {i}")[i % 4]) for i in range(240)]
    table = blocks(spark, rows)
    by = {}
    for i, *_, t in rows:
        by.setdefault(t, []).append(i)
    a, b, c = (by[t] for t in ("the cat sat", "ｔhe cat sat", "thе cat sat"))
    want = {tuple(sorted((x, y))) for p, q in ((a, b), (a, c), (b, c)) for x in p for y in q}
    assert {tuple(r) for r in lookalike.found(table).collect()} == want
    got = {r["block_id"]: (r["class_id"], r["links"], r["texts"]) for r in lookalike.classes(table).collect()}
    assert got == {i: (min(a + b + c), len(a + b + c) - len(own), 3) for own in (a, b, c) for i in own}


# Made corpora of which the truth is known: recall and precision ------------------------------------------------

def measured(got, want):
    return len(got & want) / len(want), len(got & want) / len(got)


def test_sentences_of_a_made_corpus(spark):
    rnd = random.Random(21)
    names, nouns = ["Smith", "Wexlund", "Halkin", "Bruvian"], "tower bridge market river valley gate ledger orchard".split()
    forms = [
        "According to Dr. {n} the old {a} was near the {b}.", "Nobody saw the {a} on p. {k} of the book!", "It cost {k}.5 coins, and the {b} was open.", "“The {a} fell. It was late,” said {n}.",
        "They bought ropes, a {a}, a {b}, etc.", "Was it the {a} of the {b}?", "The {a} (see vol. {k}) stood there ... or so it seemed.", "In {k} the file {a}.txt named the {b}.",
    ]
    rows, want = [], set()
    for i in range(600):
        parts = [rnd.choice(forms).format(n=rnd.choice(names), a=rnd.choice(nouns), b=rnd.choice(nouns), k=rnd.randint(2, 900)) for _ in range(rnd.randint(1, 6))]
        at = 0
        for p in parts:
            want.add((i, 0, at, at + len(p)))
            at += len(p) + 1
        rows.append((i, i, 0, "p", " ".join(parts)))
    recall, precision = measured({tuple(r) for r in sentences.found(blocks(spark, rows)).collect()}, want)
    assert recall >= 0.99 and precision >= 0.99


def test_garbled_spans_of_a_made_corpus(spark):
    rnd = random.Random(22)
    words = ["préparé", "dépassé", "étroit", "désolé", "isolé", "musée", "sévère", "größere", "müde", "hölzerne", "schöne", "pequeño", "mañana", "español", "señal", "старый", "новый", "город", "дерево", "молчит", "река", "дом"]
    ways = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1251", "koi8_r"), ("cp1252", "cp437")]
    texts, want, meant = [], set(), {}
    for i in range(1500):
        t = " ".join(rnd.choices(words, k=6)) + f" {rnd.randint(1, 99)} a"
        if i % 10 == 0:
            a, b = rnd.choice(ways)
            try:
                bad = t.encode(a).decode(b)
            except (UnicodeEncodeError, UnicodeDecodeError):
                bad = t.encode("utf-8").decode("mac_roman")
            want.add(i)
            meant[i] = t
            t = bad
        texts.append(t)
    got = {r["line_no"]: r["restored"] for r in garbled.repaired(spans(spark, texts)).collect()}
    recall, precision = measured(set(got), want)
    assert recall >= 0.99 and precision >= 0.99 and sum(got[i] == meant[i] for i in want & set(got)) >= 0.9 * len(want)


def test_books_of_a_made_corpus(spark):
    rnd = random.Random(23)
    nouns = "tower bridge market river valley gate ledger orchard mill stove".split()
    prose = lambda: f"The old {rnd.choice(nouns)} stood near the {rnd.choice(nouns)}, and nobody in the town had seen it for most of the year. It was late when they came to the {rnd.choice(nouns)}."
    other = [
        lambda: ", ".join(f"the {rnd.choice(nouns)}" for _ in range(9)), lambda: " | ".join(f"{rnd.choice(nouns)} {rnd.randint(1, 9999)}" for _ in range(8)), lambda: "".join(rnd.choices("]*+[}/{|#=~%_^>< ", k=60)),
        lambda: " ".join(f"{rnd.choice(nouns).title()} ..... {rnd.randint(1, 300)}" for _ in range(6)), lambda: f"{rnd.choice(nouns)} " * 20,
    ]
    rows, want = [], set()
    for d in range(120):
        odd = d % 4 == 0
        want |= {d} if odd else set()
        rows += [(100 * d + i, d, i, "p", (rnd.choice(other) if (i < 9 if odd else i < 2) else prose)()) for i in range(12)]
    pages = spark.createDataFrame([], "doc_id bigint, page_no int, text_chars int")
    recall, precision = measured({r["doc_id"] for r in quality.found(blocks(spark, rows), pages).collect()}, want)
    assert recall >= 0.95 and precision >= 0.95
