"""Layout: block rules against a sequential builder, bands against a fold, fonts, packages, streaming."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from varaq.operators import blocks as B
from varaq.operators import fonts as FT
from varaq.operators import geometry as G
from varaq.operators import layout as L
from varaq.operators import outline as O
from varaq.operators import package
from varaq.operators import report as RP
from varaq.plans import pipeline as PL
from varaq.sources import readers as RD
from varaq.sources.schemas import FONTS, PAGES, SPANS


def page(spark, *specs, doc=1, height=842.0):
    """Spans of one page from (text, size, font, x1, top)."""
    rows = [(doc, 0, i, 0, "s", t, s, f, 60.0, top, x1, top + 15.0) for i, (t, s, f, x1, top) in enumerate(specs)]
    return spark.createDataFrame(rows, SPANS), spark.createDataFrame([(doc, 0, 595.0, height, None)], PAGES)


def test_indent_and_gap_open_paragraphs(spark):
    spans, pages = page(spark, ("یک " * 20, 12.0, "R", 500.0, 100.0), ("دو " * 20, 12.0, "R", 530.0, 118.0), ("سه " * 20, 12.0, "R", 500.0, 145.0), ("چهار " * 20, 12.0, "R", 530.0, 163.0))
    got = B.build(spans, pages).orderBy("block_no").collect()
    assert [(b["kind"], b["first_line_indent_em"], b["space_before_em"]) for b in got] == [("p", 2.5, 0.0), ("p", 2.5, 0.75)]


@pytest.mark.parametrize("keep, kinds", [(True, ["p", "note"]), (False, ["p"])])
def test_notes_are_kept_or_dropped_never_prose(spark, keep, kinds):
    spans, pages = page(spark, ("متن " * 30, 12.0, "R", 530.0, 120.0), ("یادداشت " * 5, 8.0, "R", 530.0, 700.0))
    assert [b["kind"] for b in B.build(spans, pages, keep).orderBy("block_no").collect()] == kinds


def test_heading_levels_and_style_runs(spark):
    spans, pages = page(spark, ("کتاب بزرگ من", 22.0, "X-Bold", 400.0, 60.0), ("متن " * 30, 12.0, "X-Regular", 530.0, 100.0), ("بخش کوچک من", 17.0, "X-Bold", 400.0, 160.0), ("متن " * 30, 12.0, "X-Italic", 530.0, 200.0))
    got = B.style_runs(B.build(spans, pages)).orderBy("block_no").collect()
    assert [b["kind"] for b in got] == ["h1", "p", "h2", "p"]
    assert got[0]["styled"][0]["bold"] and got[3]["styled"][0]["italic"]


def test_bands_are_a_fold(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for p in range(40):
        segs = [(round(rnd.uniform(0, 30), 1), n) for n in range(rnd.randint(1, 9))]
        rows += [(1, p, n, n, 1, "x", 0.0, 1.0, y - 1, y) for y, n in segs]
        band, anchor = -1, None
        for y, n in sorted(segs, key=lambda s: -s[0]):
            if anchor is None or anchor - y > 4.0:
                band, anchor = band + 1, y
            want[(p, n)] = band
    s = spark.createDataFrame(rows, "doc_id bigint, page_no int, seg_no int, loc int, len int, text string, x0 double, x1 double, y0 double, y1 double")
    assert {(r["page_no"], r["seg_no"]): r["band"] for r in G.bands(s).collect()} == want


def test_contained_segments_against_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(1, p, n, rnd.randint(0, 12), rnd.randint(1, 8)) for p in range(60) for n in range(rnd.randint(1, 8))]
    def inside(a, b):
        return b[3] <= a[3] and a[3] + a[4] <= b[3] + b[4] and (b[4] > a[4] or b[2] < a[2])
    want = {r[1:3] for r in rows if not any(o[1] == r[1] and o[2] != r[2] and inside(r, o) for o in rows)}
    s = spark.createDataFrame(rows, "doc_id bigint, page_no int, seg_no int, loc int, len int")
    assert {(r["page_no"], r["seg_no"]) for r in G.without_contained(s).collect()} == want


def test_word_space_from_the_gap(spark):
    cols = "doc_id bigint, page_no int, seg_no int, loc int, len int, text string, font string, size double, x0 double, x1 double, band int"
    rows = [(1, 0, 0, 0, 3, "نام", "F", 12.0, 100.0, 120.0, 0), (1, 0, 1, 3, 2, "دو", "F", 12.0, 80.0, 96.0, 0), (1, 0, 2, 5, 1, "،", "F", 12.0, 60.0, 70.0, 0), (1, 0, 3, 6, 3, "a\nb", "F", 12.0, 50.0, 59.0, 0)]
    got = G.band_spans(spark.createDataFrame(rows, cols)).orderBy("span_no").collect()
    assert [r["text"] for r in got] == ["نام", " ", "دو", "،", "a b"]


def test_styles_inside_a_segment(spark):
    cols = "doc_id bigint, page_no int, seg_no int, loc int, x0 double, x1 double, band int, runs array<struct<text:string,size:double,font:string>>"
    rows = [
        (1, 0, 0, 0, 100.0, 120.0, 0, [("a", 12.0, "F"), ("b\n", 12.0, "F"), ("\nc", 12.0, "G"), ("d", 10.0, "G")]),
        (1, 0, 1, 6, 80.0, 96.0, 0, [("x", 12.0, "F"), ("\ny", 12.0, "B"), ("\n", 12.0, None), ("z", 12.0, "B")]),
        (1, 0, 2, 9, 10.0, 20.0, 0, [("\n", 12.0, "F")]), (1, 0, 3, 9, 10.0, 20.0, 0, [("«", 12.0, "F")]),
    ]
    got = G.band_spans(spark.createDataFrame(rows, cols)).orderBy("span_no").collect()
    assert [(r["text"], r["size"], r["font"]) for r in got] == [("ab", 12.0, "F"), ("c", 12.0, "G"), ("d", 10.0, "G"), (" ", 10.0, ""), ("x ", 12.0, "F"), ("y z", 12.0, "B"), ("«", 12.0, "F")]
    page = spark.createDataFrame([(1, 0, [("ab\n \nc", 12.0, "F"), ("d", 12.0, "F"), ("e\n", 9.0, None)])], "doc_id bigint, page_no int, runs array<struct<text:string,size:double,font:string>>")
    assert sorted(tuple(r)[2:] for r in G.newline_spans(page).collect()) == [(0, 0, "ab", 12.0, "F"), (2, 0, "cd", 12.0, "F"), (2, 1, "e", 9.0, "")]
    assert G.newline_spans(page.limit(0)).count() == 0


def test_outline_parents_at_random(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for d in range(80):
        levels = [rnd.randint(1, 3) for _ in range(rnd.randint(1, 12))]
        stack = []
        for i, k in enumerate(levels):
            while stack and levels[stack[-1]] >= k:
                stack.pop()
            want[(d, i)] = (stack[-1] if stack else None, len(stack))
            stack.append(i)
        rows += [(d, i, k) for i, k in enumerate(levels)]
    got = O.nested(spark.createDataFrame(rows, "doc_id bigint, entry_no int, level int")).collect()
    assert {(r["doc_id"], r["entry_no"]): (r["parent"], r["depth"]) for r in got} == want


def _stored(spark, kinds):
    return spark.createDataFrame([(1, i, k, 0, 0, f"t{i}", None, None) for i, k in enumerate(kinds)], "doc_id bigint, block_no int, kind string, level int, page_no int, text string, first_line_indent_em double, space_before_em double")


@pytest.mark.parametrize("kinds, cut, chapters", [
    (["p", "p"], 0, [1, 1]), (["h1", "p", "h2", "p", "h2"], 2, [1, 1, 2, 2, 3]),
    (["h1", "p", "h1"], 1, [1, 1, 2]), (["p", "h1", "h1"], 1, [1, 2]), (["p", "p", "h3"], 3, [1, 1, 2]),
])
def test_chapter_cuts(spark, kinds, cut, chapters):
    got = O.chapters(_stored(spark, kinds)).orderBy("block_no").collect()
    assert {r["cut"] for r in got} == {cut} and [r["chapter"] for r in got] == chapters


def test_fonts(spark):
    rows = [("/f/A-Bold.ttf", "A", 90, 5, "SIL Open Font License"), ("/f/A.ttf", "A", 80, 9, "see scripts.sil.org/OFL"), ("/f/V.ttf", "Vazir X", 50, 1, None), ("/f/h.ttf", ".Hidden", 99, 9, ""), ("/f/L.ttf", "L", 39, 9, "")]
    fam = FT.families(spark.createDataFrame(rows, FONTS))
    got = {r["family"]: r for r in fam.collect()}
    assert set(got) == {"A", "Vazir X"} and got["A"]["bold"] == "/f/A-Bold.ttf" and got["A"]["regular"] == "/f/A.ttf"
    assert got["A"]["redistributable"] and not got["Vazir X"]["redistributable"] and got["Vazir X"]["rank"] == 1
    names = spark.createDataFrame([("a",), ("vaz",), ("zzz",), (None,)], "wanted string")
    assert {r["wanted"]: r["family"] for r in FT.pick(fam, names).collect()} == {"a": "A", "vaz": "Vazir X", "zzz": "Vazir X", None: "Vazir X"}


def test_package(spark):
    titles = spark.createDataFrame([(1, "کتاب", "من")], "doc_id bigint, title string, author string")
    made = PL.books(_stored(spark, ["h1", "p", "h2", "note", "h1"]), titles).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(made["epub"])))
    first = z.infolist()[0]
    assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED) and z.infolist()[-1].filename == "OEBPS/content.opf"
    opf, ncx, nav = (z.read(f"OEBPS/{n}").decode() for n in ("content.opf", "toc.ncx", "nav.xhtml"))
    assert 'page-progression-direction="rtl"' in opf and opf.split("urn:uuid:")[1][:36] == ncx.split("urn:uuid:")[1][:36]
    import xml.etree.ElementTree as ET

    for n in z.namelist():
        if n.endswith((".xhtml", ".ncx", ".opf", ".xml")):
            ET.fromstring(z.read(n))
    assert nav.count("<li>") == 3 and "text/ch002.xhtml#h3" in nav
    assert 'class="note"' in z.read("OEBPS/text/ch001.xhtml").decode()
    book = opf.split('<dc:identifier id="bookid">')[1].split("</dc:identifier>")[0]
    import uuid

    assert book == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'document:1')}" and f'name="dtb:uid" content="{book}"' in ncx
    assert '<meta name="cover"' not in opf and "direction:" not in z.read("OEBPS/style/book.css").decode() and "<guide" not in opf
    names = {i.attrib["href"] for i in ET.fromstring(z.read("OEBPS/content.opf")).iter("{http://www.idpf.org/2007/opf}item")}
    assert names == {n.removeprefix("OEBPS/") for n in z.namelist()} - {"mimetype", "META-INF/container.xml", "content.opf"}


def test_fonts_of_a_package_are_used(spark):
    titles = spark.createDataFrame([(1, None, None)], "doc_id bigint, title string, author string")
    fonts = {"regular": ("A.ttf", b"one"), "bold_italic": ("A-BI.otf", b"two")}
    made = PL.books(_stored(spark, ["p", "p"]), titles, fonts=fonts).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(made["epub"])))
    css, opf, nav = (z.read(f"OEBPS/{n}").decode() for n in ("style/book.css", "content.opf", "nav.xhtml"))
    assert z.read("OEBPS/fonts/A.ttf") == b"one" and z.read("OEBPS/fonts/A-BI.otf") == b"two"
    assert 'url("../fonts/A.ttf") format("truetype")' in css and 'url("../fonts/A-BI.otf") format("opentype")' in css and css.count('font-family: "book"') == 3
    assert 'href="fonts/A.ttf" media-type="font/ttf"' in opf and "titlepage" not in opf and 'href="text/ch001.xhtml"' in nav


def test_converter(tmp_path):
    import stat

    tool = tmp_path / "convert"
    tool.write_text("#!/bin/sh\necho \"$@\" > \"$2\"; head -c 600 /dev/zero >> \"$2\"\n")
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    out = tmp_path / "made" / "b.mobi"
    assert package.to_mobi("a.epub", str(out), tool=str(tool)) == str(out)
    assert out.read_bytes().split(b"\n")[0].decode() == f"a.epub {out} --output-profile kindle --mobi-file-type new"
    for script in ("exit 3", "true", 'echo x > "$2"'):
        tool.write_text(f"#!/bin/sh\necho why >&2\n{script}\n")
        with pytest.raises(RuntimeError, match="why"):
            package.to_mobi("a.epub", str(tmp_path / "c.mobi"), tool=str(tool))


def test_guard(spark):
    spans, _ = page(spark, ("ok", 12.0, "R", 500.0, 100.0))
    bad, _ = page(spark, ("x\U0010fc00", 12.0, "R", 500.0, 100.0), doc=2)
    sound, kept = RD.guarded(spans.union(bad))
    assert [r["doc_id"] for r in sound.collect()] == [1] and kept.first()["sample"] == "U+10FC00"
    with pytest.raises(Exception, match="private-use"):
        RD.guarded(bad, strict=True)[0].collect()


def test_routes(spark):
    p = spark.createDataFrame([("/d/a.b.pdf",)], "path string")
    assert tuple(RP.routed(p, "Both").first()) == ("/d/a.b.pdf", "/d/converted/a.b.epub", "/d/converted/a.b.mobi")
    assert tuple(RP.routed(p, "mobi", "/x/y").first())[1:] == (None, "/x/y.mobi")
    assert tuple(RP.routed(p, "both", "/x/y.mobi").first())[1:] == ("/x/y.epub", "/x/y.mobi")
    with pytest.raises(ValueError):
        RP.routed(p, "pdf")


def test_empty_tables(spark):
    spans, pages = spark.createDataFrame([], SPANS), spark.createDataFrame([], PAGES)
    assert B.build(spans, pages).count() == 0 and G.bands(G.segments(spans, pages)).count() == 0
    assert L.document_facts(L.page_facts(L.lines(spans), pages)).count() == 0


def test_nulls_and_repeats(spark):
    rows = [(1, 0, 0, 0, None, None, None, None, 0.0, 0.0, 0.0, 0.0), (1, 0, 1, 0, "s", "متن", 12.0, None, 0.0, 0.0, 0.0, 0.0)]
    spans = spark.createDataFrame(rows + rows, SPANS)
    pages = spark.createDataFrame([(1, 0, None, None, None)], PAGES)
    assert L.lines(spans).count() == 2 and [b["text"] for b in B.build(spans, pages).collect()] == ["متن"]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"1" * 30_000)
    (tmp_path / "a" / "y.pdf").write_bytes(b"1")
    (tmp_path / "f.TTF").write_bytes(b"1")
    (tmp_path / ".g.ttf").write_bytes(b"1")
    assert RD.corpus_files(spark, str(tmp_path)).count() == 1 and RD.corpus_files(spark, str(tmp_path), skipped=("a",)).count() == 0
    assert [r["path"].rsplit("/", 1)[-1] for r in RD.font_files(spark, [str(tmp_path)]).collect()] == ["f.TTF"]

    def extract(path, content):
        if len(content) < 2:
            raise ValueError("too short")
        yield (1, 0, 0, 0, "s", "t", 12.0, "F", 0.0, 0.0, 1.0, 1.0)

    got = {r["doc_id"]: r["text"] for r in RD.read_documents(spark, str(tmp_path), extract).collect()}
    assert got == {1: "t", None: "failed: too short"}


def test_stream(spark, tmp_path):
    from varaq.streaming.ingest import stream_blocks

    spans, pages = page(spark, ("متن " * 30, 12.0, "R", 530.0, 120.0))
    spans.write.parquet(str(tmp_path / "in"))
    heard = []
    q = stream_blocks(spark, str(tmp_path / "in"), pages, str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, rows: heard.append((n, rows)))
    q.awaitTermination(120)
    assert heard == [(0, 1)] and spark.read.parquet(str(tmp_path / "out")).count() == 1
