"""Markup from blocks, chapters and outlines, as string projections."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .outline import chapter_href


@dataclass(frozen=True)
class RenderOptions:
    title: str = ""
    author: str = ""
    language: str = "fa-IR"
    font_family: str = ""
    base_size: float = 1.0
    line_height: float = 1.85
    justify: bool = True
    indent_paragraphs: bool = True
    keep_notes: bool = True
    chapter_break_at: int = 1


def overlaid(options: RenderOptions, **changes) -> RenderOptions:
    """options with every known change that isn't None."""
    known = {f.name for f in fields(RenderOptions)}
    return replace(options, **{k: v for k, v in changes.items() if k in known and v is not None})


def inline(runs: Column) -> Column:
    """array of (text, bold, italic) as inline markup."""

    def one(r: Column) -> Column:
        t = T.escape(r["text"])
        t = F.when(r["bold"], F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t)
        return F.when(r["italic"], F.concat(F.lit("<em>"), t, F.lit("</em>"))).otherwise(t)

    return F.array_join(F.transform(F.filter(runs, lambda r: r["text"] != ""), one), "")


def block_markup(kind: Column, level: Column, text: Column, inner: Column, anchor: Column, indent: Column, space: Column, options: RenderOptions = RenderOptions()) -> Column:
    """One block as markup; a block without text is ''. Verses are the text's lines."""
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.when(F.coalesce(level, F.lit(0)) > 0, level).otherwise(F.coalesce(F.substring(kind, 2, 1).try_cast("int"), F.lit(3)))))
    tag = F.concat(F.lit("h"), n.cast("string"))
    name = F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(F.lit(' id="'), anchor, F.lit('"'))).otherwise("")
    em = lambda c: F.format_string("%.2fem", c.cast("double"))
    style = F.concat(F.lit("text-indent: "), em(F.coalesce(indent, F.lit(1.6 if options.indent_paragraphs else 0.0))), F.when(space.isNotNull(), F.concat(F.lit("; margin-top: "), em(space))).otherwise(""))
    verses = F.filter(F.transform(F.split(text, "\n", -1), T.clean), lambda s: s != "")
    poem = F.array_join(F.transform(verses, lambda s: F.concat(F.lit('<span class="verse">'), T.escape(s), F.lit("</span><br/>"))), "")
    return (
        F.when(kind == "rule", "<hr/>")
        .when(T.clean(text) == "", "")
        .when(kind.startswith("h"), F.concat(F.lit("<"), tag, name, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")))
        .when(kind == "note", F.concat(F.lit('<aside class="note">'), inner, F.lit("</aside>")))
        .when(kind == "poem", F.concat(F.lit('<div class="poem">'), poem, F.lit("</div>")))
        .when(kind == "caption", F.concat(F.lit('<p class="caption">'), inner, F.lit("</p>")))
        .when(kind == "p", F.concat(F.lit('<p style="'), style, F.lit('">'), inner, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p>"), inner, F.lit("</p>")))
    )


def rendered_blocks(chaptered: DataFrame, outline: DataFrame, options: RenderOptions = RenderOptions()) -> DataFrame:
    """doc_id, chapter, chapter_title, block_no, markup. Uses `styled` runs where the blocks have them, else their text."""
    marks = outline.select("doc_id", "block_no", "anchor")
    inner = inline(F.col("styled")) if "styled" in chaptered.columns else T.escape(F.col("text"))
    rows = chaptered.join(marks, ["doc_id", "block_no"], "left")
    c = F.col
    return rows.select("doc_id", "chapter", "chapter_title", "block_no", block_markup(c("kind"), c("level"), c("text"), inner, c("anchor"), c("first_line_indent_em"), c("space_before_em"), options).alias("markup"))


def _page(head: Column | str, body: Column | str, language: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    start = f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{language}" lang="{language}" dir="rtl">\n'
    return F.concat(F.lit(start), lit(head), F.lit('<body dir="rtl">\n'), lit(body), F.lit("\n</body>\n</html>\n"))


def content_page(title: Column, body: Column, language: str, sheet: str = "../style/book.css") -> Column:
    """A content document with a head; title and body are markup."""
    return _page(F.concat(F.lit('<head><meta charset="utf-8"/><title>'), title, F.lit(f'</title><link rel="stylesheet" type="text/css" href="{sheet}"/></head>\n')), body, language)


def chapter_documents(markup: DataFrame, options: RenderOptions = RenderOptions(), standalone: bool = True) -> DataFrame:
    """doc_id, chapter, chapter_title, document: one content document per chapter; only a standalone one has a head."""
    g = markup.where("markup <> ''").groupBy("doc_id", "chapter", "chapter_title").agg(F.array_sort(F.collect_list(F.struct("block_no", "markup"))).alias("m"))
    body = F.concat(F.lit('<section epub:type="chapter">\n'), F.array_join(F.transform("m", lambda b: b["markup"]), "\n"), F.lit("\n</section>"))
    name = F.when(F.col("chapter_title") != "", F.col("chapter_title")).otherwise(F.lit(options.title or "—"))
    document = content_page(T.escape(name), body, options.language) if standalone else _page("", body, options.language)
    return g.select("doc_id", "chapter", "chapter_title", document.alias("document"))


def contents(nested_outline: DataFrame) -> DataFrame:
    """doc_id, toc: the outline as nested lists, each level's tags opened and closed by the depth of the next entry."""
    order = Window.partitionBy("doc_id").orderBy("entry_no")
    link = F.concat(F.lit('<li><a href="'), T.escape(chapter_href(F.col("chapter"), F.col("anchor"))), F.lit('">'), T.escape(F.col("title")), F.lit("</a>"))
    nxt = F.coalesce(F.lead("depth").over(order), F.lit(0))
    down = F.lead("depth").over(order) > F.col("depth")
    tail = F.when(F.coalesce(down, F.lit(False)), "<ol>").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), F.greatest(F.lit(0), F.col("depth") - nxt))))
    rows = nested_outline.select("doc_id", "entry_no", F.concat(link, tail).alias("item"))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry_no", "item"))).alias("items"))
    return g.select("doc_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</ol>")).alias("toc"))


def title_page(title: Column, author: Column) -> Column:
    title, author = F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))
    part = lambda c, v: F.when(v != "", F.concat(F.lit(f'<p class="{c}">'), T.escape(v), F.lit("</p>"))).otherwise("")
    body = F.concat(F.lit('<section class="titlepage" epub:type="titlepage">'), part("book-title", title), part("book-author", author), F.lit("</section>"))
    return F.when((title == "") & (author == ""), "").otherwise(body)


def stylesheet(options: RenderOptions = RenderOptions(), faces: str = "") -> str:
    """The book's style sheet: reading direction is left to the documents."""
    family = f'font-family: "{options.font_family}", serif; ' if options.font_family else ""
    align = "justify" if options.justify else "start"
    rules = {
        "body": f"{family}font-size: {options.base_size:g}em; line-height: {options.line_height:g}; text-align: {align};",
        "p": "margin: 0; text-indent: 1.6em;" if options.indent_paragraphs else "margin: 0; text-indent: 0;",
        "h1 + p, h2 + p, h3 + p": "text-indent: 0;",
        "h1, h2, h3": "text-align: center; text-indent: 0; page-break-after: avoid; line-height: 1.4;",
        "h1": "font-size: 1.6em; margin: 2.4em 0 1.2em;", "h2": "font-size: 1.3em; margin: 1.8em 0 0.9em;", "h3": "font-size: 1.1em; margin: 1.4em 0 0.7em;",
        "aside.note": "font-size: 0.85em; margin: 0.8em 1.5em;", "p.caption": "text-align: center; font-size: 0.9em;",
        "div.poem": "margin: 1em 2em; text-align: center;", "span.verse": "display: inline-block;", "hr": "border: 0; border-top: thin solid; width: 30%; margin: 1.5em auto;", "section.titlepage": "text-align: center; margin-top: 30%;",
        "p.book-title": "font-size: 1.9em; text-indent: 0;", "p.book-author": "font-size: 1.2em; text-indent: 0;",
    }
    return faces + "\n".join(f"{k} {{ {v} }}" for k, v in rules.items()) + "\n"


def font_faces(files: dict[str, str], family: str, href_for) -> str:
    """@font-face rules of the files of a family by face (regular, bold, italic, bold_italic); missing ones are left out."""
    kinds = {"ttf": "truetype", "otf": "opentype", "ttc": "collection"}
    out = []
    for face, path in files.items():
        if path:
            style, weight = "italic" if "italic" in face else "normal", "bold" if "bold" in face else "normal"
            kind = kinds.get(path.rsplit(".", 1)[-1].lower(), "truetype")
            out.append(f'@font-face {{ font-family: "{family}"; font-style: {style}; font-weight: {weight}; src: url("{href_for(path)}") format("{kind}"); }}\n')
    return "".join(out)


def preview(markup: DataFrame, titles: DataFrame, options: RenderOptions = RenderOptions(), faces: str = "") -> DataFrame:
    """doc_id, html: the whole book as one page with its style sheet inside. titles: doc_id, title, author."""
    g = markup.where("markup <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "markup"))).alias("m"))
    body = F.concat_ws("\n", F.nullif(title_page(F.col("title"), F.col("author")), F.lit("")), F.array_join(F.transform("m", lambda b: b["markup"]), "\n"))
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.lit("preview"))
    head = F.concat(F.lit('<head><meta charset="utf-8"/><title>'), T.escape(name), F.lit("</title><style>\n" + stylesheet(options, faces) + "body { max-width: 34em; margin: 0 auto; }\n</style></head>\n"))
    return g.join(titles, "doc_id", "left").select("doc_id", F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="{options.language}" dir="rtl">\n'), head, F.lit('<body dir="rtl">\n'), body, F.lit("\n</body>\n</html>\n")).alias("html"))
