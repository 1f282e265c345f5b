"""Problem 9: the language of each post and of each segment of it.

Method: compression classification. Each language has a raw-content zstandard dictionary of its own prose; a
segment is in the language whose dictionary lets it compress to the fewest bytes, unless the margin to the
second is narrow. One more dictionary holds code, learned from what posts mark as code; a line that it compresses
best by that margin is code too. The dictionaries are fitted on a bounded sample of labelled posts (SAMPLE_ROWS per
language, of whose lines, all of them, SAMPLE_BYTES are drawn by hash) and cleaned of wrong labels by classifying
their own lines again. A segment is compared with the dictionaries that have its script: others can't win.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 240, 150_000, 48_000
MIN_MARGIN, MIN_LETTERS, LEVEL, PIECE, SHORT = 0.1, 8, 3, 1500, 30
CODE = "code"
#: ISO 639: the bibliographic codes that differ from the terminological ones, codes that changed, and codes that name no language: fixed values.
BIBLIOGRAPHIC = {"alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de", "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy"}
CHANGED = {"iw": "he", "in": "id", "ji": "yi"}
NO_LANGUAGE = ("und", "xx", "mis", "mul", "zxx", "")

_FENCE = re.compile(r"^[ ]{0,3}(```|~~~).*?(?:^[ ]{0,3}\1[^\n]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.S | re.I)
_INDENT = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
#: Inline code, links, tags, addresses and file names (a word, a point, and two to four small letters).
_INLINE = re.compile(r"`[^`\n]*`|!?\[[^\]\n]*\]\([^)\n]*\)|<[^<>\n]{1,300}>|\b(?:https?|ftp)://\S+|\bwww\.\S+|\S+@\S+\.\S+|\b\w[\w-]*\.[a-z]{2,4}\b")
_MARK = re.compile(r"[`\[<@]|://|www\.|\w\.[a-z]")
_SCRIPTS = (("Thai", "฀-๿"), ("Kana", "぀-ヿ"), ("Han", "㐀-鿿"), ("Hangul", "가-힯"), ("Arabic", "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ"), ("Cyrillic", "Ѐ-ԯ"), ("Greek", "Ͱ-Ͽ"), ("Hebrew", "֐-׿"), ("Devanagari", "ऀ-ॿ"), ("Latin", "A-Za-zÀ-ɏ"))
_NAMES = [n for n, _ in _SCRIPTS]
_RANGES = sorted((ord(c[i]), ord(c[i + 2]) + 1, k) for k, (_, c) in enumerate(_SCRIPTS) for i in range(0, len(c), 3))
_BOUNDS = np.array([x for a, b, _ in _RANGES for x in (a, b)], np.uint32)
_KIND = np.array([len(_NAMES), *(x for _, _, k in _RANGES for x in (k, len(_NAMES)))])
_ASCII_LETTERS = bytes(c for c in range(128) if chr(c).isalpha())


@cache
def _codes() -> dict[str, str]:
    """ISO 639 codes of two and three letters to those of two, as the Java runtime lists them."""
    locale = SparkSession.active()._jvm.java.util.Locale
    two = [str(c) for c in locale.getISOLanguages()]
    three = {str(locale.forLanguageTag(c).getISO3Language()): CHANGED.get(c, c) for c in two}
    return three | {c: CHANGED.get(c, c) for c in two} | BIBLIOGRAPHIC


def label_language(label: F.Column) -> F.Column:
    """The two-letter code that a label names, or null: en, ENG, en_US and en-US name en; und, xx, unknown and '' name none.

    A code of two letters that ISO 639 doesn't list names itself; one of three, nothing.
    """
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_.@].*)?$", 1)
    known = F.create_map(*(F.lit(x) for p in sorted(_codes().items()) for x in p))
    return F.when(code.isin(*NO_LANGUAGE), None).otherwise(F.coalesce(F.try_element_at(known, code), F.when(F.length(code) == 2, code)))


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def marked_code(text: str) -> list[str]:
    """The lines of what a text marks as code by fences, tags or indents."""
    out = []
    for r in (_FENCE, _PRE, _INDENT):
        if r is not _PRE or "<" in text:
            out += [s.strip() for m in r.finditer(text) for s in m[0].split("\n")]
            text = r.sub(_blank, text)
    return [s for s in out if s]


def prose_lines(text: str) -> list[tuple[int, int, str]]:
    """(start, end, prose) of each line with prose: marked code, links, tags and file names blanked, positions kept."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_blank, text)
    if "<" in text:
        text = _PRE.sub(_blank, text)
    if text[:1] in " \t" or "\n " in text or "\n\t" in text:
        text = _INDENT.sub(_blank, text)
    if _MARK.search(text):
        text = _INLINE.sub(_blank, text)
    out: list[tuple[int, int, str]] = []
    at, quoted = 0, False
    for line in text.split("\n"):
        kept = line.strip().lstrip(" \t\r\f\v>#*+•-").strip()
        quote = line.lstrip().startswith(">")
        if kept:
            start = at + line.index(kept)
            if quote and quoted and out:  # lines of one quotation are one paragraph
                out[-1] = (out[-1][0], start + len(kept), f"{out[-1][2]} {kept}")
            else:
                out.append((start, start + len(kept), kept))
        quoted = quote and bool(kept)
        at += len(line) + 1
    return out


def _scripts(text: str) -> dict[str, int]:
    """Letters by script."""
    if text.isascii():
        n = len(text) - len(text.encode().translate(None, _ASCII_LETTERS))
        return {"Latin": n} if n else {}
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(_KIND[np.searchsorted(_BOUNDS, codes, "right")], minlength=len(_NAMES) + 1)
    return {_NAMES[i]: int(counts[i]) for i in np.flatnonzero(counts[:-1])}


class Model:
    """Dictionaries by language (and one of code), with the scripts each is written in."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.raw = {k: v for k, v in sorted(dictionaries.items()) if len(v) >= 8}
        self.names = [k for k in self.raw if k != CODE]
        self.scripts = {}
        for k in self.names:
            c = _scripts(self.raw[k].decode("utf-8", "ignore"))
            self.scripts[k] = {n for n, x in c.items() if x > 0.1 * sum(c.values())}
        self.dicts = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in self.raw.items()}
        for d in self.dicts.values():
            d.precompute_compress(level=LEVEL)
        self.press = {k: zstandard.ZstdCompressor(dict_data=d, write_content_size=False) for k, d in self.dicts.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def classify(self, text: str, margin: float = MIN_MARGIN) -> tuple[str | None, float]:
        """(language, CODE or None, confidence): the confidence is the relative margin to the second best, from 0 to 1."""
        c = _scripts(text)
        total = sum(c.values())
        if not self.names or total < MIN_LETTERS and not sum(c.get(n, 0) for n in ("Han", "Kana", "Thai")) >= 4:
            return None, 0.0
        used = {n for n, x in c.items() if x > 0.25 * total}
        names = [k for k in self.names if self.scripts[k] & used] or self.names
        if c.get("Kana", 0) > 0.1 * total:
            names = [k for k in names if "Kana" in self.scripts[k]] or names
        # long texts in pieces: within one piece a text would soon serve as its own dictionary
        data = [text.encode("utf-8", "replace")] if len(text) <= PIECE else [text[i : i + PIECE].encode("utf-8", "replace") for i in range(0, len(text), PIECE)]
        size = lambda press: sum([len(press.compress(d)) for d in data])
        sizes = sorted([(size(self.press[k]), k) for k in names])
        second = sizes[1][0] if len(sizes) > 1 else size(self.plain)
        narrow = margin if total >= SHORT else 2.5 * margin  # a few words are easily mistaken
        if CODE in self.press and "Latin" in used:
            code = size(self.press[CODE])
            if (gap := (sizes[0][0] - code) / max(sizes[0][0], 1)) >= narrow and gap > 0:
                return CODE, gap
        gap = (second - sizes[0][0]) / max(second, 1)
        return (sizes[0][1] if gap >= narrow else None), max(gap, 0.0)


def _dictionaries(lines: dict[str, list[str]]) -> dict[str, bytes]:
    """For each language its lines up to DICT_BYTES, equal ones once."""
    out = {}
    for k, v in lines.items():
        data, size = [], 0
        for s in dict.fromkeys(v):
            b = s.encode("utf-8", "replace") + b"\n"
            if size + len(b) > DICT_BYTES:
                break
            data.append(b)
            size += len(b)
        out[k] = b"".join(data)
    return out


def fit(documents: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from at most `rows` labelled posts per language, chosen by a hash of the text, and of the lines of the whole
    posts (long ones in stretches) at most SAMPLE_BYTES a language, chosen by a hash too."""
    labelled = documents.where("text is not null").select(label_language(F.col("lang")).alias("lang"), "text", F.xxhash64("text").alias("h")).where("lang is not null")
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = labelled.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("lang", "h", "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, h, text in zip(pdf["lang"], pdf["h"], pdf["text"]):
                for kind, lines in ((lang, [s for _, _, s in prose_lines(text)]), (CODE, marked_code(text))):
                    out += [(kind, h, s[i : i + PIECE]) for s in lines for i in range(0, len(s), PIECE)]
            yield pd.DataFrame(out, columns=["lang", "h", "line"])

    lines = sample.mapInPandas(cut, "lang string, h bigint, line string").distinct()
    upto = F.sum(F.octet_length("line")).over(Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line", "h").rowsBetween(Window.unboundedPreceding, 0))
    drawn = lines.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("lang", "h", "line", F.xxhash64("line").alias("at")).collect()  # SAMPLE_BYTES a language
    code, by_post = [], {}
    for r in sorted(drawn, key=lambda r: (r["lang"], r["h"], r["at"], r["line"])):
        code.append(r["line"]) if r["lang"] == CODE else by_post.setdefault((r["lang"], r["h"]), []).append(r["line"])
    posts = [(k, v) for (k, _), v in by_post.items()]
    posts = _agreeing(posts, lambda m, k, v: v if m.classify("\n".join(v), 0.0)[0] in (k, None) else [])
    for _ in range(2):
        posts = _agreeing(posts, lambda m, k, v: [s for s in v if m.classify(s, 0.0)[0] in (k, None)])
    return Model(_dictionaries(_by_language(posts) | {CODE: code}))


def _by_language(posts: list[tuple[str, list[str]]]) -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for k, v in posts:
        by.setdefault(k, []).extend(v)
    return by


def _agreeing(posts: list[tuple[str, list[str]]], kept: Callable) -> list[tuple[str, list[str]]]:
    """What `kept` leaves of each post, judged by a model of the other half of the posts: no line finds itself in a dictionary."""
    halves = [Model(_dictionaries(_by_language(posts[i::2]))) for i in (0, 1)]
    left = [(k, kept(halves[1 - i % 2], k, v)) for i, (k, v) in enumerate(posts)]
    return [p for p in left if p[1]]


def segments(documents: DataFrame, model: Model | None = None, margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, segment_no, start_pos, end_pos, lang, confidence: neighbouring prose lines of one language.

    Lines that are too short or too close to call join the segment before, or the one after if they come first; lines of
    code are left out; a post of nothing else has one segment with a null lang. Null texts and posts without prose have
    no segment; equal rows count once.
    """
    return _segments(documents, model, margin).drop("named").distinct()


def _segments(documents: DataFrame, model: Model | None = None, margin: float = MIN_MARGIN) -> DataFrame:
    """The segments with named, what the post's label names; posts stay where they lie, and repeated ones go with their few segments."""
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model.raw)  # at most DICT_BYTES a language

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(shared.value)
        for pdf in batches:
            out = []
            for doc_id, text, named in zip(pdf["doc_id"], pdf["text"], pdf["named"]):
                runs: list[list] = []
                for start, end, s in prose_lines(text):
                    lang, sure = m.classify(s, margin)
                    n = end - start
                    if lang == CODE:
                        continue
                    if runs and (lang is None or runs[-1][2] == lang or runs[-1][2] is None):
                        run = runs[-1]
                        run[1], run[2] = end, run[2] or lang
                        if lang is not None:
                            run[3], run[4] = run[3] + sure * n, run[4] + n
                    else:
                        runs.append([start, end, lang, sure * n, n] if lang else [start, end, None, 0.0, 0])
                out += [(doc_id, i, a, b, lang, w / n if n else 0.0, named) for i, (a, b, lang, w, n) in enumerate(runs)]
            yield pd.DataFrame(out, columns=["doc_id", "segment_no", "start_pos", "end_pos", "lang", "confidence", "named"])

    texts = documents.where("text is not null").select("doc_id", "text", label_language(F.col("lang")).alias("named"))
    return texts.mapInPandas(work, "doc_id bigint, segment_no int, start_pos int, end_pos int, lang string, confidence double, named string")


def document_languages(documents: DataFrame) -> DataFrame:
    """doc_id, lang, confidence, named (what the label names): the language of most prose of each post; null without prose."""
    parts = segments(documents).where("lang is not null").groupBy("doc_id", "lang").agg(F.sum(F.expr("end_pos - start_pos")).alias("n"), F.max("confidence").alias("confidence"))
    total = parts.groupBy("doc_id").agg(F.max_by(F.struct("lang", "n", "confidence"), F.struct("n", "lang")).alias("top"), F.sum("n").alias("all"))
    best = total.select("doc_id", F.col("top.lang").alias("lang"), (F.col("top.confidence") * F.col("top.n") / F.col("all")).alias("confidence"))
    labels = documents.select("doc_id", label_language(F.col("lang")).alias("named")).distinct()
    return labels.join(best, "doc_id", "left")


def found(documents: DataFrame) -> DataFrame:
    """Each post and language of its prose that its label does not name."""
    return _segments(documents).where("lang is not null and (named is null or named <> lang)").select("doc_id", "lang").distinct()
