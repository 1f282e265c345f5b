"""Problem 1: sentence units of every block, in any language and script.

Method: unsupervised statistics per language over the whole corpus, by log-likelihood ratios: which word types stand
before a point far more often than chance (abbreviations), which of them never end a text (so that their point never
ends a sentence either), which words follow an ellipsis or a closing quote far more often than they start a sentence,
and which types and the numbers after them make collocations. Each end mark is then classified with these statistics.

Texts are read once: Python finds each block's end marks, settles those that need no statistics, and names for the
others the word type or word that decides; it counts types per batch. Counts are summed in one aggregation, totals
taken before anything is filtered, the ratios computed as columns, and the open marks joined with the significant
types (sent to every task if few, salted if many). No statistics pass through the driver.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .garbled import CODECS, MULTI, to_bytes
from .lookalike import LATIN_LOOKALIKES, PERSIAN_FOLDS
from .quality import FUNCTION_WORDS
from .repeated import met

CHI2 = 15.1  # 1 in 10 000 by chance

_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, 0x640])
_FOLD = _INVISIBLE | {ord(p[0]): p[1] for p in PERSIAN_FOLDS.split()} | {0xFF01 + i: 0x21 + i for i in range(94)}
_TO_CYRILLIC = {ord(p[1]): p[0] for p in reversed(LATIN_LOOKALIKES.split()) if "Ѐ" <= p[0] <= "ӿ"}
_TO_LATIN = {ord(p[0]): p[1] for p in LATIN_LOOKALIKES.split()}

_OPEN = "\"'“‘«‹„‚「『《（(\\[¿¡"
_CLOSE = "\"'”’»›“‘」』》）)\\]"
_EDGES = _OPEN.replace("\\", "") + _CLOSE.replace("\\", "") + ",،;؛:!?؟…"
# “ and ‘ close in German only, where no letter comes right after them
_MARKS = re.compile(rf"([.!?؟۔。！？…‥．]+)((?:[ \u00a0\u2009\u202f]?»|[“‘](?![^\W\d_])|[\u00ad\u200b-\u200f\u2060\ufeff]+(?=\s)|[{_CLOSE.replace('“‘', '')}])*)(\s*)")
_OPENERS = re.compile(rf"(?:[{_OPEN}]+[ \u00a0\u2009\u202f]?)*")
_POINTS = frozenset(",;:،؛；：，、.!?…؟。！？—–-‐)]}»”’」』》）%/|·•‣◦*†‡→=+<>&#@_~^\\")
_TOKEN = re.compile(r"[^\s]+")
_FILE = re.compile(r"[A-Za-z0-9_-]+\.(?:[a-z]{2,4})(?![A-Za-z])")
_NOTE = re.compile(r"\s*(?:[*†‡§]+|[(（]\w{1,3}[)）])\s*")
_BULLETS = re.compile(r"[•‣◦▪|→;]|\d\)|·{3,}")
_THAI_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_CASELESS = re.compile(r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-ﻼ぀-ヿ㐀-鿿֐-׿ऀ-ॿ]")
_FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items() if k not in ("ru", "fa", "ar")}
_PERSIAN = re.compile("[پچژگکی]")
_ARABIC = re.compile("[كيةىأإ]")


#: Where scripts begin and end, and which they are; characters outside count for none.
_BOUNDS = np.array([0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x400, 0x500, 0x600, 0x700, 0xE00, 0xE80, 0x3040, 0x3100, 0x3400, 0xA000, 0xFB50, 0xFE00, 0xFE70, 0xFF00], np.uint32)
_SCRIPT_AT = np.array([0, 1, 0, 1, 0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 6, 0, 3, 0, 3, 0])


def language(text: str) -> str:
    """A rough language, to keep statistics apart: by script, then by function words or letters; xx where they don't tell."""
    if text.isascii():
        la, ru, fa, th, ja, zh = 1, 0, 0, 0, 0, 0
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        la, ru, fa, th, ja, zh = np.bincount(_SCRIPT_AT[np.searchsorted(_BOUNDS, codes, "right")], minlength=7)[1:].tolist()
    if ja * 6 > zh and ja > 0 and ja + zh > la // 2:
        return "ja"
    n = {"th": th, "ja": ja, "zh": zh, "ru": ru, "fa": fa, "la": la}
    top = max(n, key=n.get)
    if not n[top]:
        return "xx"
    if top == "fa":
        return "fa" if len(_PERSIAN.findall(text)) * 2 > len(_ARABIC.findall(text)) else "ar"
    if top == "la":
        words = set(text.lower().split())
        hits = {k: len(f & words) for k, f in _FUNCTION.items()}
        most = max(hits.values())
        best = [k for k, n in hits.items() if n == most] if most else []
        if len(best) > 1:  # several words of each: which come more often
            tokens = text.lower().split()
            often = {k: sum(t in _FUNCTION[k] for t in tokens) for k in best}
            best = [k for k in best if often[k] == max(often.values())]
        return best[0] if len(best) == 1 else "xx"
    return top


_NORMAL: dict[str, str] = {}


def normal(token: str) -> str:
    """A word as it is counted: one form of look-alikes, lower case, numbers alike."""
    known = _NORMAL.get(token)
    if known is not None:
        return known
    t = token if token.isascii() else token.translate(_FOLD)
    cyrillic = 0 if t.isascii() else sum("Ѐ" <= c <= "ӿ" for c in t)
    t = t if t.isascii() else t.translate(_TO_CYRILLIC if cyrillic * 2 > len(t) else _TO_LATIN)
    t = "##" if _DIGITS.search(t) else t.lower()
    if len(_NORMAL) > 300_000:  # a memory of this worker's last words
        _NORMAL.clear()
    if len(token) < 40:
        _NORMAL[token] = t
    return t


def _next(text: str, at: int) -> tuple[str, str]:
    """(kind, word) of what follows: end, upper, lower, number, file, other or mark; the word as counted."""
    i = at
    if i < len(text) and text[i] in _OPENING:
        i = _OPENERS.match(text, at).end()
    opened = i > at
    if i >= len(text):
        return "end", ""
    c = text[i]
    if _SPACELESS.match(c):
        return "other", c
    if c.isdigit():
        return "number", "##"
    small = c.islower() or c in "ªº"
    m = _TOKEN.match(text, i)
    word = m[0] if m else ""
    if small and "." in word or small and not word.isascii():
        if _FILE.match(word if word.isascii() else word.translate(_FOLD).translate(_TO_LATIN)):
            return "file", "##file"
    w = normal(word.strip(_EDGES))
    if c.isupper():
        return "upper", w
    if small:
        inverted = text[i + 1 : i + 2].isupper()  # as a wrong decoding may leave it
        return ("upper" if opened and text[at] in "¿¡" or inverted else "lower"), w
    return ("mark", c) if c in _POINTS else ("other", w)


def _word_before(text: str, at: int) -> str:
    """What stands between the last white space and `at`."""
    reach = 32
    while True:
        a = max(0, at - reach)
        part = text[a:at]
        last = part.split()[-1:] if part and not part[-1].isspace() else [""]
        if a == 0 or len(last[0]) < len(part):
            return last[0] if last else ""
        reach *= 4


def marks(text: str) -> Iterator[tuple[int, int, str, str, bool, str, str, str]]:
    """Each run of end marks: (start, end with closers, marks, closers, space after, word before, kind of what follows, next word)."""
    for m in _MARKS.finditer(text):
        run, closers, space = m[1], m[2], m[3]
        if closers:
            closers = closers.translate(_INVISIBLE)
        start = m.start()
        kind, nxt = _next(text, m.end())
        yield start, m.end() - len(space), run, closers, bool(space), _word_before(text, start), kind, nxt


def _type(word: str) -> str:
    """The word type before a point: its last part, after any inner point."""
    w = word.strip(_OPEN + _CLOSE)
    return normal(w.rsplit(".", 1)[-1]) if w else ""


def _read_wrongly(text: str, at: int) -> bool:
    """Whether the characters beyond ASCII that end at `at` are UTF-8 read in a one-byte encoding."""
    a = at
    while a and not text[a - 1].isascii():
        a -= 1
    for reader in _READERS:
        data = to_bytes(text[a : at + 1], reader)
        try:
            if data is not None and data.decode():
                return True
        except UnicodeDecodeError:
            pass
    return False


_READERS = [r for r in CODECS if r not in MULTI]
_OPENING = frozenset(_OPEN.replace("\\", ""))
#: What statistics an open mark waits for: a word after several points, after one ellipsis, after a closing quote, a type before a point.
DOTS, DOT1, QUOTE, POINT = "dots", "dot1", "q", "p"
NUMBER, INITIAL = 1, 2  # flags of a point: a number follows; an initial may stand before


def _open(text: str, start: int, end: int, run: str, closers: str, space: bool, word: str, kind: str, nxt: str, lang: str) -> tuple[str, str, int] | bool:
    """Whether the sentence goes on after this run of end marks; where statistics decide, (which, key, flags)."""
    if kind == "end":
        return False
    if kind == "lower" and lang in ("fa", "ar", "xx") and nxt[:1] > "\x7f":
        kind = "other"  # a wrong decoding; its letter case says nothing
    cased = kind in ("upper", "lower")
    if start and not space and not closers:
        prev = text[start - 1]
        if run[0] in ".…‥．" and run != "。":
            after = text[end : end + 1]
            if prev.isdigit() or after.isdigit():
                return True
            if _CASELESS.match(after):
                if len(_type(word)) <= 1:
                    return True  # inside an abbreviation
                if run[0] == "…" and lang not in ("zh", "ja") or not _CASELESS.match(prev):
                    return True
            elif not (after.isupper() and after.isascii() == prev.isascii() and (prev.islower() or "Ѐ" <= after <= "ӿ")) and not (after and after in "«“„\"「『¿¡—–(" and run == "."):
                return not (after.isupper() and prev.islower() and ord(after) < 0x250 and ord(prev) < 0x250 and run == ".") if after.isalpha() else True
        elif run[0] not in "。！？" and (cased and kind == "lower" or nxt[:1] == "\ufffd" or unicodedata.category(prev)[0] not in "LNMZ" and prev != "\ufffd" and prev not in _CLOSE):
            return True
    elif run[0] == "…" and start and not text[start - 1].isascii() and _read_wrongly(text, start):
        return True  # a byte of a wrong decoding, not a mark
    if run[0] in "….‥" and (len(run) > 1 or run[0] != "."):
        if kind == "lower" or kind == "mark" and nxt in ",،;:":
            return True
        return (DOTS if run[0] == "." else DOT1, nxt, 0) if kind in ("other", "number") else False
    if closers and any(c not in ")]）" for c in closers):
        if kind in ("lower", "mark"):
            return True
        if run[0] in "!?؟！？" and kind in ("other", "number"):
            return True
        return (QUOTE, nxt, 0) if kind == "other" else False
    if run[0] in "。！？":
        return False
    if run[0] in "!?؟۔":
        return kind == "lower" or kind == "mark" and nxt in ",،;:；，、"
    t = _type(word)
    if not t or kind == "lower" or kind == "mark" and nxt not in "*•—–-#\ufffd":
        return True
    initial = len(t) == 1 and t.isalpha() and not word.islower() and cased and len(word.strip(_OPEN)) <= 2
    return POINT, t, NUMBER * (kind == "number") + INITIAL * initial


_PAIRS = {"“": "”", "«": "»", "„": "“”", "「": "」", "『": "』", "《": "》", "‹": "›"}
_QUOTE = re.compile("[\"“«„「『《‹]")


def _quoted(text: str) -> list[tuple[int, int]]:
    """(from, to) of quoted stretches of any length, the closing mark included; one inside another counts as part of it."""
    out, at = [], 0
    nowhere: set[str] = set()  # closing marks that don't come any more
    while m := _QUOTE.search(text, at):
        i, c = m.start(), m[0]
        at = i + 1
        if i and text[i - 1].isalpha() and not _SPACELESS.match(text[i - 1]):
            continue  # inside a word: a byte of a wrong decoding, or a closing mark
        hits = []
        for x in _PAIRS.get(c, c):
            if x not in nowhere:
                j = text.find(x, i + 1)
                hits.append(j) if j >= 0 else nowhere.add(x)
        if hits:
            at = min(hits) + 1
            out.append((i, at))
    return out


def _continues(text: str, at: int, lang: str) -> bool:
    """Whether the sentence goes on after a quotation that ends at `at`."""
    if text[at - 2 : at - 1] in ",،，、":
        return True
    i = at
    while i < len(text) and text[i].isspace():
        i += 1
    kind, nxt = _next(text, i)
    return kind in ("lower", "mark") or kind == "other" and text[at - 2 : at - 1] not in ".。…"


class Reader:
    """Reads texts once: their cuts, sure and open, and the counts of what the statistics need."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()  # (lang, kind, key, sub)
        self.words: dict[str, Counter] = {}  # by language, as they stand

    def read(self, text: str, count: bool = True) -> tuple[str, list[tuple[int, str, str, int]]]:
        """(language, [(end, which statistics or '' for a sure cut, key, flags)])."""
        tokens = text.split()
        lang = language(text)
        if lang == "th":
            return lang, [(a, "", "", 0) for a in _thai(text)]
        cuts, seen = [], self.counts
        note = _NOTE.match(text)
        if count:
            seen[lang, "s", _next(text, note.end() if note else 0)[1], ""] += 1
            if lang not in ("zh", "ja"):
                self.words.setdefault(lang, Counter()).update(tokens)
        spans = _quoted(text)  # in order, none inside another
        opens = [a for a, _ in spans]
        for m in marks(text):
            start, end, run, closers, space, word, kind, nxt = m
            if count:
                if run[0] in "….‥" and (len(run) > 1 or run[0] == "…"):
                    if kind in ("other", "number"):
                        seen[lang, DOTS if run[0] == "." else DOT1, nxt, ""] += 1
                elif run in (".", "．"):
                    if not closers and (space or kind == "end" or "." in word):
                        seen[lang, POINT, _type(word), kind] += 1
                    elif closers and kind == "other":
                        seen[lang, QUOTE, nxt, ""] += 1
                elif run[0] == "。":
                    seen[lang, QUOTE if closers else "s", nxt, ""] += 1
                elif not closers:
                    seen[lang, "s", nxt, ""] += 1
            how = _open(text, *m, lang)
            if how is True:
                continue
            at = bisect_left(opens, start) - 1
            if at >= 0 and end < spans[at][1] and _continues(text, spans[at][1], lang):
                continue
            cuts.append((end, *(how or ("", "", 0))))
        return lang, cuts

    def counted(self) -> list[tuple[str, str, str, str, int]]:
        """(lang, kind, key, sub, n), and forgets them. Words become types here, each distinct one once."""
        for lang, words in self.words.items():
            for w, n in words.items():
                w = w.strip(_EDGES)
                if w and w[-1] != ".":
                    self.counts[lang, "w", normal(w), ""] += n
        rows = [(*k, n) for k, n in self.counts.items()]
        self.counts, self.words = Counter(), {}
        return rows


def _thai(text: str) -> list[int]:
    """In Thai every space is a boundary, except one next to a digit or a Latin letter, and in lists and tables."""
    if len(_BULLETS.findall(text)) > 1:
        return []
    note = _NOTE.match(text)
    skip, cuts = note.end() if note else 0, []
    for m in _THAI_SPACE.finditer(text, skip):
        near = text[max(m.start() - 4, skip) : m.start()].translate(_FOLD)[-1:] + text[m.end() : m.end() + 4].translate(_FOLD)[:1]
        if not any(c.isdigit() or c.isascii() and c.isalpha() for c in near):
            cuts.append(m.start())
    return cuts


_READ = pa.schema([
    ("doc_id", pa.int64()), ("block_no", pa.int32()), ("kept", pa.bool_()), ("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32()),
    ("ends", pa.list_(pa.int32())), ("nexts", pa.list_(pa.int32())), ("which", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("flags", pa.list_(pa.int32())),
    ("kind", pa.string()), ("key", pa.string()), ("sub", pa.string()), ("n", pa.int64()),
])
_READ_DDL = "doc_id bigint, block_no int, kept boolean, lang string, first int, last int, ends array<int>, nexts array<int>, which array<string>, keys array<string>, flags array<int>, kind string, key string, sub string, n bigint"


def read(blocks: DataFrame, kept: F.Column) -> DataFrame:
    """One pass over the texts, settled: a row per block that is `kept` with its cuts, and rows of counts (kind is not null) from all blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()

        def counts() -> pa.RecordBatch:
            rows = reader.counted()
            columns = dict(zip(("lang", "kind", "key", "sub", "n"), zip(*rows))) if rows else {}
            return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in _READ], schema=_READ)

        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _READ}
            for doc_id, block_no, keep, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "block_no", "kept", "text"))):
                lang, cuts = reader.read(text)
                left = text.lstrip()
                if not keep or not left:
                    continue
                last = len(text.rstrip())
                nexts = []
                for end, *_ in cuts:
                    i = end
                    while i < last and text[i].isspace():
                        i += 1
                    nexts.append(i)
                for name, value in zip(out, (doc_id, block_no, True, lang, len(text) - len(left), last, [c[0] for c in cuts], nexts, [c[1] for c in cuts], [c[2] for c in cuts], [c[3] for c in cuts], None, None, None, None)):
                    out[name].append(value)
            yield pa.record_batch([pa.array(out[f.name], f.type) for f in _READ], schema=_READ)
            if len(reader.counts) + sum(map(len, reader.words.values())) > 300_000:
                yield counts()
        yield counts()

    texts = blocks.where("text is not null").select("doc_id", "block_no", F.coalesce(kept, F.lit(False)).alias("kept"), "text")
    return settled(texts.mapInArrow(work, _READ_DDL))


@dataclass
class Model:
    """types: lang, key, pure (its point never ends a sentence), short (an abbreviation), number (a number after its point goes on with it);
    on: lang, which, key of words that go on after an ellipsis or a quote; both settled."""

    types: DataFrame
    on: DataFrame


def _ll(k: F.Column, n: F.Column, p: F.Column, q: F.Column) -> F.Column:
    """Twice the log-likelihood ratio of rate q against rate p for k of n."""
    return 2 * (k * F.log(q / p) + (n - k) * F.log((1 - q) / (1 - p)))


def statistics(counts: DataFrame) -> Model:
    """The model of all counts. Totals are taken before types are left out."""
    total = lambda cond: F.sum(F.when(F.expr(cond), F.col("n")).otherwise(0))
    sums = {
        "p": "kind = 'p'", "ends": "kind = 'p' and sub = 'end'", "numbers": "kind = 'p' and sub = 'number'", "w": "kind = 'w'",
        "s": "kind = 's'", "dots": "kind = 'dots'", "dot1": "kind = 'dot1'", "q": "kind = 'q'",
    }
    table = settled(counts.groupBy("lang", "key").agg(*(total(v).alias(k) for k, v in sums.items())))
    totals = table.groupBy("lang").agg(*(F.sum(k).alias(f"t_{k}") for k in sums), F.sum(F.when(F.col("key") == "##", F.col("s")).otherwise(0)).alias("t_started"))
    c, both = F.col, table.join(F.broadcast(totals), "lang")  # a row a language
    between = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    base = between(share(c("t_ends"), c("t_p")), 0.02, 0.9)
    rate = between(share(c("t_p"), c("t_p") + c("t_w")), 1e-3, 0.5)
    numbered = between(share(c("t_numbers"), c("t_p")), 1e-3, 0.9)
    length = F.greatest(F.length(F.regexp_replace("key", "##", "")), F.lit(1))
    abbreviation = (_ll(c("p"), c("p") + c("w"), rate, F.lit(0.99)) > CHI2) & (c("key") != "##")
    never = (_ll(c("ends"), c("p"), base, F.greatest(base / 8, F.lit(1e-3))) > CHI2) & (c("ends") * 8 < c("p") * base * 4)
    # in languages whose sentences hardly ever start with a number, or after an abbreviation that numbers follow more often than chance has it
    worded = (c("t_s") > 0) & (c("t_started") < 0.01 * c("t_s"))
    collocation = (c("numbers") > c("p") * numbered) & (_ll(c("numbers"), c("p"), numbered, between(c("numbers") / c("p"), 1e-3, 0.999)) > CHI2)
    types = both.where("p >= 2").select(
        "lang", "key", (never | (abbreviation & (c("ends") == 0) & (length <= 3) & c("p").between(3, 59))).alias("pure"), (abbreviation | never).alias("short"), ((abbreviation | never) & collocation).alias("number"),
    ).where("pure or short or number")
    languages = totals.where(worded).select("lang", F.lit("").alias("key"), F.lit(False).alias("pure"), F.lit(False).alias("short"), F.lit(True).alias("number"))
    on = []
    for which in (DOTS, DOT1, QUOTE):
        m, t = c(which), c(f"t_{which}")
        often = (m >= 3) & (share(m, t) > F.greatest(F.lit(0.05), 3 * share(c("s"), c("t_s"))))
        on.append(both.where(often & (_ll(m, m + c("s"), share(t, t + c("t_s")) * 0.999 + 1e-4, F.lit(0.99)) > 3.8)).select("lang", F.lit(which).alias("which"), "key"))
    return Model(settled(types.unionByName(languages)), settled(on[0].unionByName(on[1]).unionByName(on[2])))


def fit(blocks: DataFrame) -> dict:
    """The statistics of all blocks as sets, for single texts: see `split`."""
    return collected(statistics(read(blocks, F.lit(False)).where("kind is not null").select("lang", "kind", "key", "sub", "n")))


def collected(model: Model) -> dict:
    """A small model, as sets."""
    types, on = model.types.collect(), model.on.collect()
    return {f: {(r["lang"], r["key"]) for r in types if r[f]} for f in ("pure", "short", "number")} | {"on": {(r["lang"], r["which"], r["key"]) for r in on}}


def split(text: str, model: dict) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, by collected statistics; none for a text of white space only."""
    lang, cuts = Reader().read(text, count=False)
    out, at = [], 0
    for cut in [*(end for end, *how in cuts if not _goes_on(lang, *how, model)), len(text)]:
        part = text[at:cut]
        s = part.strip()
        if s:
            a = at + part.index(s)
            out.append((a, a + len(s)))
        at = cut
    return out


def _goes_on(lang: str, which: str, key: str, flags: int, model: dict) -> bool:
    if which != POINT:
        return (lang, which, key) in model["on"]
    return bool((lang, key) in model["pure"] or flags & NUMBER and {(lang, ""), (lang, key)} & model["number"] or flags & INITIAL and (lang, key) not in model["short"])


def sentences(blocks: DataFrame, kept: F.Column | None = None) -> DataFrame:
    """doc_id, block_no, start_pos, end_pos of each sentence of the blocks that are `kept` (all, if none is named); white space between
    sentences belongs to none. The statistics are those of all blocks.

    Equal rows count once; null texts and texts of white space have no sentence; two texts under one key give the
    sentences of both; a text without any end mark is one sentence, of whatever length.
    """
    seen = read(blocks, F.lit(True) if kept is None else kept)
    model = statistics(seen.where("kind is not null").select("lang", "kind", "key", "sub", "n"))
    rows = seen.where("kind is null").select("doc_id", "block_no", "lang", "first", "last", "ends", "nexts", "which", "keys", "flags").withColumn("id", F.xxhash64("first", "last", "ends", "keys"))
    place = ["doc_id", "block_no", "id"]
    marks_ = rows.select(*place, "lang", F.posexplode(F.arrays_zip("which", "keys", "flags")).alias("i", "m")).select(*place, "lang", "i", "m.which", F.col("m.keys").alias("key"), "m.flags").where("which <> ''")
    points, flagged = marks_.where(F.col("which") == POINT), lambda flag: F.col("flags").bitwiseAND(flag) != 0
    firm = settled(model.types.where("key <> '' and (pure or number)"))
    letters = model.types.where("short and length(key) = 1").select("lang", "key")  # bounded by the letters of the languages
    parts = [
        met(points, firm, ["lang", "key"], "id").where(F.col("pure") | flagged(NUMBER)),
        points.where(flagged(NUMBER)).join(F.broadcast(model.types.where("key = ''").select("lang")), "lang"),
        points.where(flagged(INITIAL)).join(F.broadcast(letters), ["lang", "key"], "left_anti"),
        met(marks_.where(F.col("which") != POINT), model.on, ["lang", "which", "key"], "id"),
    ]
    going = reduce(DataFrame.unionByName, [p.select(*place, "i") for p in parts]).groupBy(*(F.col(c).alias(f"g_{c}") for c in place)).agg(F.collect_set("i").alias("going"))
    both = rows.join(going, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in place]), "left")
    cuts = F.filter(F.transform("ends", lambda e, i: F.struct(e.alias("end"), F.get("nexts", i).alias("next"), i.alias("i"))), lambda x: (F.col("going").isNull() | ~F.array_contains("going", x["i"])) & (x["next"] < F.col("last")))
    starts, ends = F.concat(F.array("first"), F.transform("cuts", lambda x: x["next"])), F.concat(F.transform("cuts", lambda x: x["end"]), F.array("last"))
    whole = both.withColumn("cuts", cuts).select("doc_id", "block_no", F.explode(F.arrays_zip(starts.alias("start_pos"), ends.alias("end_pos"))).alias("s"))
    return whole.select("doc_id", "block_no", "s.start_pos", "s.end_pos").where("end_pos > start_pos").distinct()


def found(blocks: DataFrame) -> DataFrame:
    """Sentences of p and note blocks, by the statistics of the same."""
    return sentences(blocks.where("kind in ('p', 'note')"))


def checks(blocks: DataFrame) -> DataFrame:
    """doc_id, block_no, first, last (of all sentences of the block's text) and whole: in order, apart, with white space alone between them."""
    body = blocks.where("kind in ('p', 'note') and text is not null").select("doc_id", "block_no", "text").distinct()
    g = found(blocks).groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos"))).alias("s"))
    both = body.join(g, ["doc_id", "block_no"])
    gaps = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.when(i == 0, "").otherwise(F.substring(F.col("text"), F.get("s", i - 1)["end_pos"] + 1, F.get("s", i)["start_pos"] - F.get("s", i - 1)["end_pos"])))
    apart = F.forall(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (F.get("s", i)["end_pos"] > F.get("s", i)["start_pos"]) & ((i == 0) | (F.get("s", i)["start_pos"] >= F.get("s", i - 1)["end_pos"])))
    blank = ~F.array_join(gaps, "").rlike("(?U)[^\\s\\x{1c}-\\x{1f}\\x{85}]")
    return both.select("doc_id", "block_no", F.get("s", 0)["start_pos"].alias("first"), F.element_at("s", -1)["end_pos"].alias("last"), (apart & blank).alias("whole"))
