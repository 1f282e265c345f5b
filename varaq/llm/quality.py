"""Problem 3: text statistics that tell running prose from lists, tables and junk.

Method: the distribution of a block's token and character classes, function words among them, is compared by
Jensen-Shannon divergence with structural profiles (prose, list, contents, table, junk); the nearest names the block.
The profiles are learned: a few round shares of each structure start as centres, every block of the corpus joins the
nearest, and each centre becomes the mean of its blocks, prose for each language by itself; after LEARNING such rounds
the centres are the profiles. Each round is one aggregation over numbers; at most centres times languages rows of it
reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled

#: Frequent function words; in zh, ja and th, function characters and syllables, counted inside the text.
FUNCTION_WORDS = {
    "en": "the of and to in that was for with on as at by it but not which from",
    "fr": "le la les de des du et en un une que qui dans pour sur pas est au",
    "de": "der die das und in den dem ein eine zu von mit auf nicht als ist war",
    "es": "el la los las de y en un una que no del por con se para su lo",
    "pt": "o a os as de e do da em um uma que não no na com por para",
    "ru": "и в не на что с по как из к за это так для от но же у",
    "fa": "و در به از که را این است با آن تا یا هم بود یک ولی چون اما",
    "ar": "في من على إلى أن عن ما لا هذا قد كان لم التي الذي مع أو بعد لأن",
}
FUNCTION_SYLLABLES = {"zh": "的了在是和不到这那个说有也就而所", "ja": "のはがをにでとたてるもいだすか", "th": "ที่|และ|ของ|ใน|ไม่|เมื่อ|ถ้า|ก็|ให้|ไป|มี|ว่า|ขณะ|หลัง|ก่อน"}
LANGUAGES = [*FUNCTION_WORDS, *FUNCTION_SYLLABLES]

CLASSES = ("function", "word", "capital", "number", "mixed", "comma", "end", "symbol", "leader", "repeat")
#: Shares of CLASSES that learning starts from, by structure: with function words, without them, and in scripts without spaces; by commas or bullets; and so on.
PROFILES = {
    "prose": [(0.22, 0.56, 0.07, 0.01, 0.0, 0.05, 0.08, 0.01, 0.0, 0.0), (0.10, 0.66, 0.04, 0.02, 0.0, 0.06, 0.11, 0.01, 0.0, 0.0), (0.24, 0.61, 0.01, 0.01, 0.0, 0.12, 0.01, 0.0, 0.0, 0.0), (0.03, 0.80, 0.01, 0.01, 0.0, 0.13, 0.02, 0.0, 0.0, 0.0)],
    "list": [(0.24, 0.48, 0.01, 0.0, 0.0, 0.27, 0.0, 0.0, 0.0, 0.0), (0.0, 0.66, 0.02, 0.0, 0.0, 0.32, 0.0, 0.0, 0.0, 0.0), (0.0, 0.60, 0.10, 0.05, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0)],
    "contents": [(0.0, 0.40, 0.20, 0.20, 0.0, 0.0, 0.0, 0.0, 0.20, 0.0), (0.0, 0.35, 0.07, 0.30, 0.0, 0.28, 0.0, 0.0, 0.0, 0.0)],
    "table": [(0.0, 0.10, 0.10, 0.45, 0.0, 0.0, 0.0, 0.35, 0.0, 0.0)],
    "junk": [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.20, 0.05, 0.05, 0.60, 0.05, 0.0, 0.05, 0.0, 0.0), (0.0, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.75)],
}
LEARNING, LEAST = 2, 20  # rounds, and the fewest blocks that a centre is made of

#: Letters, what may stand inside a word unseen, and what a wrong decoding leaves inside words
_LETTER = r"[\p{L}\p{M}\x80-\x9f\xa1-\xaa\xac-\xb0\xb2-\xb6\xb8-\xba\xbc-\xbe\ufffd\u20ac\u2122\u02c6\u02dc\u2030\u2039\u203a\u2044\u2200-\u22ff\u2500-\u259f\u200b-\u200d\u2060\ufeff]"
_NOTE_MARK = r"^\s*(?:[*†‡]|\(\p{Nd}+\))\s*"
_ASIAN = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_END = r"[.!?؟。！？…]+(?=[\"'”’»」』）)\]]|$|[^\p{Nd}])"
#: What is counted of one token (what stands between white space); all other counts follow from neighbouring tokens.
_COUNTED = {
    "letters": r"[\p{L}\p{M}]", "tokens": _LETTER + "+", "comma": "[,،、，;؛；]", "ends": _END, "leader": r"[·.]{3,}(?=\p{Nd})",
    "number": r"(?<![\p{L}\p{N}])±?\p{Nd}+(?:[.,٫]\p{Nd}+)*+%?(?![\p{L}\p{N}])",
    "symbol": r"[$+<=>^`|~*/\\{}\[\]_#@&•‣◦→%](?![\x80-\x9f\xc0-\xff])|^-$",
    "mixed": r"^(?=.*\p{L})(?=.*[\p{N}+/|~;:{}\[\]<>=])[\p{L}\p{N}+/|~;:{}\[\]<>=']{2,}(?<![:;])$",
}
_NEEDED = {k: frozenset(v) for k, v in {"comma": ",،、，;؛；", "ends": ".!?؟。！？…", "leader": "·.", "number": "", "symbol": "$+<=>^`|~*/\\{}[]_#@&•‣◦→%-", "mixed": "+/|~;:{}[]<>="}.items()}
_WIDE = {"cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", "kana": r"[\p{Hiragana}\p{Katakana}]", "thai": r"\p{Thai}", **{f"f_{k}": v if k == "th" else f"[{v}]" for k, v in FUNCTION_SYLLABLES.items()}}
_RAW = [*(f"f_{k}" for k in FUNCTION_WORDS), *_COUNTED, *_WIDE, "capital", "again"]
_FEATURES = "letters double, lang string, words double, mean_word_length double, symbol_ratio double, common_ratio double, " + ", ".join(f"{c} double" for c in CLASSES)


class Tokens(dict):
    """The counts of every token seen, as rows of a matrix; a token's place in it is looked up, and made where it is new."""

    def __init__(self) -> None:
        super().__init__()
        self.counted, self.wide = {k: regex.compile(v) for k, v in _COUNTED.items()}, {k: regex.compile(v) for k, v in _WIDE.items()}
        self.several: dict[str, list[int]] = {}
        for i, v in enumerate(FUNCTION_WORDS.values()):
            for w in v.split():
                self.several.setdefault(w, []).append(i)
        self.run, self.known = regex.compile(r"[\p{L}\p{M}]+"), {"": 0}
        self.rows: list[list[int]] = []
        self.more: list[tuple] = []
        self.made, self.counts, self.facts = 0, np.empty((0, len(_RAW))), np.empty((0, 6), np.int64)

    def __missing__(self, token: str) -> int:
        row = [0] * len(_RAW)
        low, n = token.lower(), len(FUNCTION_WORDS)
        word = token[:-1] if token[-1] in ".,;:!?،؛؟" else token
        plain = word.isalpha() and (word.isascii() or not _ASIAN.search(word))  # letters alone, with a mark at most
        runs = [low[: len(word)]] if plain and len(low) == len(token) else self.run.findall(low)
        for w in runs:
            for i in self.several.get(w, ()):
                row[i] += 1
        if plain:
            mark = token[len(word) :]
            row[n], row[n + 1], row[n + 2], row[n + 3] = len(word), 1, mark in (",", ";", "،", "؛"), mark in (".", "!", "?", "؟")
        else:
            seen = set(token)
            digit = any(c.isnumeric() for c in seen)
            for i, (k, r) in enumerate(self.counted.items(), n):
                # a pattern is tried only where a character that it needs is
                if k in _NEEDED and not (digit and k in ("number", "mixed")) and seen.isdisjoint(_NEEDED[k]):
                    continue
                row[i] = len(r.findall(token))
        if not plain and _ASIAN.search(token):
            for i, r in enumerate(self.wide.values(), n + len(_COUNTED)):
                row[i] = len(r.findall(token))
        # of neighbours: the word at either end, whether it starts with a capital or a digit, ends in a leader, and how it ends
        name = lambda w: self.known.setdefault(w, len(self.known)) if len(w) > 1 else 0
        first, last = (runs[0] if runs and low.startswith(runs[0]) else ""), (runs[-1] if runs and low.endswith(runs[-1]) else "")
        capital = len(token) > 1 and token[0].isupper() and token[1].islower()
        end = token[-1]
        self.more.append((name(first), name(last), capital, token[0].isdigit(), end in "·." and len(token) > 2 and token[-3:] in ("...", "···"), end.isalnum() or end in ".!?…«“\""))
        self.rows.append(row)
        self[token] = self.made + len(self.rows) - 1
        return self[token]

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """(counts, what matters to neighbours) of all tokens; those new since the last call are added."""
        if self.rows:
            self.counts = np.concatenate([self.counts, np.array(self.rows, np.float64)])
            self.facts = np.concatenate([self.facts, np.array(self.more, np.int64)])
            self.made, self.rows, self.more = len(self.counts), [], []
        return self.counts, self.facts


def _counts(texts: list[str], known: Tokens) -> np.ndarray:
    """One row of _RAW a text."""
    tokens = [t.split() for t in texts]
    lengths = np.array([len(t) for t in tokens], int)
    ids = np.fromiter(map(known.__getitem__, (w for t in tokens for w in t)), np.int64, int(lengths.sum()))
    out = np.zeros((len(texts), len(_RAW)))
    if not len(ids):
        return out
    counts, facts = known.matrices()
    owner = np.repeat(np.arange(len(texts)), lengths)
    values = counts[ids]
    before = np.r_[False, owner[1:] == owner[:-1]]  # has a token before it in its text
    first, last, capital, digit, leader, closed = facts[ids].T
    values[:, _RAW.index("capital")] = before & (capital > 0) & ~np.r_[True, closed[:-1] > 0]
    values[:, _RAW.index("again")] = before & (first > 0) & np.r_[False, last[:-1] == first[1:]]
    values[:, _RAW.index("leader")] += before & (digit > 0) & np.r_[False, leader[:-1] > 0]
    some = np.flatnonzero(lengths)
    out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some], axis=0)
    return out


def block_features(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_id")) -> DataFrame:
    """keys, h (a hash of the text), chars, words, mean_word_length, symbol_ratio, end_mark (ends like a sentence), common_ratio, lang and the class counts.

    One row per input row with a text; null texts are left out, an empty text has zero counts and the lang null. Each
    distinct token is looked at once a task; texts are then sums of rows of a matrix.
    """
    mark, end = regex.compile(_NOTE_MARK), regex.compile(r"[.!?؟。！？…][\"'”’»」』）)\]]*\s*$")
    names = [c.split()[0] for c in _FEATURES.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Tokens()
        for pdf in batches:
            if len(known) > 300_000:
                known = Tokens()
            texts = [mark.sub("", t) for t in pdf["text"]]
            chars = np.array([len(t) for t in pdf["text"]], np.int32)
            derived = _derived(_counts(texts, known), chars)
            derived["end_mark"], derived["chars"] = [end.search(t[-200:] if len(t) > 200 and not t[-200:].isspace() else t) is not None for t in texts], chars
            yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), derived[["chars", "end_mark", *names]]], axis=1)

    rows = blocks.where("text is not null").select(*keys, F.xxhash64("text").alias("h"), "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInPandas(work, f"{schema}, chars int, end_mark boolean, {_FEATURES}")


def _derived(raw: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Language, words and class counts of each row of raw counts."""
    c = {k: raw[:, i] for i, k in enumerate(_RAW)}
    latin = np.stack([c[f"f_{k}"] for k in FUNCTION_WORDS])
    spaceless = c["cjk"] * 2 > c["letters"]
    thai, kana = spaceless & (c["thai"] * 2 > c["cjk"]), spaceless & (c["kana"] * 5 > c["cjk"])
    names = np.array(list(FUNCTION_WORDS), dtype=object)[latin.argmax(axis=0)]
    lang = np.select([c["letters"] == 0, thai, kana, spaceless, latin.max(axis=0) > 0], [None, "th", "ja", "zh", names], default=None)
    syllables = np.maximum(np.maximum(c["f_zh"], np.where(kana, c["f_ja"], 0)), c["f_th"]) / 2
    words = np.where(spaceless, c["cjk"] / np.where(c["thai"] > 0, 4, 2), c["tokens"])
    out = {"function": np.where(spaceless, syllables, latin.max(axis=0)), "capital": np.minimum(c["capital"], words), "repeat": c["again"], "end": c["ends"]}
    out |= {k: c[k] for k in ("number", "mixed", "comma", "symbol", "leader")}
    out["word"] = np.maximum(words - out["function"] - out["capital"] - out["repeat"] - out["mixed"], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = {"mean_word_length": np.where(words > 0, c["letters"] / words, np.nan), "symbol_ratio": np.where(n > 0, c["symbol"] / n, np.nan), "common_ratio": np.where(words > 0, out["function"] / words, np.nan)}
    return pd.DataFrame({"letters": c["letters"], "lang": lang, "words": words} | ratios | {k: out[k] for k in CLASSES})


#: (number of the centre, structure, language or None for any, shares)
Profile = tuple[int, str, str | None, tuple[float, ...]]
START: list[Profile] = [(i, name, None, shares) for i, (name, shares) in enumerate((n, q) for n, v in PROFILES.items() for q in v)]


def _nearest(profiles: list[Profile]):
    """A vectorized function: the profile with the least Jensen-Shannon divergence (in bits) from each row's class shares."""

    def near(counts: pd.Series, lang: pd.Series) -> pd.DataFrame:
        if not len(counts):
            return pd.DataFrame({"centre": pd.Series(dtype="int32"), "structure": pd.Series(dtype=str), "divergence": pd.Series(dtype=float)})
        p = np.stack(counts.to_numpy())
        total = p.sum(axis=1, keepdims=True)
        p = p / np.where(total > 0, total, 1)
        langs = lang.to_numpy()
        d = np.empty((len(profiles), len(p)))
        bits = lambda x: -np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(axis=-1)  # noqa: E731  entropy
        h = bits(p)
        for k, (_, _, own, shares) in enumerate(profiles):
            q = np.asarray(shares) / sum(shares)
            d[k] = np.maximum(bits((p + q) / 2) - (h + bits(q)) / 2, 0)
            if own is not None:
                d[k, langs != own] = np.inf
        best = d.argmin(axis=0)
        names, numbers = np.array([x[1] for x in profiles], dtype=object), np.array([x[0] for x in profiles], np.int32)
        return pd.DataFrame({"centre": numbers[best], "structure": np.where(total[:, 0] > 0, names[best], "none"), "divergence": d[best, np.arange(len(p))]})

    return F.pandas_udf(near, "centre int, structure string, divergence double")


def classify_blocks(features: DataFrame, profiles: list[Profile] | None = None) -> DataFrame:
    """features and `structure`: prose, list, contents, table, junk, or none (no token at all); `divergence` from the nearest profile, `centre` its number."""
    near = features.withColumn("near", _nearest(profiles or START)(F.array(*(F.col(c).cast("double") for c in CLASSES)), F.col("lang")))
    return near.select("*", "near.*").drop("near")


def learned_profiles(features: DataFrame, rounds: int = LEARNING) -> list[Profile]:
    """The centres after some rounds over all blocks; one that fewer than LEAST blocks join stays as it is, prose of any language too."""
    profiles = START
    for _ in range(rounds):
        total = sum(F.col(c) for c in CLASSES)
        prose = F.col("structure") == "prose"
        joined = classify_blocks(features, profiles).where((total > 0) & (~prose | F.col("end_mark")))
        weight = F.when(prose, 1.0).otherwise(1.0 / total)  # long blocks of prose say more; of the others, each as much
        sums = joined.groupBy("centre", F.when(prose, F.col("lang")).alias("lang")).agg(F.count("*").alias("n"), *(F.sum(F.col(c) * weight).alias(c) for c in CLASSES))
        seen = [r for r in sums.where(F.col("n") >= LEAST).collect()]  # at most centres times languages
        names = {i: name for i, name, _, _ in START}
        learned = [(r["centre"], names[r["centre"]], r["lang"], tuple(float(r[c]) for c in CLASSES)) for r in seen if names[r["centre"]] != "prose" or r["lang"] is not None]
        known = {i for i, name, _, _ in learned if name != "prose"}
        profiles = sorted([x for x in START if x[0] not in known] + learned, key=lambda x: (x[0], x[2] or ""))
    return profiles


def book_statistics(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per book with p or note blocks: chars, words, mean_word_length, symbol_ratio, end_mark_share,
    common_ratio, prose_chars, prose_share, structure (of most characters), page_chars, pages.

    Equal rows count once; null or empty texts and texts without any token weigh nothing; a null doc_id is a book of its own; page_chars
    and pages come from pages_geom (null text_chars are skipped) and are null for books without pages.
    """
    body = blocks.where("kind in ('p', 'note')").select("doc_id", "block_id", "text")
    features = settled(block_features(body))  # numbers only; read for the profiles and again for the classes
    # repeated rows go here, where a row is a few numbers
    kinds = classify_blocks(features, learned_profiles(features)).select("doc_id", "block_id", "h", "chars", "words", "letters", "symbol", "function", "end_mark", "structure").distinct()
    chars = lambda s: F.sum(F.when(F.col("structure") == s, F.col("chars")).otherwise(0))
    names = [k for k in PROFILES]
    out = kinds.groupBy("doc_id").agg(
        F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum("letters").alias("letters"), F.sum("symbol").alias("symbol"), F.sum("function").alias("function"),
        F.avg(F.col("end_mark").cast("int")).alias("end_mark_share"), *(chars(k).alias(f"{k}_chars") for k in names),
    )
    top = F.array_max(F.array(*(F.struct(F.col(f"{k}_chars").alias("n"), F.lit(k).alias("k")) for k in names)))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.select(
        "doc_id", "chars", "words", ratio("letters", "words").alias("mean_word_length"), ratio("symbol", "chars").alias("symbol_ratio"), "end_mark_share",
        ratio("function", "words").alias("common_ratio"), "prose_chars", ratio("prose_chars", "chars").alias("prose_share"), top["k"].alias("structure"),
    )
    if pages is None:
        return out
    geom = pages.select("doc_id", "page_no", "text_chars").distinct().groupBy("doc_id").agg(F.sum("text_chars").alias("page_chars"), F.count_distinct("page_no").alias("pages"))
    return out.join(geom, out["doc_id"].eqNullSafe(geom["doc_id"]), "left").drop(geom["doc_id"])


def found(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return book_statistics(blocks, pages).where("prose_share < 0.5").select("doc_id")
