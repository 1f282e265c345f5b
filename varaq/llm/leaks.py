"""Problem 7: posts that hold passages of evaluation items.

Method: items and posts are cut into windows of words at every word, as long as two fifths of the item (items are
grouped by that size) and at most WINDOW words, because a passage edited at every ninth word leaves no longer window
whole. Each window gets a 64-bit SimHash of its words and word pairs. Fingerprints are cut into RADIUS + 1 blocks of
bits: two within RADIUS share at least one block whole, so no pair within the radius is missed. Posts that hit an item
are verified exactly: first by weighted shingles (the word pairs of the item near the hits, a pair that few items have
weighing more), then by a local alignment of words, which must match at least MIN_SHARE of the item's words in order
and be matches for MIN_DENSITY of its length in the post.

Items up to MAX_ITEM_BYTES go to every task and each post is compared where it lies: no join, no shuffle of posts.
More items than that meet the posts' distinct fingerprints in an equality join on (size, block, bits), and only pairs
that the join finds fetch their texts. Both ways give the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RADIUS, MIN_SHARE, MIN_DENSITY = 7, 3, 0.4, 0.6
MIN_SIMILARITY = 0.15  # weighted share of the item's word pairs; a passage in which every other pair is broken still has more
OTHER, LEFT_OUT, SWAPPED = 0.35, 0.35, 0.6  # costs in words of the alignment
MAX_ITEM_BYTES = 8_000_000
BITS = 64 // (RADIUS + 1)

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|\]\([^()\s]*\)|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_APOSTROPHE = re.compile(r"[’'‘`´​-‏­⁠﻿]")
_WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")
_RESULT = "doc_id bigint, item_id bigint, share double, words int"


def words(text: str) -> list[str]:
    """Lower-case words without markup and punctuation; in scripts without spaces each character is a word."""
    return _WORD.findall(_APOSTROPHE.sub("", _MARKUP.sub(" ", text)).lower())


def item_words(text: str) -> list[str]:
    """Without the instruction, the first of two lines."""
    lines = [s for s in text.split("\n") if s.strip()]
    return words("\n".join(lines[1:]) if len(lines) > 1 else text)


def window_size(item: int, min_share: float = MIN_SHARE) -> int:
    """The window of an item of so many words."""
    return max(1, min(WINDOW, math.ceil(min_share * item)))


class _Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def _pairs(h: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours, in order."""
    x = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ((h[1:] << np.uint64(31)) | (h[1:] >> np.uint64(33)))
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of `size` words, given the words' hashes; empty if there are fewer words.

    All 64 votes of a window are counted at once: bit k of every count lies in one 64-bit number.
    """
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    p = _pairs(h)
    top = (2 * size - 1).bit_length()
    start = (1 << top) - size  # the count then reaches 2^top exactly where the majority is ones
    planes = [np.full(n, 0xFFFFFFFFFFFFFFFF if start >> k & 1 else 0, np.uint64) for k in range(top)] + [np.zeros(n, np.uint64)]
    for source, length in ((h, size), (p, size - 1)):
        for i in range(length):
            carry = source[i : i + n]
            for k in range(top + 1):
                planes[k], carry = planes[k] ^ carry, planes[k] & carry
    return planes[top]


class Index:
    """Items by the blocks of their windows' fingerprints, and by word pair."""

    def __init__(self, items: list[tuple[int, list[str]]], min_share: float = MIN_SHARE):
        self.items, self.hashes, self.min_share = [x for x in items if x[1]], _Hashes(), min_share
        coded = [self.hashes.of(w) for _, w in self.items]
        pairs = [np.unique(_pairs(h)) for h in coded]
        seen = Counter(x for p in pairs for x in p.tolist())
        weight = lambda x: math.log(1 + len(self.items) / seen[x])
        self.pairs = [(p, np.array([weight(x) for x in p.tolist()])) for p in pairs]
        self.sizes = sorted({window_size(len(w), min_share) for _, w in self.items})
        self.by_size = {s: self._blocks(s, [(i, h) for i, h in enumerate(coded) if window_size(len(h), min_share) == s]) for s in self.sizes}

    @staticmethod
    def _blocks(size: int, coded: list[tuple[int, np.ndarray]]) -> tuple:
        rows = [(fingerprints(h, size), i) for i, h in coded]
        fp, owner = np.concatenate([f for f, _ in rows]), np.concatenate([np.full(len(f), i) for f, i in rows])
        blocks = []
        for b in range(RADIUS + 1):
            key = _block(fp, b)
            order = np.argsort(key, kind="stable")
            blocks.append((order, np.searchsorted(key[order], np.arange((1 << BITS) + 1))))
        return fp, owner, blocks

    def hits(self, fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of every pair of fingerprints of one size within RADIUS."""
        known, owner, blocks = self.by_size[size]
        out_w, out_i = [], []
        for b, (order, starts) in enumerate(blocks):
            key = _block(fp, b)
            first, count = starts[key], starts[key + 1] - starts[key]
            some = np.flatnonzero(count)
            first, count = first[some], count[some]
            w = np.repeat(some, count)
            if not len(w):
                continue
            cand = order[np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
            near = np.bitwise_count(fp[w] ^ known[cand]) <= RADIUS
            out_w.append(w[near])
            out_i.append(owner[cand[near]])
        if not out_w:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(out_w), np.concatenate(out_i)

    def similarity(self, item: int, h: np.ndarray) -> float:
        """The weighted share of the item's word pairs that stand in a stretch of words."""
        pairs, weight = self.pairs[item]
        return float(weight[np.isin(pairs, _pairs(h))].sum() / weight.sum()) if len(pairs) else 1.0


def _block(fp: np.ndarray, b: int) -> np.ndarray:
    return ((fp >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def coverage(item: list[str], post: list[str]) -> tuple[int, int, int]:
    """(matched, start, end): the words of the item that the best local alignment with the post matches, and where it stands in the post.

    Two rows of the alignment are held, each with what its best paths matched and where they began.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.array([code.get(w, -1) for w in post], int)
    n = len(p)
    at = np.arange(n + 1)
    slope = OTHER * at
    score, matched, begin = np.zeros(n + 1), np.zeros(n + 1, int), at.copy()
    best = (0.0, 0, 0, 0)
    for w in item:
        same = p == code[w]
        new = score - LEFT_OUT
        fresh = new <= 0
        new[fresh] = 0
        hit, start = np.where(fresh, 0, matched), np.where(fresh, at, begin)
        step = score[:-1] + np.where(same, 1.0, -SWAPPED)
        up = step > new[1:]
        new[1:][up], hit[1:][up], start[1:][up] = step[up], (matched[:-1] + same)[up], begin[:-1][up]
        raised = new + slope
        top = np.maximum.accumulate(raised)
        origin = np.maximum.accumulate(np.where(raised == top, at, 0))
        score, matched, begin = top - slope, hit[origin], start[origin]
        j = int(score.argmax())
        if score[j] > best[0] + 1e-9:
            best = (float(score[j]), int(matched[j]), int(begin[j]), j)
    return best[1:]


def _search(held: list[tuple], index: Index) -> list[tuple]:
    """(doc_id, item_id, share, words) of the passages in some posts, given as (doc_id, words)."""
    lengths = np.array([len(ws) for _, ws in held])
    h = index.hashes.of([w for _, ws in held for w in ws])
    owner, starts = np.repeat(np.arange(len(held)), lengths), np.cumsum(lengths) - lengths
    pairs: dict[tuple[int, int], list[int]] = {}
    for size in index.sizes:
        for a in range(0, len(h) - size + 1, 50_000):  # long texts in stretches, so that memory stays bounded
            f = fingerprints(h[a : a + 50_000 + size - 1], size)
            inside = np.flatnonzero(owner[a : a + len(f)] == owner[a + size - 1 : a + size - 1 + len(f)])
            w, i = index.hits(f[inside], size)
            for x, item in zip((inside[w] + a).tolist(), i.tolist()):
                pairs.setdefault((int(owner[x]), item), []).append(x - int(starts[owner[x]]))
    out = []
    for (doc, item), at in pairs.items():
        item_id, q = index.items[item]
        p, reach, best = held[doc][1], math.ceil(len(q) / MIN_DENSITY), (0, 0, 0)  # no passage is longer than reach
        here = h[starts[doc] : starts[doc] + lengths[doc]]
        at.sort()
        a = at[0]
        for k, x in enumerate(at):  # stretches around the hits, so that a long post is aligned only where it may match
            if k == len(at) - 1 or at[k + 1] - x > 2 * reach:
                first, last = max(a - reach, 0), min(x + WINDOW + reach, len(p))
                for cut in range(first, max(last - reach, first + 1), 4 * len(q)):  # and in steps, so that memory stays bounded
                    upto = min(cut + 4 * len(q) + reach, last)
                    if index.similarity(item, here[cut:upto]) >= MIN_SIMILARITY:
                        c = coverage(q, p[cut:upto])
                        best = max(best, c) if c[0] >= MIN_DENSITY * (c[2] - c[1]) else best
                a = at[k + 1] if k < len(at) - 1 else a
        share = best[0] / len(q)
        if share >= index.min_share - 1e-9:
            out.append((held[doc][0], item_id, share, best[2] - best[1]))
    return out


def leaks(documents: DataFrame, items: DataFrame, min_share: float = MIN_SHARE, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, share (of the item's words that stand in the post), words (of the passage in the post).

    Equal rows count once; null ids or texts and items without words match nothing; a post with several passages of an
    item counts with its best one; items of few words are searched by windows of two fifths of them; whole texts of any
    length are read. max_item_bytes only chooses how items travel, not what is found.
    """
    known = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    posts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _by_broadcast(posts, known, min_share) if size <= max_item_bytes else _by_join(posts, known, min_share)
    best = F.max_by(F.struct("share", "words"), F.struct("share", "words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.share", "b.words")


def _by_broadcast(posts: DataFrame, known: DataFrame, min_share: float) -> DataFrame:
    shared = posts.sparkSession.sparkContext.broadcast([(r["item_id"], item_words(r["text"])) for r in known.collect()])  # checked against MAX_ITEM_BYTES

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(shared.value, min_share)
        for pdf in batches:
            out, held, size = [], [], 0
            for k, (d, t) in enumerate(zip(pdf["doc_id"], pdf["text"]), 1):
                held.append((d, words(t)))
                size += len(held[-1][1])
                if size >= 60_000 or k == len(pdf):
                    out += _search(held, index)
                    held, size = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "words"])

    return posts.mapInPandas(work, _RESULT)


def _by_join(posts: DataFrame, known: DataFrame, min_share: float) -> DataFrame:
    """The same by joins: distinct fingerprints meet by block, then the pairs of post and item fetch their texts."""

    def of_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            rows = [(x, i, window_size(len(w), min_share), h) for i, x in zip(pdf["item_id"], pdf["text"]) if (w := item_words(x)) for h in [hashes.of(w)]]
            out = [(i, x, s, int(f)) for x, i, s, h in rows for f in np.unique(fingerprints(h, s)).view(np.int64)]
            yield pd.DataFrame(out, columns=["item_id", "item", "size", "fp"])

    prints = known.mapInPandas(of_items, "item_id bigint, item string, size int, fp bigint")
    sizes = [r["size"] for r in known.mapInPandas(_sizes(min_share), "size int").distinct().collect()]  # at most WINDOW of them

    def of_posts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                h = hashes.of(words(t))
                for s in sizes:
                    f = np.unique(fingerprints(h, s)).view(np.int64)
                    yield pd.DataFrame({"doc_id": d, "size": s, "fp": f})

    spread = posts.mapInPandas(of_posts, "doc_id bigint, size int, fp bigint")
    block = F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("fp", BITS * b).bitwiseAND((1 << BITS) - 1).alias("bits")) for b in range(RADIUS + 1)))).alias("k")
    one = prints.select("size", "fp").distinct().select("size", F.col("fp").alias("item_fp"), block).select("size", "item_fp", "k.*")
    two = spread.select("size", "fp").distinct().select("size", "fp", block).select("size", "fp", "k.*")  # a window that all posts share comes once
    near = two.join(one, ["size", "b", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("size", "fp", "item_fp").distinct()
    owners = near.join(prints.select("size", F.col("fp").alias("item_fp"), "item_id", F.xxhash64("item").alias("h")), ["size", "item_fp"])
    pairs = spread.join(owners, ["size", "fp"]).select("doc_id", "item_id", "h").distinct()
    full = known.select("item_id", F.xxhash64("text").alias("h"), F.col("text").alias("item"))
    both = pairs.join(full, ["item_id", "h"]).join(posts, "doc_id").select("doc_id", "text", "item_id", "item")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item_id, item, d, t in zip(pdf["item_id"], pdf["item"], pdf["doc_id"], pdf["text"]):
                out += _search([(d, words(t))], Index([(item_id, item_words(item))], min_share))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "share", "words"])

    return both.mapInPandas(verify, _RESULT)


def _sizes(min_share: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"size": sorted({window_size(len(w), min_share) for t in pdf["text"] if (w := item_words(t))})}, dtype="int32")

    return work


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")
