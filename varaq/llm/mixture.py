"""Problem 8: mixing sources to target shares of the total tokens.

Method: temperature mixing. The source token shares are exponentiated and normalised: weight ~ share ^ a times, where
there are targets, target ^ (1 - a). So a = 0 gives the targets (or, without any, equal weights) and a = 1 the sources
as they are. The exponent is found by bisection: the smallest at which no source has to be repeated more often than its
cap for the wanted total, or the one whose weights have the wanted entropy. Each source's budget of tokens is then
filled by whole passes over its posts and one more pass over a block permutation of them: posts fall into blocks by a
hash, blocks come in hashed order, and posts within a block too, until the budget is full.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAST_BLOCKS, BLOCK_POSTS = 64, 50_000  # blocks a source, and posts a block beyond that


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, keys: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keys, tokens: the tokens of each text under a public byte-level vocabulary; a null or empty text has none.

    The vocabulary file (about a megabyte) is read by the driver and sent to the tasks.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        t = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([_tokens(t, s) if s else 0 for s in texts], dtype="int64")

    return documents.select(*keys, F.pandas_udf(count, "bigint")("text").alias("tokens"))


def _tokens(t, text: str, stretch: int = 100_000) -> int:
    """Very long texts in stretches cut at white space, so that time stays in proportion."""
    n, at = 0, 0
    while at < len(text):
        end = len(text) if len(text) - at <= stretch else text.rfind(" ", at + 1, at + stretch)
        end = at + stretch if end <= at else end
        n += len(t.encode_ordinary(text[at:end]))
        at = end
    return n


def weights(own: dict[str, int], target: dict[str, float], caps: dict[str, int], total: float | None = None, entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weight by source, exponent, total tokens): what each source of `target` that has tokens gives.

    With an entropy (bits) the exponent is the one whose weights have it, or the nearest that 0..1 reaches. Without a
    total it is the largest at which every source can give its weight within its cap: without an entropy, its target.
    """
    live = {s: n for s, n in own.items() if n > 0 and target.get(s, 0) > 0 and caps.get(s, 0) > 0}
    if not live:
        return {}, 0.0, 0.0
    goal = {s: target[s] / sum(target[x] for x in live) for s in live}
    share = {s: n / sum(live.values()) for s, n in live.items()}

    def at(a: float) -> dict[str, float]:
        w = {s: goal[s] ** (1 - a) * share[s] ** a for s in live}
        z = sum(w.values())
        return {s: x / z for s, x in w.items()}

    most = lambda w: min(caps[s] * live[s] / w[s] for s in live)  # noqa: E731  tokens that all caps allow
    bits = lambda a: -sum(x * math.log2(x) for x in at(a).values())
    if entropy is not None:
        rises = bits(1.0) > bits(0.0)
        a = _least(lambda a: bits(a) >= entropy if rises else bits(a) <= entropy)
    else:
        a = 0.0 if total is None else _least(lambda a: most(at(a)) >= total * (1 - 1e-12))
    return at(a), a, most(at(a)) if total is None else total


def _least(fits: Callable[[float], bool]) -> float:
    """The least exponent in 0..1 that fits, by bisection; 1 if none does."""
    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None, entropy: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42, of_available: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(draw, report). The wanted total in tokens is `total`, or `of_available` times what the target sources have, or the largest that allows the targets themselves.

    draw: doc_id, source, tokens, repeats (how often the post is taken, at least 1). report: source, target_share,
    available_tokens, max_repeats, exponent, weight, budget, largest_post (tokens), drawn_tokens, share, most_repeats.

    A source without posts, and one that isn't a target, gives nothing; the targets left are scaled to add up to 1, and
    the report shows the others with share 0. Posts without a source are left out. Equal rows count once. A post that
    would go over the budget is left out and the next that fits is not looked for, so a source stays under its budget by
    less than one post. Repeats of a post differ by at most one within a source. Targets listed twice count with their sum
    and least cap; a null or negative share or cap counts as 0.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    wanted = goals.select("source")  # as many rows as there are sources
    texts = documents.where("doc_id is not null and text is not null").join(wanted, "source", "left_semi").select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"), "text")
    # repeated rows go by the hashes of their texts, so that no text is shuffled
    posts = settled(token_counts(texts, tokenizer, ("doc_id", "source", "h1", "h2")).where("tokens > 0").distinct().select("doc_id", "source", "h1", "tokens"))
    sizes = {r["source"]: r for r in posts.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("posts"), F.max("tokens").alias("largest")).collect()}  # sources of `targets` only
    own = {s: r["n"] for s, r in sizes.items()}
    plan = {r["source"]: r for r in goals.collect()}
    total = of_available * sum(own.values()) if of_available is not None else total
    w, exponent, total = weights(own, {s: r["target_share"] for s, r in plan.items()}, {s: r["max_repeats"] for s, r in plan.items()}, total, entropy)
    budget = {s: min(int(w[s] * total), plan[s]["max_repeats"] * own[s]) for s in w}  # beyond what any exponent allows, the cap holds
    rows = [(s, b // own[s], b % own[s], max(LEAST_BLOCKS, -(-sizes[s]["posts"] // BLOCK_POSTS))) for s, b in budget.items()]
    budgets = spark.createDataFrame(rows, "source string, passes long, rest long, blocks long")
    order = F.xxhash64("doc_id", "h1", F.lit(seed))
    # at most a row a target
    placed = posts.join(F.broadcast(budgets), "source").withColumns({"block": F.pmod(order, F.col("blocks")), "at": F.xxhash64("doc_id", "h1", F.lit(seed + 1))})
    # running totals in two steps: of the blocks, then inside each block of BLOCK_POSTS or so; no source meets in one task
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("source", "block", before.alias("before"))
    inside = Window.partitionBy("source", "block").orderBy("at", "doc_id", "h1").rowsBetween(Window.unboundedPreceding, 0)
    taken = placed.withColumn("upto", F.sum("tokens").over(inside)).join(offsets, ["source", "block"])
    repeats = F.col("passes") + F.when(F.col("before") + F.col("upto") <= F.col("rest"), 1).otherwise(0)
    draw = taken.select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    sums = draw.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    facts = spark.createDataFrame([(s, float(r["target_share"]), int(r["max_repeats"]), int(own.get(s, 0)), float(exponent), float(w.get(s, 0.0)), budget.get(s, 0), int(sizes[s]["largest"]) if s in sizes else 0) for s, r in plan.items()], "source string, target_share double, max_repeats int, available_tokens long, exponent double, weight double, budget long, largest_post long")
    report = facts.join(sums, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0))).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))
    everything = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("share", F.when(everything > 0, F.col("drawn_tokens") / everything).otherwise(F.lit(0.0)))
    return draw, report.select("source", "target_share", "available_tokens", "max_repeats", "exponent", "weight", "budget", "largest_post", "drawn_tokens", "share", "most_repeats")


def tempered(documents: DataFrame, targets: DataFrame, entropy: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(draw, report) as of `mixture`, without targets: share ^ a of the sources in `targets`, with the entropy (bits) of the target shares
    (of the sources that have posts) or the one given; caps as in `targets`."""
    with_posts = documents.where("source is not null and text is not null and text <> ''").select("source").distinct()
    live = targets.join(with_posts, "source", "left_semi")
    if entropy is None:
        shares = [r["w"] for r in live.groupBy("source").agg(F.sum("target_share").alias("w")).where("w > 0").collect()]
        entropy = -sum(w / sum(shares) * math.log2(w / sum(shares)) for w in shares)
    equal = targets.withColumn("target_share", F.when(F.col("target_share") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    return mixture(documents, equal, None, entropy, tokenizer, seed)


def checks(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """mix, source, posts and what must hold of each mix (targets, limited, tempered): no post beyond its cap, the budget met to less
    than one post, each post drawn once, the exponent found where it belongs."""
    made = {"targets": mixture(documents, targets), "limited": mixture(documents, targets, of_available=0.9), "tempered": tempered(documents, targets)}
    posts = documents.where("doc_id is not null and source is not null and text <> ''").select("doc_id", "source", F.xxhash64("text").alias("h")).distinct().groupBy("source").agg(F.count("*").alias("posts"))
    out = []
    for name, (draw, report) in made.items():
        drawn = draw.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("sum"), F.max("repeats").alias("most"), F.count("*").alias("rows"))
        both = report.join(drawn, "source", "left").join(posts, "source", "left").na.fill(0, ["sum", "most", "rows", "posts"])
        # the least exponent: none is needed, or some source just meets its cap
        full = F.max(F.when(F.col("available_tokens") > 0, (F.col("budget") + 1) / (F.col("max_repeats") * F.col("available_tokens")))).over(Window.partitionBy(F.lit(1)))
        inside = {"targets": F.col("exponent") == 0, "limited": (F.col("exponent") == 0) | (full >= 1)}.get(name, (F.col("exponent") > 0) & (F.col("exponent") < 1))
        out.append(both.select(
            F.lit(name).alias("mix"), "source", "posts", (F.col("most") <= F.col("max_repeats")).alias("within_cap"), (F.col("rows") <= F.col("posts")).alias("drawn_once"),
            ((F.col("sum") == F.col("drawn_tokens")) & (F.col("sum") <= F.col("budget"))).alias("within_budget"), (F.col("budget") - F.col("sum") <= F.col("largest_post")).alias("budget_met"), inside.alias("exponent_found"),
        ))
    return out[0].unionByName(out[1]).unionByName(out[2])
