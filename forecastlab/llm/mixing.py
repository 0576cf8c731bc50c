"""Mixing sources to target weights: fixed-length blocks of words, drawn by shard and joined by their index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, root_scale, word_count


def fill_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets by weight that add up to share of all sizes; none is over cap times its size, the excess goes to the others by weight."""
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        for i in full or open_:
            target[i] = cap * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def source_key(source: str = "source"):
    """A source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def plan_sources(rows: DataFrame, block_words: int, cycle: tuple[float, ...], share: float, cap: float) -> pd.DataFrame:
    """One row for each source, by code point, null last: its size, target, blocks and the block draws that come nearest the target.

    The number of sources bounds what the driver holds: a row for each.
    """
    found = [(r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s in found]
    targets = fill_targets(sizes, [cycle[i % len(cycle)] for i in range(len(found))], share, cap)
    blocks = [-(-s // block_words) for s in sizes]
    draws = [min(int(cap * b), round(t * b / s)) if s else 0 for s, t, b in zip(sizes, targets, blocks)]
    return pd.DataFrame({
        "skey": ["null" if k is None else f"={k}" for k, _ in found], "src": range(len(found)), "source_size": sizes, "target": targets, "blocks": blocks, "draws": draws,
    }).astype({"src": "int32", "source_size": "int64", "target": "float64", "blocks": "int64", "draws": "int64"})


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """The number of good ones among n drawn without return, by inverting the distribution at u, whatever the sizes.

    Probabilities are summed over 8 standard deviations around the mode, beyond which less than 1e-15 lies; that is
    some 16 times the square root of n / 4 numbers, a few million for 1e11 blocks.
    """
    least, most, total = max(0, n - bad), min(good, n), good + bad
    if least == most:
        return least
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    wide = 30 + int(8 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(least, mode - wide), min(most, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    below = np.cumsum(np.exp(logs - logs.max()))
    return low + min(int(np.searchsorted(below, u * below[-1], side="right")), high - low)


def _part(quota: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of n draws without return fall on each source: multinomial counts, given that all quotas are used up in the end."""
    out, total = np.zeros(len(quota), dtype=np.int64), int(quota.sum())
    for i, (q, u) in enumerate(zip(quota.tolist(), rng.random(len(quota)).tolist())):
        out[i] = hypergeometric(q, total - q, n, u)
        total, n = total - q, n - int(out[i])
    return out


def shard_counts(shard: int, shards: int, slots: int, quota: tuple[int, ...], seed: int, node=None) -> tuple[np.ndarray, np.ndarray]:
    """The draws from each source in one output shard, and from each source in all shards before it.

    Shards are the leaves of a binary tree. Each node splits its quotas between its halves by a seeded draw, so any task
    finds the counts of any shard by itself, in as many steps as the tree is deep, and all tasks agree.
    """
    node = node or _node
    low, high, before, here = 0, shards, np.zeros(len(quota), dtype=np.int64), np.array(quota, dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = node(low, high, (mid - low) * slots, here, seed)
        if shard < mid:
            high, here = mid, left
        else:
            low, before, here = mid, before + left, here - left
    return here, before


def _node(low: int, high: int, n: int, quota: np.ndarray, seed: int) -> np.ndarray:
    return _part(quota, min(n, int(quota.sum())), np.random.default_rng([seed, low, high]))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of indexes below n under a pseudorandom permutation of 0 to n - 1: a four-round Feistel network, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            with np.errstate(over="ignore"):
                z = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def draw_slots(spark, plan: pd.DataFrame, slots_per_shard: int, seed: int) -> DataFrame:
    """The mix as slots: shard, src, block, epoch. Slot j of a source takes the block that the source's permutation has at j modulo its blocks."""
    quota, blocks = tuple(map(int, plan["draws"])), tuple(map(int, plan["blocks"]))
    shards = max(1, -(-sum(quota) // slots_per_shard))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = lru_cache(maxsize=256)(lambda low, high, n, here: _node(low, high, n, np.frombuffer(here, dtype=np.int64), seed))
        node = lambda low, high, n, here, _: memo(low, high, n, here.tobytes())
        for frame in frames:
            for shard in frame["id"]:
                here, before = shard_counts(int(shard), shards, slots_per_shard, quota, seed, node)
                for src in np.flatnonzero(here):
                    j = np.arange(before[src], before[src] + here[src])
                    yield pd.DataFrame({"shard": shard, "src": np.int32(src), "block": permuted(j % blocks[src], blocks[src], seed * 1_000_003 + int(src)), "epoch": (j // blocks[src]).astype(np.int32)})

    return spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 64))).mapInPandas(draw, "shard long, src int, block long, epoch int")


def pack(rows: DataFrame, plan: pd.DataFrame, block_words: int) -> DataFrame:
    """rows (skey, doc_id, size, mark and others) with their place in their source: src, start, source_size, target.

    Starts are running sums of size by source in a hashed order. A source can be most rows, so sums run inside
    (source, bucket) and then over buckets, whose number grows as the square root of the rows.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(root_scale(rows.count(), 16, 1_000_000))))
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(over), F.lit(0))).join(spark.createDataFrame(plan), "skey").drop("in_bucket")
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["skey", "bucket"])
    return placed.withColumn("start", F.col("offset") + F.col("inside")).drop("h", "bucket", "inside", "offset", "blocks", "draws")


def pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The part of each row with words in each block that it reaches into: block, first (word of the row), words."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut_up = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    first = F.greatest(F.lit(0).cast("long"), F.col("block") * block_words - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return cut_up.withColumn("first", first).withColumn("words", end - first)


def _sized(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, source, size, mark (a hash of the text, which orders rows alike in the others), skey, and others."""
    return docs.select(*others, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), source_key().alias("skey"))


def mix(rows: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 64, slots_per_shard: int = 4096, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """rows (skey, doc_id, size, mark) in place, and the slots of the mix; see mix_counts and mix_documents."""
    plan = plan_sources(rows, block_words, cycle, share, cap)
    if plan.empty:
        plan.loc[0] = ["null", 0, 0, 0.0, 0, 0]
    return cut(pack(rows, plan, block_words)), draw_slots(rows.sparkSession, plan, slots_per_shard, seed)


def mix_counts(docs: DataFrame, block_words: int = 64, **how) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words of it in the mix, repeats counted).

    Null texts have no words, and a null source is a source of its own, the last. Rows without words take nothing;
    repeated rows have places of their own. An empty table gives an empty result. No block comes more often than cap
    times, so no document exceeds cap times its size; draws are seeded, so reruns agree.
    """
    placed, slots = mix(cut(_sized(docs.select("doc_id", "text", "source"))), block_words=block_words, **how)
    # the hint: slots grow with the input, but Spark takes what Python makes of a range to be as small as the range
    times = slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    used = pieces(placed, block_words).join(times.hint("merge"), ["src", "block"], "left").withColumn("used", F.col("words") * F.coalesce("times", F.lit(0)))
    some = used.groupBy("src", "start", "doc_id", "size", "source_size", "target").agg(F.sum("used").cast("long").alias("taken"))
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(out).unionByName(none.select(out))


def mix_documents(docs: DataFrame, block_words: int = 64, **how) -> DataFrame:
    """The mix as documents with the columns of docs: a row for each row and epoch that takes words of it.

    A document whose blocks are all taken in an epoch keeps its text as it is; of another, the taken words are joined
    by single spaces. n_chars is of the new text. Documents that the mix takes nothing of, such as those without
    words, have no row; an empty table gives an empty result. Rows are numbered and kept once, with their texts, so
    repeated rows have places, words and rows of their own; other columns, whatever their names, go along.
    """
    numbered = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("no")))
    rows = cut(_sized(numbered.select("row.doc_id", "row.text", "row.source", "no"), "no"))
    placed, slots = mix(rows, block_words=block_words, **how)
    taken = pieces(placed, block_words).join(slots.select("src", "block", "epoch").hint("merge"), ["src", "block"])
    runs = taken.groupBy("no", "size", "epoch").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
    found = numbered.join(runs, "no")
    # the outer transform binds the words, so that they are found once a row and only in rows that are taken in part
    some = F.transform(
        F.array(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))),
        lambda words: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, p["first"].cast("int") + 1, p["words"].cast("int")))), " "),
    )[0]
    out = found.withColumn("text", F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(some))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
