"""Sharding by extendible hashing: only oversized buckets split on another hash bit until every shard fits its byte limit."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Bits of the hash that a bucket can split on: 15 hexadecimal digits of SHA-256, which fit a signed long.
HASH_BITS = 60


def shard_rows(docs: DataFrame, limit_bytes: int, step: int = 8) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, shard, depth, doc_bytes, shard_bytes, shard_docs, oversized.

    A shard is the bucket of a hash prefix, named by its bits; depth is how many they are. The hash is of doc_id and
    text, so null ids and copies spread; null texts count 0 bytes, like empty ones. Starting from one bucket, a bucket
    of more than limit_bytes splits on its next bit, others stay. Rows that repeat both doc_id and text share all
    bits; where they alone exceed the limit they are dealt out to numbered overflow pages of the bucket, each within
    the limit. Only a single document larger than the limit is left oversized, alone in its shard. An empty table gives
    an empty result; other columns of docs are not looked at.

    Work is on (doc_id, hash, bytes) rows, once computed. The directory is built from byte totals of hash cells, a few
    for each shard to be, and looked up by the cell; further rounds look at the rows of cells that are still too large.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), F.lit(":"), F.coalesce("text", F.lit("")))
    rows = cut(docs.select(
        "doc_id",
        F.conv(F.substring(F.sha2(key, 256), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("doc_bytes"),
    ))
    total, n = rows.agg(F.coalesce(F.sum("doc_bytes"), F.lit(0)), F.count("*")).first()
    low, high = 0, min(HASH_BITS, max(1, ceil(log2(max(2, total / limit_bytes)))) + 3)
    pending, placed = rows, []
    while True:
        pending, low, high, found = _split_round(pending, limit_bytes, low, high, n)
        placed.append(found)
        if high == HASH_BITS or pending.isEmpty():
            break
        low, high = high, min(HASH_BITS, high + step)
    out = reduce(DataFrame.unionByName, placed)
    fits = out.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("shard_docs") == 1))
    return fits.select(*_OUT, (F.col("shard_bytes") > limit_bytes).alias("oversized")).unionByName(_pages(out, limit_bytes))


_OUT = ["doc_id", "shard", "depth", "doc_bytes", "shard_bytes", "shard_docs"]


def _split_round(pending: DataFrame, limit: int, low: int, high: int, n: int) -> tuple[DataFrame, int, int, DataFrame]:
    """Splits buckets of depth low as far as depth high: the rows whose bucket still does not fit, and the others with theirs."""
    celled = pending.withColumn("cell", F.shiftright("h", HASH_BITS - high))
    cells = cut(celled.groupBy("cell").agg(F.sum("doc_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1")))
    first = low + 1 if low else 0
    at = cells.select("*", F.explode(F.sequence(F.lit(first), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = at.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
    fits = buckets.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("h0") == F.col("h1")) | (F.col("depth") == HASH_BITS))
    least = at.join(fits.filter("fits"), ["depth", "prefix"]).groupBy("cell").agg(F.max("n").alias("cell_rows"), F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_docs"), "depth").alias("s"))
    directory = cut(least.select("cell", "cell_rows", "s.*"))
    found = join_hot(celled, directory, "cell", "cell_rows", n)
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    still = celled.join(cells.join(directory, "cell", "left_anti").select("cell"), "cell", "left_semi").select("doc_id", "h", "doc_bytes")
    return still, low, high, found.select("doc_id", name.alias("shard"), "depth", "doc_bytes", "shard_bytes", "shard_docs")


def _pages(out: DataFrame, limit: int) -> DataFrame:
    """Rows that no bit tells apart, dealt out to pages: they repeat each other, so their number and page are all that is needed."""
    alike = out.filter((F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).groupBy("doc_id", "shard", "depth", "doc_bytes").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("doc_bytes"))).cast("long")
    pages = alike.withColumn("each", each).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("each")).cast("long"))).alias("page"))
    here = F.least("each", F.col("n") - F.col("page") * F.col("each"))
    return pages.withColumn("here", here).select(
        "doc_id", F.concat("shard", F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("page").cast("string")).alias("shard"), "depth", "doc_bytes",
        (F.col("here") * F.col("doc_bytes")).alias("shard_bytes"), F.col("here").alias("shard_docs"), (F.col("doc_bytes") > limit).alias("oversized"), F.explode(F.sequence(F.lit(1).cast("long"), "here")).alias("_"),
    ).drop("_")


def write_shards(docs: DataFrame, path: str, limit_bytes: int) -> None:
    """Writes each row of docs once, with all its columns, in a folder for each shard; a shard's rows meet in one task, which the byte limit bounds.

    Rows find their shard by a digest of doc_id and text, so rows of one id with different texts go to the shards of both. Rows that
    repeat both, whose shard has pages, are numbered by salts, so that none is numbered in one task, and each number has its page.
    Null ids and texts count as in shard_rows, an empty table writes nothing, and a column of docs named shard is replaced.
    """
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    rows = cut(docs.drop("shard").withColumns({"_key": key, "_salt": F.pmod(F.monotonically_increasing_id(), F.lit(64))}))
    shards = shard_rows(rows.select(F.col("_key").alias("doc_id"), "text"), limit_bytes).groupBy("doc_id", "shard").agg(F.count("*").alias("here"))
    pages = Window.partitionBy("_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("here").over(pages), F.lit(0))
    placed = cut(shards.withColumnRenamed("doc_id", "_key").select("_key", "shard", first.alias("_first"), (first + F.col("here")).alias("_end"), F.count("*").over(Window.partitionBy("_key")).alias("_pages")))
    single = placed.filter("_pages = 1").select("_key", "shard")
    paged = placed.filter("_pages > 1").select("_key", "shard", "_first", "_end")
    often = rows.join(paged.select("_key").distinct(), "_key", "left_semi")
    sizes = often.groupBy("_key", "_salt").agg(F.count("*").alias("_s"))
    starts = sizes.select("_key", "_salt", F.coalesce(F.sum("_s").over(Window.partitionBy("_key").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = often.withColumn("_i", F.row_number().over(Window.partitionBy("_key", "_salt").orderBy(F.lit(0))) - 1).join(starts, ["_key", "_salt"])
    number = F.col("_start") + F.col("_i")
    dealt = inside.withColumn("_number", number).join(paged, "_key").filter((F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end")))
    names = [*[c for c in docs.columns if c != "shard"], "shard"]
    found = rows.join(single, "_key").select(*names).unionByName(dealt.select(*names))
    found.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
