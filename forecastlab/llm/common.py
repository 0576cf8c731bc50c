"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from math import isqrt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the documents table, which pipeline stages pass on.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A word is a run without these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than this share of the rows is joined by broadcast, so that at most 1 / share keys are.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if (made := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        made = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that later reads survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def root_scale(n: int, least: int, most: int, by: int = 1) -> int:
    """A number of salts or buckets that grows as the square root of the rows: groups and their number both stay small."""
    return max(least, min(most, isqrt(max(n, 0)) // by))


def join_hot(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined (inner) to unique on key, where one key may hold much of rows.

    unique has one row for each key; its column weight says how many rows have the key. Keys with over HOT_SHARE
    of the total are at most 1 / HOT_SHARE, so those are broadcast and their rows never shuffled; the others shuffle.
    """
    limit = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(unique.filter(F.col(weight) > limit))
    cold = unique.filter(F.col(weight) <= limit)
    hot_keys = F.broadcast(unique.filter(F.col(weight) > limit).select(key))
    return rows.join(hot, key).unionByName(rows.join(hot_keys, key, "left_anti").join(cold, key))


def join_few_or_hot(rows: DataFrame, unique: DataFrame, key: str, weight: str, total: int, top: int, few: int = 10_000) -> DataFrame:
    """join_hot where top, the largest weight, is known: a plain join while no key has over `few` rows or HOT_SHARE of them."""
    return rows.join(unique, key) if top <= max(few, total * HOT_SHARE) else join_hot(rows, unique, key, weight, total)


def join_few(rows: DataFrame, few: DataFrame, on, how: str, most: int = 1_000_000) -> DataFrame:
    """rows semi- or anti-joined (how) to few, a table that is kept: broadcast while it has at most `most` rows, shuffled beyond."""
    return rows.join(F.broadcast(few) if few.count() <= most else few.hint("merge"), on, how)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: str) -> Iterator[None]:
    """Jobs run inside give Python at most so many rows and about such a size at a time: for rows that hold much."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch, size: int) -> Iterator:
    """An Arrow batch in pieces of size rows, so that Python objects exist for one piece at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def id_buckets(docs: DataFrame, per_bucket: int, most: int = 20_000) -> list[int]:
    """Ascending lower bounds of doc_id ranges of about per_bucket rows each; at most `most` of them, whatever the input."""
    n = docs.count()
    parts = max(1, min(most, -(-n // per_bucket)))
    if parts == 1:
        return []
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(float(c)) for c in cuts})


def in_buckets(df: DataFrame, key: str, bounds: list[int], out: str) -> DataFrame:
    """df with the index of the range of bounds that key is in: how many bounds are at most the key."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *map(float, bounds), float("inf")]
    found = Bucketizer(splits=splits, inputCol="_as_double", outputCol="_bucket").transform(df.withColumn("_as_double", F.col(key).cast("double")))
    return found.withColumn(out, F.col("_bucket").cast("int")).drop("_as_double", "_bucket")
