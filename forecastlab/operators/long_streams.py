"""Sorted streams of keys that may hold most of all rows: a stream is cut into ranges of time, each a task's work of its own,
and what a range leaves is carried to the next ones. Ranges have about equal numbers of rows; equal times share one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import range_edges, range_of

#: Ranges of time; a window over what they leave of a key has so many rows at most.
RANGES = 64


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def in_ranges(df: DataFrame, time: Column) -> DataFrame:
    """df with its range of time, _r."""
    timed = df.withColumn("_at", time)
    return timed.join(F.broadcast(range_edges(timed, "_at", RANGES))).withColumn("_r", range_of("_at")).drop("_edges", "_at")  # one row of edges


def join_carried(ranged: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """ranged with the columns of carried, which has one row for each key and range; null keys are keys like others."""
    names = [*keys, "_r"]
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names])
    return ranged.join(carried.withColumnsRenamed({k: f"_of_{k}" for k in names}), same).drop(*[f"_of_{k}" for k in names])


def before_range(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: list[str], time: str, ties: list[str]) -> DataFrame:
    """df with _i, the row's number in its key from 0 on, and _n, how many the key has."""
    ranged = in_ranges(df, micros(time))
    inside = F.row_number().over(Window.partitionBy(*keys, "_r").orderBy(time, *ties)) - 1
    sizes = ranged.groupBy(*keys, "_r").agg(F.count("*").alias("_s"))
    carried = sizes.select(*keys, "_r", F.coalesce(F.sum("_s").over(before_range(keys)), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_n"))
    return join_carried(ranged.withColumn("_inside", inside), carried, keys).withColumn("_i", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_r")


def with_previous(df: DataFrame, keys: list[str], time: str, ties: list[str], value: str, out: str) -> DataFrame:
    """df with the value of the key's row before, null for its first one."""
    ranged = in_ranges(df, micros(time))
    w = Window.partitionBy(*keys, "_r").orderBy(time, *ties)
    ends = ranged.groupBy(*keys, "_r").agg(F.max_by(F.struct(value), F.struct(time, *ties)).alias("_end"))
    carried = ends.select(*keys, "_r", F.lag(f"_end.{value}").over(Window.partitionBy(*keys).orderBy("_r")).alias("_carried"))
    inside = ranged.withColumns({"_first": F.row_number().over(w) == 1, "_lag": F.lag(value).over(w)})
    return join_carried(inside, carried, keys).withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_first", "_lag", "_carried", "_r")


def last_before(points: DataFrame, anchors: DataFrame, keys: list[str], point_time: str, anchor_time: str, values: list[str], through: bool = True) -> DataFrame:
    """anchors with the values of the last point of their key at or before (through) or before their time, as asof.last_before."""
    names = anchors.columns
    empty = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in names if c not in keys]
    told = points.select(*keys, micros(point_time).alias("_t"), F.lit(0 if through else 1).alias("_order"), F.struct(*values).alias("_v"), *empty, F.lit(False).alias("_ask"))
    ask = anchors.select(
        *keys, micros(anchor_time).alias("_t"), F.lit(1 if through else 0).alias("_order"), F.lit(None).cast(told.schema["_v"].dataType).alias("_v"),
        *[c for c in names if c not in keys], F.lit(True).alias("_ask"),
    )
    ranged = in_ranges(told.unionByName(ask), F.col("_t"))
    stream = Window.partitionBy(*keys, "_r").orderBy("_t", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.col("_v").isNotNull()
    ends = ranged.groupBy(*keys, "_r").agg(F.max_by(F.when(known, F.col("_v")), F.when(known, F.col("_t"))).alias("_end"))
    carried = ends.select(*keys, "_r", F.last("_end", ignorenulls=True).over(before_range(keys)).alias("_carried"))
    found = join_carried(ranged.withColumn("_found", F.last("_v", ignorenulls=True).over(stream)), carried, keys)
    filled = found.filter("_ask").withColumn("_got", F.coalesce("_found", "_carried"))
    return filled.select(*names, *[F.col(f"_got.{v}").alias(v) for v in values])
