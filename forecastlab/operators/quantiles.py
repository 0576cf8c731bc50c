"""Exact quantiles and places by ranges of the sorted value, so that no task holds all values of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt to.
RANGES = 256


def range_edges(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """One row: ascending bounds of ranges of about equal numbers of rows, from mergeable sketches."""
    return df.agg(F.array_distinct(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(10_000))).alias("_edges"))


def range_of(value: str) -> Column:
    """The range of a value: how many edges are below it. Equal values share one."""
    return F.size(F.filter("_edges", lambda e: e < F.col(value)))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] = ()) -> DataFrame:
    """by, n, q: the number of known values of each group, and their exact quantiles with linear interpolation.

    Equal values are one row with their number. These are dealt to ranges; a window adds up numbers inside a range, another
    one over the ranges of a group, of which there are 256 at most; and each needed rank picks the value that holds it. An
    empty table gives no row.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    placed = counts.join(F.broadcast(range_edges(counts, "_v"))).withColumn("_r", range_of("_v")).drop("_edges")  # one row of edges
    all_of = Window.partitionBy(*by)
    sums = placed.groupBy(*by, "_r").agg(F.sum("_k").alias("_s"))
    before = sums.select(
        *by, "_r", F.sum("_s").over(all_of).alias("n"),
        F.coalesce(F.sum("_s").over(all_of.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.sum("_k").over(Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumn("_upto", inside).join(before, [*by, "_r"]).withColumn("_end", F.col("_before") + F.col("_upto"))
    start = F.col("_end") - F.col("_k")
    at = lambda rank: F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col("_v")))
    place = [F.lit(s) * (F.col("n") - 1) for s in shares]
    picks = [x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"_l{i}"), at(F.ceil(p)).alias(f"_u{i}"))]
    found = ranked.groupBy(*by, "n").agg(*picks)
    between = [F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(*by, "n", F.array(*between).alias("q"))


def global_places(df: DataFrame, by: list[str], classes: list[Column], score: str, ties: list[str]) -> DataFrame:
    """df with place: the row's number in its group by classes (small numbers, ascending), then score (falling, unknown last), then ties.

    A range of scores inside a class is numbered by itself; the rows before it come from the sizes of the ranges.
    """
    edges = F.broadcast(range_edges(df, score, 64))  # one row
    names = [f"_c{i}" for i in range(len(classes))]
    ranged = df.join(edges).withColumns(dict(zip(names, classes)) | {"_r": F.when(F.col(score).isNull(), 0).otherwise(-1 - range_of(score))}).drop("_edges")
    keys = [*by, *names, "_r"]
    inside = ranged.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *ties)))
    sizes = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*by).orderBy(*names, "_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys])
    found = inside.join(starts.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_before"), same)
    return found.withColumn("place", (F.col("_before") + F.col("_i")).cast("int")).drop(*names, "_r", "_i", "_before", *[f"_s{k}" for k in keys])
