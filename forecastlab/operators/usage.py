"""Usage and timing roll-ups, and audits of how well columns are filled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastlab.functions.decision import token_cost

TOKENS = ["tokens_in", "tokens_out", "tokens_cached", "tokens_written"]
RATES = ["r_in", "r_out", "r_cached", "r_written"]


def priced(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Calls with their cost; rates is the rate card, a row a model, and small by its nature."""
    return calls.join(F.broadcast(rates), "model", "left").withColumn("cost", token_cost([F.col(t) for t in TOKENS], [F.col(r) for r in RATES]))


def usage_rollup(calls: DataFrame, rates: DataFrame, by: str) -> DataFrame:
    sums = [F.sum(F.coalesce(t, F.lit(0))).alias(t) for t in TOKENS]
    unknown = F.col("tokens_in").isNull() & F.col("tokens_out").isNull()
    return priced(calls, rates).groupBy(by).agg(*sums, F.sum("cost").alias("cost"), F.count("*").alias("n_calls"), F.count_if(unknown).alias("n_unknown"), F.count_if(F.col("cost").isNull()).alias("n_unpriced"))


def timing_rollup(timings: DataFrame, phases: dict[str, str]) -> DataFrame:
    """Seconds by phase over all stages; timings has a map from stage to seconds. Stages without a phase are 'other'."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in phases.items() for x in kv]), F.col("stage"))
    long = timings.select(F.explode("stages").alias("stage", "seconds"))
    return long.groupBy(F.coalesce(name, F.lit("other")).alias("phase")).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def lens_totals(timings: DataFrame) -> DataFrame:
    """Seconds by stage over all events, the longest first."""
    return timings.select(F.explode("stages").alias("stage", "seconds")).groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n")).orderBy(F.desc("seconds"), "stage")


def insider_counts(trades: DataFrame, contexts: DataFrame, notable: Column, smart: Column) -> DataFrame:
    """Per event with a context: all of its trades, notable ones and those of smart traders; other events are left out."""
    some = trades.join(contexts.select("event_id").distinct(), "event_id", "left_semi")
    return some.groupBy("event_id").agg(F.count("*").alias("total"), F.count_if(notable).alias("notable"), F.count_if(smart).alias("smart"))


def populated(c: str, kind: str) -> Column:
    """Whether a value is there: empty texts, arrays and maps are missing, zeros are not."""
    if kind == "string":
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.col(c).isNotNull()


def populate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: how many rows have it, of how many, the share, and a mark for all or at least half. One pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("total"), *[F.count_if(populated(c, kinds[c])).alias(c) for c in columns])
    long = one.select("total", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("field", "populated"))
    rate = F.try_divide(F.col("populated"), F.col("total"))
    return long.select("field", "populated", "total", rate.alias("rate"), F.when(rate >= 1, "full").when(rate >= 0.5, "partial").otherwise("sparse").alias("mark"))


def loss_vs_win_profile(df: DataFrame, features: list[str], won: str = "won") -> DataFrame:
    """For each feature its mean in wins and in losses, and their difference in standard deviations; null unless both classes are there."""
    stats = [x for f in features for x in (F.avg(F.when(F.col(won) == 1, F.col(f))).alias(f"w_{f}"), F.avg(F.when(F.col(won) == 0, F.col(f))).alias(f"l_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    one = df.filter(F.col(won).isNotNull()).agg(*stats)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"w_{f}").alias("mean_won"), F.col(f"l_{f}").alias("mean_lost"), F.col(f"s_{f}").alias("sd")) for f in features])
    return one.select(F.inline(rows)).select("feature", "mean_won", "mean_lost", F.try_divide(F.col("mean_won") - F.col("mean_lost"), F.col("sd")).alias("difference"))


def total(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)
