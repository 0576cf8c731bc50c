"""Retro joins: forecasts with resolutions and facts, deduplication, upserts and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order. A key's rows meet in one task after a map-side top one, as min_by does not hold them."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(df.columns)


def dedup_earliest(forecasts: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """The oldest run's row of each key, and how many rows that drops."""
    kept = first_per_key(forecasts, [key], [F.col("run_id"), F.col("line_no"), F.col("event_id"), F.col("partkey"), F.col("suppkey"), F.col("p"), F.col("day")])
    return kept, forecasts.agg((F.count("*") - F.count_distinct(key)).alias("dropped"))


def join_resolutions_by_slug(forecasts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Forecasts with the outcome of the same run's resolution; unresolved ones stay, as not settled."""
    return forecasts.join(resolutions, ["run_id", "slug"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))


def join_resolutions_by_event(forecasts: DataFrame, resolutions: DataFrame, per_run: bool = True) -> DataFrame:
    """Forecasts of settled events. Per run, a run's last resolution of an event counts; else all runs' resolutions match, and rows multiply."""
    done = resolutions.filter("settled AND outcome IS NOT NULL")
    if not per_run:
        return forecasts.join(done.select("event_id", "outcome"), "event_id")
    last = done.groupBy("run_id", "event_id").agg(F.max_by("outcome", "line").alias("outcome"))
    return forecasts.join(last, ["run_id", "event_id"])


def attach_trader_profile(positions: DataFrame, profiles: DataFrame, order: list[Column], key: str = "address") -> DataFrame:
    """positions with the columns of their wallet's first profile in order; those without one stay, with nulls, and none multiplies."""
    known = first_per_key(profiles.filter(F.col(key).isNotNull()), [key], order)
    return positions.join(known, key, "left")


def join_post_facts(features: DataFrame, facts: DataFrame, rates: list[str]) -> DataFrame:
    """features with each rate's actual value and its divergence from the baseline, null where either is unknown."""
    return features.join(facts, "event_id", "left").withColumns({f"{r}_divergence": F.col(f"{r}_actual") - F.col(f"{r}_baseline") for r in rates})


def anti_already_executed(rows: DataFrame, audit: DataFrame) -> DataFrame:
    done = audit.filter(F.col("status").isin("filled", "partial", "submitted")).select("run_id", "event_no").distinct()
    return rows.join(done, ["run_id", "event_no"], "left_anti")


def align_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """One direction of each contest that both models predict."""
    return a.filter("anchor < other").join(b, ["match_id", "anchor"])


def upsert_resolutions(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Settled rows stay; others take the fresh result where there is one."""
    old, new = existing.select("slug", F.struct("settled", "outcome").alias("old")), fresh.select("slug", F.struct("settled", "outcome").alias("new"))
    pick = F.when(F.coalesce(F.col("old.settled"), F.lit(False)), F.col("old")).otherwise(F.coalesce("new", "old"))
    return old.join(new, "slug", "full").select("slug", pick.alias("r")).select("slug", "r.*")


def union_listings(lists: list[DataFrame]) -> DataFrame:
    """All lists' rows, the first list's of each slug."""
    marked = reduce(DataFrame.unionByName, [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)])
    return first_per_key(marked, ["slug"], [F.col("_list"), F.col("event_id"), F.col("market_no")]).drop("_list")


def event_tier_by_name(events: DataFrame, tiers: DataFrame, history: DataFrame) -> DataFrame:
    """The tier by slug, else of the first history row with the same trimmed name, whatever its case."""
    name = lambda c: F.lower(F.trim(c))
    by_name = history.groupBy(name("name").alias("_name")).agg(F.min_by("tier", "at").alias("name_tier"))
    return events.join(tiers, "slug", "left").join(by_name, name("name") == F.col("_name"), "left").withColumn("event_tier", F.coalesce("tier", "name_tier")).drop("_name", "tier", "name_tier")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(*keys, "_b.*").select(df.columns)


def last_lines(resolutions: DataFrame) -> DataFrame:
    newest = Window.partitionBy("run_id", "slug").orderBy(F.desc("line"))
    return resolutions.withColumn("_i", F.row_number().over(newest)).filter("_i = 1").drop("_i")
