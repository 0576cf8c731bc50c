"""Decisions: safety filters, budgets, fills, exposure and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastlab.functions.decision import EV_BUCKETS, RISK_BUCKETS, bucket_rank, ev_per_dollar

from .quantiles import global_places


def filter_forecasts(df: DataFrame, confidence: list[str] | None = None, min_defens: float | None = None, no_negative_edge: bool = False, sports: list[str] | None = None, risk_buckets: list[str] | None = None, ev_buckets: list[str] | None = None, min_market_p: float | None = None) -> DataFrame:
    """Rows that pass every active filter; an unknown value passes none."""
    tests: list[Column] = []
    if confidence:
        tests.append(F.col("confidence").isin(confidence))
    if min_defens is not None:
        tests.append(F.col("defens") >= min_defens)
    if no_negative_edge:
        tests.append(~(F.col("p") < F.col("m")))
    if sports:
        tests.append(F.lower("sport").isin([s.lower() for s in sports]))
    if risk_buckets:
        tests.append(F.col("risk_bucket").isin(risk_buckets))
    if ev_buckets:
        tests.append(F.col("ev_bucket").isin(ev_buckets))
    if min_market_p is not None:
        tests.append(F.col("m") >= min_market_p)
    for test in tests:
        df = df.filter(F.coalesce(test, F.lit(False)))
    return df


def implied_ceiling(df: DataFrame, ask: str, most: float | None) -> DataFrame:
    return df if most is None else df.filter(~F.coalesce(F.col(ask) >= most, F.lit(False)))


def live_ev_gate(df: DataFrame, p: str, ask: str, least: float) -> DataFrame:
    return df.filter(F.coalesce(ev_per_dollar(F.col(p), F.col(ask)) >= least, F.lit(False)))


def budget_allocation(rows: DataFrame, cap: float, open_: float, by: str, order: list[str]) -> DataFrame:
    """Each row's part of its size, in order, out of what the cap leaves: a clamped running sum equals taking what is left, row by row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room, upto = F.lit(max(cap - open_, 0.0)), F.sum("size").over(w)
    out = rows.withColumn("alloc", F.least(upto, room) - F.least(upto - F.col("size"), room))
    return out.withColumn("exhausted", F.col("alloc") <= 0)


def uniform_allocation(rows: DataFrame, size: float, cap: float, open_: float, by: str, order: list[str]) -> DataFrame:
    """Whether a fixed size still fits under the cap, in order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("accepted", n * size <= max(cap - open_, 0.0))


def rank_leaderboard(df: DataFrame, by: str, risk: str = "risk_bucket", ev: str = "ev_bucket", score: str = "score") -> DataFrame:
    """Places within each group: by risk bucket, then value bucket, then score, best first."""
    return global_places(df, [by], [bucket_rank(F.col(risk), RISK_BUCKETS), bucket_rank(F.col(ev), EV_BUCKETS)], score, ["event_id", "partkey", "suppkey"])


#: Statuses that cost something, and that are no skip (fixed values).
COSTLY, NO_SKIP = ["filled", "partial", "submitted"], ["filled", "partial", "submitted", "skipped_dry_run"]


def trade_summary(audit: DataFrame) -> DataFrame:
    """Rows by status, and skips also by their reason, whatever it is: their number, and the cost of what was filled or submitted."""
    reason = F.when(~F.col("status").isin(NO_SKIP), F.col("reason"))
    cost = F.sum(F.when(F.col("status").isin(COSTLY), F.col("cost")))
    return audit.groupBy("status", reason.alias("skip_reason")).agg(F.count("*").alias("n"), cost.alias("filled_cost"))


def sum_exposure(positions: DataFrame, dollars: str, by: str) -> DataFrame:
    """Cents by group: each position rounds half to even; unknown ones add nothing."""
    return positions.groupBy(by).agg(F.sum(F.bround(F.col(dollars) * 100).cast("long")).alias("cents"))


def fill_status(orders: DataFrame) -> DataFrame:
    """Cost and average in cents from count, filled, price and fee, and the status they mean."""
    cost = F.bround(F.col("filled") * F.col("price") * 100).cast("long")
    status = F.when(F.col("filled").isNull(), "submitted").when(F.col("filled") <= 0, "no_fill").when(F.col("filled") < F.col("count"), "partial").otherwise("filled")
    return orders.withColumns({"cost_cents": cost, "fee_cents": F.bround(F.col("fee") * 100).cast("long"), "average_cents": F.try_divide(cost, F.col("filled")), "fill_status": status})
