"""Forecast scoring: Brier, log-loss, calibration, AUC, bucket metrics, and cuts of hit rates. Empty input gives nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastlab.functions.decision import apply_temperature, ev_per_dollar, ev_retro_bucket, realized_return

from .quantiles import exact_quantiles


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg((F.col(p) - F.col(y)) ** 2)


def log_loss(p: str | Column = "p", y: str = "y", eps: float = 1e-15) -> Column:
    x = p if isinstance(p, Column) else F.col(p)
    q = F.greatest(F.least(x, F.lit(1 - eps)), F.lit(eps))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def bin_of(p: Column, n: int) -> Column:
    return F.least(F.greatest(F.floor(p * n), F.lit(0)), F.lit(n - 1)).cast("int")


def calibration_curve(df: DataFrame, n: int = 10) -> DataFrame:
    """All n left-closed bins in order: number, mean forecast, share won; nulls in empty ones."""
    got = df.groupBy(bin_of(F.col("p"), n).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ece(df: DataFrame, n: int = 10) -> DataFrame:
    bins = df.groupBy(bin_of(F.col("p"), n).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def scorecard(df: DataFrame, by: str | None = None, n: int = 10) -> DataFrame:
    """Number, Brier, log-loss and ECE overall (scope 'all') and per group, in one pass: sums by bin, then grouping sets over them."""
    q = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    keyed = df.select(F.col(by).cast("string").alias("scope") if by else F.lit("all").alias("scope"), "p", "y", bin_of(F.col("p"), n).alias("bin"), ((F.col("p") - F.col("y")) ** 2).alias("b"), (-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("l"))
    sums = keyed.groupBy("scope", "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("p", "y", "b", "l")])
    scopes = F.array_distinct(F.array(F.lit("all"), F.col("scope")))
    wide = sums.select(F.explode(scopes).alias("scope"), "bin", "n", "p", "y", "b", "l").groupBy("scope", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "p", "y", "b", "l")])
    return wide.groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("log_loss"), (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, buckets: int = 256) -> DataFrame:
    """The Mann-Whitney statistic with mid-ranks for ties; null with one class.

    Rows collapse to distinct forecasts first. Running counts are within buckets of the forecast, and then over the
    few buckets, so no window spans all rows.
    """
    distinct = df.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")).withColumn("_k", bin_of(F.col("p"), buckets))
    below = Window.partitionBy("_k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    inside = distinct.withColumn("_in", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    totals = distinct.groupBy("_k").agg(F.sum("neg").alias("_neg"))
    offset = totals.withColumn("_before", F.coalesce(F.sum("_neg").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_neg")  # at most `buckets` rows
    part = inside.join(F.broadcast(offset), "_k")
    return part.agg(F.try_divide(F.sum(F.col("pos") * (F.col("_in") + F.col("_before") + F.col("neg") / 2)), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def reliability(df: DataFrame) -> DataFrame:
    """Ten equal bins, the last closed; empty ones are left out."""
    return df.groupBy(bin_of(F.col("p"), 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


BUCKETS = {"lock": 0.75, "lean": 0.60}


def bucket_columns(thresholds: dict[str, float] = BUCKETS) -> list[Column]:
    """Number, coverage and hit rate of forecasts whose likelier side reaches each threshold; buckets are cumulative."""
    side, hit = F.greatest(F.col("p"), 1 - F.col("p")), (F.col("p") >= 0.5) == (F.col("y") == 1)
    out = []
    for name, t in thresholds.items():
        out += [F.count_if(side >= t).alias(f"{name}_n"), F.try_divide(F.count_if(side >= t), F.count("*")).alias(f"{name}_coverage"), F.try_divide(F.count_if((side >= t) & hit), F.count_if(side >= t)).alias(f"{name}_hit")]
    return out


def bucket_metrics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *bucket_columns())


def breakdown(df: DataFrame, by: list[str]) -> DataFrame:
    """Per value of each column: number, Brier, log-loss, base rate and bucket metrics; one pass over rows dealt to each cut."""
    cuts = F.array(*[F.struct(F.lit(c).alias("cut"), F.col(c).cast("string").alias("label")) for c in by])
    return df.select("p", "y", F.inline(cuts)).groupBy("cut", "label").agg(F.count("*").alias("n"), brier().alias("brier"), log_loss().alias("log_loss"), F.avg("y").alias("base_rate"), *bucket_columns())


def hit_rate_cut(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Hits and settled totals by label, in the given order with empty ones; labels not in it come after, by name."""
    got = df.filter("won IS NOT NULL").groupBy(F.coalesce(F.col(label), F.lit("unknown")).alias("label")).agg(F.sum("won").alias("hits"), F.count("*").alias("total"))
    fixed = df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(order)], "place int, label string")
    return got.join(F.broadcast(fixed), "label", "full").select(F.coalesce("place", F.lit(len(order))).alias("place"), "label", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("total", F.lit(0)).alias("total"))


def calibrate_report(df: DataFrame, cuts: dict[str, Column], temperature: float) -> DataFrame:
    """Each cut by label, overall and per sport with a settled row: settled, hits, and Brier before and after temperature."""
    stacked = F.array(*[F.struct(F.lit(k).alias("cut"), v.cast("string").alias("label")) for k, v in cuts.items()])
    q = apply_temperature(F.col("p"), temperature)
    rows = df.filter("won IS NOT NULL").select("sport", "won", ((F.col("p") - F.col("won")) ** 2).alias("b"), ((q - F.col("won")) ** 2).alias("bt"), F.inline(stacked))
    spread = rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.lower("sport"))))
    return spread.groupBy("scope", "cut", "label").agg(F.count("*").alias("settled"), F.sum("won").alias("hits"), F.avg("b").alias("brier"), F.avg("bt").alias("brier_tempered"))


def ev_bucket_report(df: DataFrame) -> DataFrame:
    """Settled forecasts by expected-value bucket and overall: number, hit rate, mean expected and realised return, edge, and a warning below 20."""
    ev = ev_per_dollar(F.col("p"), F.col("m"))
    rows = df.filter("won IS NOT NULL").select("won", ev.alias("ev"), realized_return(F.col("m"), F.col("won") == 1).alias("r"), F.explode(F.array(F.lit("all"), ev_retro_bucket(ev))).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("won").alias("hit_rate"), F.avg("ev").alias("mean_ev"), F.avg("r").alias("mean_realized"), (F.avg("r") - F.avg("ev")).alias("edge"), (F.count("*") < 20).alias("few"))


def ev_high_low_delta(df: DataFrame) -> DataFrame:
    """The hit rate of expected values of at least 15% less that of 0 to 15%."""
    ev = ev_per_dollar(F.col("p"), F.col("m"))
    return df.filter("won IS NOT NULL").agg((F.avg(F.when(ev >= 0.15, F.col("won"))) - F.avg(F.when((ev >= 0) & (ev < 0.15), F.col("won")))).alias("delta"))


def verdict(difference: Column, n: Column, least: int) -> Column:
    return F.when(n < least, "INCONCLUSIVE").when(difference > 0.05, "WARN").when(difference < -0.05, "NOTE").otherwise("OK")


def realized_ev_check(df: DataFrame, bucket: Column, least: int = 30) -> DataFrame:
    """Per bucket and overall: number, mean expected and realised return; the verdict on their difference."""
    ev = ev_per_dollar(F.col("p"), F.col("m"))
    rows = df.filter("won IS NOT NULL AND m IS NOT NULL").select(ev.alias("ev"), realized_return(F.col("m"), F.col("won") == 1).alias("r"), F.explode(F.array(F.lit("OVERALL"), bucket)).alias("bucket")).filter("ev IS NOT NULL")
    out = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("ev").alias("mean_ev"), F.avg("r").alias("realized"))
    return out.withColumn("verdict", verdict(F.col("mean_ev") - F.col("realized"), F.col("n"), least))


def range_calibration_check(df: DataFrame, low: float, high: float, bins: int = 5, least: int = 30) -> DataFrame:
    """Of prices in [low, high): quantile bins of the forecast (equal edges merged), each with mean and outcome, and the overall verdict."""
    rows = df.filter((F.col("m") >= low) & (F.col("m") < high) & F.col("p").isNotNull() & F.col("won").isNotNull())
    cuts = exact_quantiles(rows, "p", [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("e"))
    whole = rows.agg(F.count("*").alias("all_n"), (F.avg("p") - F.avg("won")).alias("d"))
    at = F.greatest(F.lit(1), F.size(F.filter("e", lambda e: e < F.col("p")))) - 1
    # all forecasts equal: of bins of equal width around the value, it is in the middle one
    place = F.when(F.size("e") < 2, (bins - 1) // 2).otherwise(at)
    return rows.join(F.broadcast(cuts)).join(F.broadcast(whole)).withColumn("bin", place).groupBy("bin").agg(  # one row each
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("won").alias("actual"), verdict(F.first("d"), F.first("all_n"), least).alias("verdict")
    )


def flow_tier_retro(df: DataFrame, tier: Column) -> DataFrame:
    """Per tier: number, hit rate, difference to the overall one, and the Brier score of the picked side."""
    rows = df.filter("won IS NOT NULL").select(F.explode(F.array(F.lit("all"), tier)).alias("tier"), "won", "p")
    got = rows.groupBy("tier").agg(F.count("*").alias("n"), F.avg("won").alias("hit_rate"), F.avg((F.col("p") - F.col("won")) ** 2).alias("brier"))
    base = got.filter("tier = 'all'").select(F.col("hit_rate").alias("_base"))
    return got.join(F.broadcast(base)).withColumn("delta", F.col("hit_rate") - F.col("_base")).drop("_base")  # one row


def shift_grading(df: DataFrame, shifts: list[str]) -> DataFrame:
    """A row a shift: its value, and whether its sign agrees with the winner; null below .005 or unresolved."""
    rows = F.array(*[F.struct(F.lit(s).alias("shift"), F.col(s).alias("value")) for s in shifts])
    right = (F.col("value") > 0) == (F.col("won") == 1)
    return df.select("event_id", "won", F.inline(rows)).withColumn("correct", F.when((F.abs("value") >= 0.005) & F.col("won").isNotNull(), right)).drop("won")


def learning_curve_verdict(curve: DataFrame) -> DataFrame:
    """Of points (fraction, train, holdout): whether the last step's gain is data-bound or feature-bound, and whether the gap overfits."""
    w = Window.orderBy("fraction")  # a few points
    last = curve.withColumn("gain", F.lag("holdout").over(w) - F.col("holdout")).orderBy(F.desc("fraction")).limit(1)
    return last.select("gain", F.when(F.col("gain") >= 0.005, "data-bound").when(F.col("gain") <= 0.002, "feature-bound").otherwise("between").alias("verdict"), (F.col("holdout") - F.col("train") >= 0.05).alias("overfits"))


def compare_models(df: DataFrame, models: list[str], y: str = "y", weight: float | None = None) -> DataFrame:
    """Paired scores on rows where all models have a value, with the even blend of the first two, and with the one that gives the
    first the weight that models.fit_blend_weight found on other rows."""
    rows = df.filter(reduce(Column.__and__, [F.col(m).isNotNull() for m in models])).withColumn("even_blend", (F.col(models[0]) + F.col(models[1])) / 2)
    blends = ["even_blend"] if weight is None else ["even_blend", "fitted_blend"]
    if weight is not None:
        rows = rows.withColumn("fitted_blend", weight * F.col(models[0]) + (1 - weight) * F.col(models[1]))
    stacked = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("q")) for m in [*models, *blends]])
    return rows.select(F.col(y).alias("y"), F.inline(stacked)).groupBy("model").agg(F.count("*").alias("n"), F.avg((F.col("q") - F.col("y")) ** 2).alias("brier"), log_loss("q", "y", 1e-6).alias("log_loss"), F.corr("q", "y").alias("corr"))
