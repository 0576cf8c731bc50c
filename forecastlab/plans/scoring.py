"""Queries of forecast scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.functions import decision as D
from forecastlab.operators import scoring as S
from forecastlab.operators import usage as U

from .base import query
from .scalars import EV, EV_GRADE, FLOW, NOTABLE, RETRO, SMART, TEMPERED

c = F.col


def scored(t):
    return t("forecasts").filter("won IS NOT NULL").withColumn("y", c("won"))


P = "(SELECT *, won AS y FROM forecasts WHERE won IS NOT NULL)"
LL = "avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))))"
BIN = "CAST(least(greatest(floor(p * 10), 0), 9) AS INT)"
query("a1_brier", f"SELECT avg((p - y) ** 2) AS brier FROM {P}", "brier")(lambda t: scored(t).agg(S.brier().alias("brier")))
query("a2_log_loss", f"SELECT {LL} AS log_loss, avg(-(y * ln(greatest(least(m, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(m, 1 - 1e-6), 1e-6)))) AS market FROM {P} WHERE m IS NOT NULL", "log_loss market")(lambda t: scored(t).filter("m IS NOT NULL").agg(S.log_loss().alias("log_loss"), S.log_loss("m", "y", 1e-6).alias("market")))
query("a3_calibration_curve", f"SELECT CAST(b AS INT) AS bin, count(p) AS n, avg(p) AS mean_p, avg(y) AS rate FROM range(10) r(b) LEFT JOIN {P} ON b = {BIN} GROUP BY b", "mean_p rate")(lambda t: S.calibration_curve(scored(t)))
ECE = f"(SELECT sum(n * abs(mp - r)) / sum(n) FROM (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS r FROM {P} {{0}} GROUP BY {BIN}))"
query("a4_ece", f"SELECT {ECE.format('')} AS ece", "ece")(lambda t: S.ece(scored(t)))
query(
    "a5_scorecard",
    f"""WITH s AS (SELECT * FROM {P}), g AS (SELECT 'all' AS scope, p, y FROM s UNION ALL SELECT sport, p, y FROM s), e AS (SELECT scope, {BIN} AS b, count(*) AS n, avg(p) AS mp, avg(y) AS r FROM g GROUP BY 1, 2)
    SELECT scope, count(*) AS n, avg((p - y) ** 2) AS brier, {LL} AS log_loss, (SELECT sum(n * abs(mp - r)) / sum(n) FROM e WHERE e.scope = g.scope) AS ece FROM g GROUP BY scope""", "brier log_loss ece",
)(lambda t: S.scorecard(scored(t), "sport").withColumn("n", c("n").cast("long")))
query("a6_auc", f"WITH s AS (SELECT p, y, rank() OVER (ORDER BY p) AS lo, count(*) OVER (PARTITION BY p) AS k FROM {P}) SELECT (sum(CASE WHEN y = 1 THEN lo + (k - 1) / 2.0 END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM s", "auc")(lambda t: S.auc(scored(t)))
query("a7_reliability_deciles", f"SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM {P} GROUP BY 1", "mean_p rate")(lambda t: S.reliability(scored(t)))
SIDE, HIT = "greatest(p, 1 - p)", "((p >= 0.5) = (y = 1))"
BUCKET = ", ".join(f"count(*) FILTER (WHERE {SIDE} >= {x}) AS {k}_n, count(*) FILTER (WHERE {SIDE} >= {x}) / count(*) AS {k}_coverage, count(*) FILTER (WHERE {SIDE} >= {x} AND {HIT}) / nullif(count(*) FILTER (WHERE {SIDE} >= {x}), 0) AS {k}_hit" for k, x in (("lock", 0.75), ("lean", 0.6)))
B_FLOATS = "lock_coverage lock_hit lean_coverage lean_hit"
query("a8_bucket_metrics", f"SELECT count(*) AS n, {BUCKET} FROM {P}", B_FLOATS)(lambda t: S.bucket_metrics(scored(t)))
query("a9_breakdown", " UNION ALL ".join(f"SELECT '{k}' AS cut, {k} AS label, count(*) AS n, avg((p - y) ** 2) AS brier, {LL} AS log_loss, avg(y) AS base_rate, {BUCKET} FROM {P} GROUP BY {k}" for k in ("tour", "sport", "league")), f"brier log_loss base_rate {B_FLOATS}")(lambda t: S.breakdown(scored(t), ["tour", "sport", "league"]))
ORDER = ["high", "medium", "low", "none"]
query("a10_hit_rate_cut", "SELECT CAST(place AS INT) AS place, label, CAST(coalesce(sum(won), 0) AS BIGINT) AS hits, count(won) AS total FROM (VALUES (0, 'high'), (1, 'medium'), (2, 'low'), (3, 'none')) AS o(place, label) LEFT JOIN forecasts ON confidence = label GROUP BY 1, 2")(lambda t: S.hit_rate_cut(t("forecasts"), "confidence", ORDER))
query(
    "a11_calibrate_report",
    f"""WITH r AS (SELECT lower(sport) AS sport, won, (p - won) ** 2 AS b, (({TEMPERED}) - won) ** 2 AS bt, confidence, {EV_GRADE} AS grade, CASE WHEN m > p THEN 'yes' WHEN m <= p THEN 'no' END AS neg FROM forecasts WHERE won IS NOT NULL),
    k AS (SELECT sport, won, b, bt, 'confidence' AS cut, confidence AS label FROM r UNION ALL SELECT sport, won, b, bt, 'ev', grade FROM r UNION ALL SELECT sport, won, b, bt, 'negative_edge', neg FROM r)
    SELECT scope, cut, label, count(*) AS settled, CAST(sum(won) AS BIGINT) AS hits, avg(b) AS brier, avg(bt) AS brier_tempered FROM (SELECT 'all' AS scope, * FROM k UNION ALL SELECT sport, * FROM k) GROUP BY 1, 2, 3""", "brier brier_tempered",
)(lambda t: S.calibrate_report(t("forecasts"), {"confidence": c("confidence"), "ev": D.classify_ev(c("p"), c("m")), "negative_edge": F.when(c("m") > c("p"), "yes").when(c("m") <= c("p"), "no")}, 1.6))
RET = "CASE WHEN m > 0 AND m < 1 THEN CASE won WHEN 1 THEN (1 - m) / m ELSE -1 END END"
query(
    "a20_ev_bucket_retro",
    f"WITH r AS (SELECT won, {EV} AS ev, {RET} AS r, {RETRO} AS bucket FROM forecasts WHERE won IS NOT NULL) SELECT bucket, count(*) AS n, avg(won) AS hit_rate, avg(ev) AS mean_ev, avg(r) AS mean_realized, avg(r) - avg(ev) AS edge, count(*) < 20 AS few FROM (SELECT * FROM r UNION ALL SELECT won, ev, r, 'all' FROM r) GROUP BY bucket", "hit_rate mean_ev mean_realized edge",
)(lambda t: S.ev_bucket_report(t("forecasts")))
query("a20_ev_high_low_delta", f"SELECT avg(CASE WHEN {EV} >= .15 THEN won END) - avg(CASE WHEN {EV} >= 0 AND {EV} < .15 THEN won END) AS delta FROM forecasts WHERE won IS NOT NULL", "delta")(lambda t: S.ev_high_low_delta(t("forecasts")))
query(
    "a21_realized_ev_check",
    f"WITH r AS (SELECT {EV} AS ev, {RET} AS r, {EV_GRADE} AS bucket FROM forecasts WHERE won IS NOT NULL AND m IS NOT NULL), k AS (SELECT bucket, count(*) AS n, avg(ev) AS mean_ev, avg(r) AS realized FROM (SELECT * FROM r UNION ALL SELECT ev, r, 'OVERALL' FROM r) WHERE ev IS NOT NULL GROUP BY bucket) SELECT *, CASE WHEN n < 30 THEN 'INCONCLUSIVE' WHEN mean_ev - realized > .05 THEN 'WARN' WHEN mean_ev - realized < -.05 THEN 'NOTE' ELSE 'OK' END AS verdict FROM k", "mean_ev realized",
)(lambda t: S.realized_ev_check(t("forecasts"), D.classify_ev(c("p"), c("m"))))
for mode, low, high in (("tail", 0.0, 0.2), ("ev", 0.3, 0.65), ("confidence", 0.5, 1.0)):
    query(
        f"a22_range_calibration_{mode}",
        f"""WITH r AS (SELECT * FROM forecasts WHERE m >= {low} AND m < {high} AND won IS NOT NULL), e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, .2, .4, .6, .8, 1]))) AS e, avg(p) - avg(won) AS d, count(*) AS k FROM r)
        SELECT CAST(greatest(1, len(list_filter(e, lambda x: x < p))) - 1 AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(won) AS actual, CASE WHEN any_value(k) < 30 THEN 'INCONCLUSIVE' WHEN any_value(d) > .05 THEN 'WARN' WHEN any_value(d) < -.05 THEN 'NOTE' ELSE 'OK' END AS verdict FROM r, e GROUP BY 1""", "mean_p actual",
    )(lambda t, low=low, high=high: S.range_calibration_check(t("forecasts"), low, high))
query(
    "a23_flow_tier_retro",
    f"WITH r AS (SELECT won, p, {FLOW} AS tier FROM forecasts WHERE won IS NOT NULL) SELECT tier, count(*) AS n, avg(won) AS hit_rate, avg((p - won) ** 2) AS brier, avg(won) - (SELECT avg(won) FROM r) AS delta FROM (SELECT * FROM r UNION ALL SELECT won, p, 'all' FROM r) GROUP BY tier", "hit_rate brier delta",
)(lambda t: S.flow_tier_retro(t("forecasts"), D.flow_tier(NOTABLE(), SMART())))
query(
    "a41_shift_grading",
    " UNION ALL ".join(f"SELECT event_id, '{s}' AS shift, {s} AS value, CASE WHEN abs({s}) >= .005 AND won IS NOT NULL THEN ({s} > 0) = (won = 1) END AS correct FROM forecasts" for s in ("gap_model", "gap_market")), "value",
)(lambda t: S.shift_grading(t("forecasts"), ["gap_model", "gap_market"]))
query(
    "a42_loss_vs_win_profile",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(CASE WHEN won = 1 THEN {f} END) AS mean_won, avg(CASE WHEN won = 0 THEN {f} END) AS mean_lost, (avg(CASE WHEN won = 1 THEN {f} END) - avg(CASE WHEN won = 0 THEN {f} END)) / stddev_pop({f}) AS difference FROM forecasts WHERE won IS NOT NULL" for f in ("p", "m", "defens", "sim_p")), "mean_won mean_lost difference",
)(lambda t: U.loss_vs_win_profile(t("forecasts"), ["p", "m", "defens", "sim_p"]))
query(
    "a43_learning_curve_verdict",
    """WITH k AS (SELECT run_id AS fraction, avg(p) / 5 AS train, avg((p - won) ** 2) AS holdout FROM forecasts WHERE won IS NOT NULL GROUP BY 1), g AS (SELECT *, lag(holdout) OVER (ORDER BY fraction) - holdout AS gain FROM k)
    SELECT gain, CASE WHEN gain >= .005 THEN 'data-bound' WHEN gain <= .002 THEN 'feature-bound' ELSE 'between' END AS verdict, holdout - train >= .05 AS overfits FROM g ORDER BY fraction DESC LIMIT 1""", "gain",
)(lambda t: S.learning_curve_verdict(t("forecasts").filter("won IS NOT NULL").groupBy(c("run_id").alias("fraction")).agg((F.avg("p") / 5).alias("train"), F.avg((c("p") - c("won")) ** 2).alias("holdout"))))
query(
    "m9_compare_models",
    f"""WITH r AS (SELECT y, p, model_p, sim_p, (p + model_p) / 2 AS even_blend, 0.25 * p + 0.75 * model_p AS fitted_blend FROM {P} WHERE model_p IS NOT NULL), k AS (SELECT y, 'p' AS model, p AS q FROM r UNION ALL SELECT y, 'model_p', model_p FROM r UNION ALL SELECT y, 'sim_p', sim_p FROM r UNION ALL SELECT y, 'even_blend', even_blend FROM r UNION ALL SELECT y, 'fitted_blend', fitted_blend FROM r)
    SELECT model, count(*) AS n, avg((q - y) ** 2) AS brier, avg(-(y * ln(greatest(least(q, 1 - 1e-6), 1e-6)) + (1 - y) * ln(1 - greatest(least(q, 1 - 1e-6), 1e-6)))) AS log_loss, corr(q, y) AS corr FROM k GROUP BY model""", "brier log_loss corr",
)(lambda t: S.compare_models(scored(t), ["p", "model_p", "sim_p"], weight=0.25))
RATES_SQL = "(VALUES ('view', 3.0, 15.0, 0.3, 3.75), ('click', 1.0, 5.0, 0.1, 1.25), ('error', 0.25, 1.25, 0.03, 0.3)) AS r(model, i, o, k, w)"
rates = lambda t: t.spark.createDataFrame([("view", 3.0, 15.0, 0.3, 3.75), ("click", 1.0, 5.0, 0.1, 1.25), ("error", 0.25, 1.25, 0.03, 0.3)], "model string, r_in double, r_out double, r_cached double, r_written double")
query(
    "a35_usage_rollup",
    f"""SELECT model, CAST(sum(coalesce(tokens_in, 0)) AS BIGINT) AS tokens_in, CAST(sum(coalesce(tokens_out, 0)) AS BIGINT) AS tokens_out, CAST(sum(coalesce(tokens_cached, 0)) AS BIGINT) AS tokens_cached, CAST(sum(coalesce(tokens_written, 0)) AS BIGINT) AS tokens_written,
    round(sum(round((coalesce(tokens_in, 0) * i + coalesce(tokens_out, 0) * o + coalesce(tokens_cached, 0) * k + coalesce(tokens_written, 0) * w) / 1e6, 6)), 3) AS cost, count(*) AS n_calls, count(*) FILTER (WHERE tokens_in IS NULL AND tokens_out IS NULL) AS n_unknown, count(*) FILTER (WHERE i IS NULL) AS n_unpriced
    FROM calls LEFT JOIN {RATES_SQL} USING (model) GROUP BY model""",
)(lambda t: U.usage_rollup(t("calls"), rates(t), "model").withColumn("cost", F.round("cost", 3)))
query(
    "a36_timing_rollup",
    "WITH k AS (SELECT CASE event_type WHEN 'view' THEN 'fetch' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'judge' ELSE 'other' END AS phase, value FROM events) SELECT phase, sum(value) AS seconds, count(*) AS n FROM k GROUP BY phase", "seconds",
)(lambda t: U.timing_rollup(t("events").select(F.create_map(c("event_type"), c("value")).alias("stages")), {"view": "fetch", "click": "fetch", "purchase": "judge"}))
query("a36_lens_totals", "SELECT event_type AS stage, sum(value) AS seconds, count(*) AS n FROM events GROUP BY 1", "seconds")(lambda t: U.lens_totals(t("events").select(F.create_map(c("event_type"), c("value")).alias("stages"))))
FIELDS = ["label", "bid", "ask", "open_interest", "record"]
query(
    "a40_populate_rate",
    " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS populated, count(*) AS total, count({f}) / count(*) AS rate, CASE WHEN count({f}) >= count(*) THEN 'full' WHEN 2 * count({f}) >= count(*) THEN 'partial' ELSE 'sparse' END AS mark FROM markets" for f in FIELDS), "rate",
)(lambda t: U.populate_rate(t("markets"), FIELDS))
