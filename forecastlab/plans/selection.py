"""Queries of candidate tiers and scores (T), selection and its backtest (K, A33, P9, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.operators import selection as S

from .base import query

c = F.col
SGN = "(CASE WHEN a_points > 0 AND b_points > 0 THEN CASE WHEN a_points >= b_points THEN 1 ELSE -1 END END)"
SURF = "(CASE WHEN surface IS NOT NULL THEN 1 END)"


def rate(s: str, k: str, least: int) -> str:
    return f"(CASE WHEN {s}_{k}_n >= {least} THEN {s}_{k}_w / {s}_{k}_n END)"


def gap(k: str, least: int) -> str:
    return f"({rate('a', k, least)} - {rate('b', k, least)})"


def clip(x: str, cap: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(-{cap}, least({cap}, {x})) END)"


LR = "(CASE WHEN a_points > 0 AND b_points > 0 THEN log10(greatest(a_points, b_points) / least(a_points, b_points)) END)"
PRIME = "greatest(0, abs({0}_age - 26.5) - 2.5)"
PD = f"(CASE WHEN a_age IS NOT NULL AND b_age IS NOT NULL THEN {PRIME.format('a')} - {PRIME.format('b')} END)"
WORST = "(CASE WHEN a_last_days IS NOT NULL AND b_last_days IS NOT NULL THEN greatest(a_last_days, b_last_days) END)"
UND = f"greatest(0, -({SGN} * {{0}} * {{1}}))"
DOG = f"(CASE {SGN} WHEN 1 THEN meetings - a_h2h_wins WHEN -1 THEN a_h2h_wins END / meetings)"


def bonus(diff: str, by: float) -> str:
    return f"(CASE WHEN {SGN} * {diff} IS NOT NULL THEN least(0.2, greatest(0, -{SGN} * {diff} * {by})) END)"


TIERS = {
    "t1_rank_points_ratio": (S.base_rank_points, f"CASE WHEN {LR} IS NOT NULL THEN least(1, {LR}) END"),
    "t2_form": (S.tier_form, f"0.2 * {SGN} * {gap('form', 5)}"),
    "t3_surface": (S.tier_surface, f"0.1 * {SURF} * {SGN} * {gap('surf', 5)}"),
    "t4_surface_relative": (S.tier_surface_relative, clip(f"0.1 * {SURF} * {SGN} * ({gap('surf', 5)} - (a_all_w / nullif(a_all_n, 0) - b_all_w / nullif(b_all_n, 0)))", 0.1)),
    "t5_h2h_density": (S.tier_h2h, "least(0.175, CASE WHEN meetings >= 6 THEN 0.15 WHEN meetings >= 3 THEN 0.1 WHEN meetings >= 1 THEN 0.05 ELSE 0 END + CASE WHEN meetings >= 3 AND surface IS NOT NULL THEN 0.025 ELSE 0 END)"),
    "t6_best_of": (S.best_of_multiplier, "CASE WHEN best_of = 5 THEN 1.15 ELSE 1 END"),
    "t7_serve": (S.tier_serve, clip(f"0.5 * {SGN} * (a_serve - b_serve)", 0.1)),
    "t7_return": (S.tier_return, clip(f"0.5 * {SGN} * (a_ret - b_ret)", 0.1)),
    "t8_decider": (S.tier_decider, clip(f"0.2 * {SGN} * (a_decider - b_decider)", 0.1)),
    "t8_tiebreak": (S.tier_tiebreak, clip(f"0.1 * {SGN} * (a_tiebreak - b_tiebreak)", 0.05)),
    "t9_age": (S.tier_age, f"-0.05 * tanh({SGN} * {PD} / 2)"),
    "t10_layoff": (S.tier_layoff, f"CASE WHEN {WORST} IS NOT NULL THEN -0.05 * greatest(0, least(1, ({WORST} - 14) / 28.0)) END"),
    "t11_info_density": (S.tier_info, "CASE WHEN least(a_all_n, b_all_n) > 0 THEN 0.2 * (0.6 * least(1, least(a_all_n, b_all_n) / 8) + 0.4 * CASE WHEN surface IS NULL THEN 0.5 ELSE least(1, least(a_surf_n, b_surf_n) / 4) END - 0.5) END"),
    "t12_round": (S.tier_round, "CASE WHEN round_id <= 2 THEN 0.05 WHEN round_id >= 5 THEN -0.05 END"),
    "t13_elo_gap": (S.tier_elo_gap, "CASE WHEN a_points > 0 AND b_points > 0 THEN least(0.3, 2 * abs(1 / (1 + pow(10, (b_elo - a_elo) / 400)) - a_points / (a_points + b_points))) END"),
    "t14_underdog_form": (S.tier_underdog_form, bonus(gap("form", 5), 0.8)),
    "t14_underdog_serve": (S.tier_underdog_serve, bonus("(a_serve - b_serve)", 4.0)),
    "t14_underdog_surface": (S.tier_underdog_surface, f"{SURF} * {bonus(gap('surf', 5), 1.0)}"),
    "t15_underdog_elo": (S.tier_underdog_elo, f"CASE WHEN {SGN} IS NOT NULL THEN least(0.2, greatest(0, CASE {SGN} WHEN 1 THEN b_elo ELSE a_elo END - 1500) * 0.2 / 300) END"),
    "t16_underdog_h2h": (S.tier_underdog_h2h, f"CASE WHEN meetings >= 2 AND {DOG} > 0.5 THEN ({DOG} - 0.5) * 0.3 END"),
    "t17_competitive_floor": (S.tier_competitive_floor, f"CASE WHEN {LR} > 0.6 THEN -0.3 * least(1, ({LR} - 0.6) / 0.4) END"),
}
SQL = {k: f"coalesce({v}, 0)" for k, (_, v) in TIERS.items()}
for name, (tier, _) in TIERS.items():
    query(name, f"SELECT id, {SQL[name]} AS tier FROM pairs", "tier")(lambda t, tier=tier: t("pairs").select("id", tier().cast("double").alias("tier")))


def total(*parts: str) -> str:
    return f"greatest(0, least(1, {' + '.join(parts)}))"


RECORD = f"coalesce(CASE WHEN a_all_n >= 10 AND b_all_n >= 10 THEN {clip(f'0.1 * {SGN} * {gap("all", 10)}', 0.05)} END, 0)"
CONF = total(f"0.3 * {SQL['t1_rank_points_ratio']}", SQL["t2_form"], f"2.5 * {SQL['t7_serve']}", SQL["t5_h2h_density"], SQL["t3_surface"], SQL["t11_info_density"])
TAIL = total("0.4", *[SQL[k] for k in ("t13_elo_gap", "t14_underdog_form", "t14_underdog_serve", "t14_underdog_surface", "t16_underdog_h2h")])
EVS = total("0.4", *[SQL[k] for k in ("t13_elo_gap", "t14_underdog_form", "t14_underdog_serve", "t14_underdog_surface", "t16_underdog_h2h", "t17_competitive_floor")])
YTD = f"coalesce(0.05 * {SGN} * {gap('all', 10)}, 0)"
DECAY = "log10(greatest({0}_rank, 1) / greatest({0}_best_rank, 1))"
FALL = f"(CASE WHEN a_rank IS NOT NULL AND a_best_rank IS NOT NULL AND b_rank IS NOT NULL AND b_best_rank IS NOT NULL THEN {SGN} * ({DECAY.format('a')} - {DECAY.format('b')}) END)"
AGED = clip(f"{SQL['t9_age']} + coalesce(-0.05 * tanh({FALL} / 0.5), 0)", 0.075)
STEADY = f"coalesce(0.1 * {SGN} * (a_consistency - b_consistency), 0)"
MET = "(CASE WHEN meetings >= 6 THEN 0.15 WHEN meetings >= 3 THEN 0.1 WHEN meetings >= 1 THEN 0.05 ELSE 0 END + CASE WHEN surface IS NOT NULL AND surface_meetings >= 2 THEN 0.025 ELSE 0 END)"
EVENT = "(CASE rank_id WHEN 4 THEN 1.15 WHEN 3 THEN 1.05 ELSE 1 END)"
LEGACY = f"greatest(0, least(1, ({' + '.join([*[SQL[k] for k in ('t1_rank_points_ratio', 't2_form', 't4_surface_relative', 't11_info_density', 't10_layoff')], STEADY, AGED, YTD, MET])}) * {EVENT}))"
W1 = "greatest(.001, least(.999, coalesce(a_all_w / nullif(a_all_n, 0), .5)))"
W2 = "greatest(.001, least(.999, coalesce(b_all_w / nullif(b_all_n, 0), .5)))"
FORM_SURFACE = f"""greatest(.001, least(.999, {W1} * (1 - {W2}) / ({W1} * (1 - {W2}) + {W2} * (1 - {W1})) + coalesce({clip(f"0.1 * {gap('form', 5)}", 0.04)}, 0) + coalesce({clip(f"0.15 * {gap('surf', 8)} * least(1, sqrt(least(a_surf_n, b_surf_n) / 30))", 0.06)}, 0)))"""
SCORES = {
    "t18_composite": (lambda: S.composite(S.base_rank_points(), [(1.0, S.tier_form()), (0.5, S.tier_round())], [S.best_of_multiplier()]), f"greatest(0, least(1, ({SQL['t1_rank_points_ratio']} + {SQL['t2_form']} + 0.5 * {SQL['t12_round']}) * {SQL['t6_best_of']}))"),
    "t19_confidence_v1": (S.score_confidence_v1, CONF), "t20_ev_v1": (S.score_ev_v1, EVS), "t20_tail_v1": (lambda: S.score_ev_v1(tail=True), TAIL), "t21_legacy": (S.score_legacy, LEGACY),
    "t22_imbalance": (lambda: S.imbalance_score(F.when(c("tour") == "atp", S.score_confidence_v1()), F.when(c("tour") == "wta", c("m"))), f"CASE tour WHEN 'atp' THEN {CONF} WHEN 'wta' THEN m ELSE 0 END"),
    "t23_form_surface": (S.form_surface_score, FORM_SURFACE),
}
LABEL_SQL = "CASE WHEN a_serve IS NOT NULL AND a_ret IS NOT NULL AND b_serve IS NOT NULL AND b_ret IS NOT NULL AND a_surf_n >= 8 AND b_surf_n >= 8 AND a_form_n >= 5 AND b_form_n >= 5 THEN 'high' WHEN (a_serve IS NULL OR a_ret IS NULL) AND (b_serve IS NULL OR b_ret IS NULL) OR least(a_surf_n, b_surf_n) < 5 THEN 'low' ELSE 'medium' END"
query("t23_form_surface_confidence", f"SELECT id, {LABEL_SQL} AS confidence FROM pairs")(lambda t: t("pairs").select("id", S.form_surface_confidence().alias("confidence")))
for name, (score, sql) in SCORES.items():
    query(name, f"SELECT id, {sql} AS score FROM pairs", "score")(lambda t, score=score: t("pairs").select("id", score().cast("double").alias("score")))
query("t24_random_score")(lambda t: t("pairs").select("id", S.random_score(c("id"), 42).alias("score")))

LABEL = """side AS (SELECT *, greatest(p, 1 - p) AS sp, (p >= 0.5) = (won = 1) AS ok, CASE WHEN p >= 0.5 THEN m WHEN p < 0.5 THEN 1 - m ELSE 1 - m END AS sm FROM pairs),
    lab AS (SELECT *, sp >= .75 AND ok AS is_lock, sp >= .6 AND ok AS is_lock_or_lean, CASE WHEN sm > 0 AND sm < 1 AND p IS NOT NULL THEN sp * (1 - sm) / sm - (1 - sp) END AS ev, CASE WHEN sm > 0 AND sm < 1 AND p IS NOT NULL THEN CASE WHEN ok THEN (1 - sm) / sm ELSE -1 END END AS realized FROM side)"""
GRADE = "CASE WHEN ev >= .3 THEN 'Prime' WHEN ev >= .15 THEN 'Edge' WHEN ev >= 0 THEN 'Thin' WHEN ev < 0 THEN 'Negative' END"
query("k4_synthetic_labels", f"WITH {LABEL} SELECT id, is_lock, is_lock_or_lean, ev, realized, {GRADE} AS ev_grade FROM lab", "ev realized")(lambda t: S.synthetic_labels(t("pairs")).select("id", "is_lock", "is_lock_or_lean", "ev", "realized", "ev_grade"))
TOP = "SELECT *, count(*) OVER (PARTITION BY {0}day, tour) AS n, row_number() OVER (PARTITION BY {0}day, tour ORDER BY round(score, 9) DESC, id) AS i FROM {1}"
query("k2_top_k_per_slate", f"WITH s AS (SELECT id, day, tour, {CONF} AS score FROM pairs), r AS ({TOP.format('', 's')}) SELECT id, day, tour FROM r WHERE n > 5 AND i <= 5")(lambda t: S.top_k_per_slate(t("pairs").withColumn("score", F.round(S.score_confidence_v1(), 9)), 5).select("id", "day", "tour"))
METRICS = """count(*) AS n_picks, count(is_lock) AS n_labelable, avg(CASE WHEN is_lock THEN 1.0 ELSE 0 END) AS precision_lock, avg(CASE WHEN is_lock_or_lean THEN 1.0 ELSE 0 END) AS precision_lean, avg(ev) AS mean_ev, avg(CASE WHEN ev IS NOT NULL THEN realized END) AS mean_realized, avg(CASE WHEN ev >= .15 THEN 1.0 WHEN ev < .15 THEN 0 END) AS precision_edge"""
BASE = "avg(is_lock::INT) AS base_lock, avg(is_lock_or_lean::INT) AS base_lean, avg(realized) AS base_realized"
M_FLOATS = "precision_lock precision_lean mean_ev mean_realized precision_edge base_lock base_lean base_realized"
query("a33_slate_metrics", f"WITH {LABEL}, s AS (SELECT *, {LR} AS score FROM lab), r AS ({TOP.format('', '(SELECT * REPLACE (coalesce(score, 0) AS score) FROM s)')}), q AS (SELECT tour, {METRICS} FROM r WHERE n > 5 AND i <= 5 GROUP BY tour), b AS (SELECT tour, {BASE} FROM lab GROUP BY tour) SELECT * FROM q JOIN b USING (tour)", M_FLOATS)(
    lambda t: (lambda pool: S.slate_metrics(S.top_k_per_slate(pool, 5), pool, ["tour"]))(S.synthetic_labels(t("pairs")).withColumn("score", F.round(F.coalesce(S.base_log_ratio(), F.lit(0.0)), 9)))
)
query(
    "k3_selection_backtest",
    f"""WITH {LABEL}, l AS (SELECT *, CASE WHEN day <= DATE '1999-12-31' THEN 'train' ELSE 'holdout' END AS fold FROM lab), s AS (SELECT *, 'confidence' AS scorer, {CONF} AS score FROM l UNION ALL SELECT *, 'ev', {EVS} FROM l UNION ALL SELECT *, 'points', {SQL['t1_rank_points_ratio']} FROM l),
    r AS ({TOP.format('scorer, ', 's')}), q AS (SELECT scorer, fold, {METRICS} FROM r WHERE n > 5 AND i <= 5 GROUP BY 1, 2), b AS (SELECT scorer, fold, {BASE} FROM s GROUP BY 1, 2) SELECT * FROM q JOIN b USING (scorer, fold)""", M_FLOATS,
)(lambda t: S.selection_backtest(t("pairs"), {"confidence": F.round(S.score_confidence_v1(), 9), "ev": F.round(S.score_ev_v1(), 9), "points": F.round(S.base_rank_points(), 9)}, 5, "1999-12-31"))
query("k1_select_top", "WITH e AS (SELECT event_id, round(max(bid), 4) AS score, min(start) AS start FROM markets GROUP BY event_id) SELECT event_id, score FROM e ORDER BY score DESC NULLS LAST, start NULLS LAST, event_id LIMIT 25", "score")(
    lambda t: S.select_top(t("markets").groupBy("event_id").agg(F.round(F.max("bid"), 4).alias("score"), F.min("start").alias("start")), 25).select("event_id", "score")
)
query(
    "k5_top_contributions",
    "WITH k AS (SELECT DISTINCT event_id, feature, value FROM (SELECT event_id, partkey, 'gap_market' AS feature, gap_market AS value FROM f1 UNION ALL SELECT event_id, partkey, 'gap_model', gap_model FROM f1 UNION ALL SELECT event_id, partkey, 'tilt', defens - 0.5 FROM f1) WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, feature) - 1 AS place FROM k) SELECT event_id, CAST(place AS INT) AS place, feature, value FROM r WHERE place < 2".replace("WITH k", "WITH f1 AS (SELECT event_id, min(partkey) AS partkey, min(gap_market) AS gap_market, min(gap_model) AS gap_model, min(defens) AS defens FROM forecasts GROUP BY event_id), k", 1), "value",
)(lambda t: S.top_contributions(t("forecasts").groupBy("event_id").agg(F.min("gap_market").alias("gap_market"), F.min("gap_model").alias("gap_model"), (F.min("defens") - 0.5).alias("tilt")), ["gap_market", "gap_model", "tilt"], 2))
query("p9_walk_forward_split", "SELECT fold, count(*) AS n FROM (SELECT CASE WHEN day > DATE '2000-01-31' THEN 'holdout' WHEN day > DATE '2000-01-31' - 90 THEN 'validation' ELSE 'train' END AS fold FROM pairs) GROUP BY fold")(lambda t: S.walk_forward_split(t("pairs"), "2000-01-31").groupBy("fold").agg(F.count("*").alias("n")))
query("p10_subset_both_sides", "SELECT match_id FROM matches WHERE p1 IN (SELECT player_id FROM profiles WHERE plays = 'right') AND p2 IN (SELECT player_id FROM profiles WHERE plays = 'right')")(lambda t: S.subset_both_sides(t("matches"), t("profiles").filter("plays = 'right'")).select("match_id"))
