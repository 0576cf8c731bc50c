"""Queries of price histories: as-of lookups (J1, J3), price windows (W18-W20), books and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.operators import asof, prices
from forecastlab.operators import long_streams

from .base import query

c = F.col
OFFSETS = {"p_24h": 86_400, "p_1h": 3_600, "p_1m": 60}
CONVERGENCE = {"t7d": 604_800, "t5d": 432_000, "t3d": 259_200, "t2d": 172_800, "t1d": 86_400, "t12h": 43_200, "t6h": 21_600, "t3h": 10_800, "t1h": 3_600, "t15m": 900, "t1m": 60}


def asof_sql(offsets: dict[str, int]) -> str:
    cols = ", ".join(f"arg_max(p, (t, event_id)) FILTER (WHERE t <= kickoff - INTERVAL {s} SECONDS) AS {name}" for name, s in offsets.items())
    return f"SELECT a.token_id, kickoff, {cols} FROM anchors a LEFT JOIN prices USING (token_id) GROUP BY a.token_id, kickoff"


query("j1_asof_price", f"SELECT token_id, p_24h, p_1h, p_1m FROM ({asof_sql(OFFSETS)})", "p_24h p_1h p_1m")(lambda t: asof.asof_price(t("prices"), t("anchors").select("token_id", "kickoff"), OFFSETS).drop("kickoff"))
query(
    "j2_asof_rank",
    """WITH s AS (SELECT match_id, tour, match_date, p1 AS player_id FROM matches UNION ALL SELECT match_id, tour, match_date, p2 FROM matches)
    SELECT s.match_id, s.player_id, r.rank, r.rank_points FROM s ASOF LEFT JOIN rankings r ON s.tour = r.tour AND s.player_id = r.player_id AND s.match_date >= r.ranking_date""",
)(lambda t: long_streams.last_before(t("rankings"), t("matches").select("match_id", "tour", "match_date", F.explode(F.array("p1", "p2")).alias("player_id")), ["tour", "player_id"], "ranking_date", "match_date", ["rank", "rank_points"]).select("match_id", "player_id", "rank", "rank_points"))
query(
    "j2_best_rank",
    """WITH s AS (SELECT match_id, tour, match_date, p1 AS player_id FROM matches UNION ALL SELECT match_id, tour, match_date, p2 FROM matches)
    SELECT s.match_id, s.player_id, arg_max(r.rank, r.ranking_date) AS rank, min(r.rank) AS best_rank FROM s LEFT JOIN rankings r ON s.tour = r.tour AND s.player_id = r.player_id AND s.match_date >= r.ranking_date GROUP BY 1, 2""",
)(lambda t: asof.best_before(t("rankings"), t("matches").select("match_id", "tour", "match_date", F.explode(F.array("p1", "p2")).alias("player_id")), ["tour", "player_id"], "ranking_date", "match_date", "rank", "best_rank").select("match_id", "player_id", "rank", "best_rank"))
NEAR = {"w1h": 3_600, "w4h": 14_400, "w24h": 86_400}


def near_sql(windows: dict[str, int], tol: int) -> str:
    off = "abs(epoch_us(kickoff) - {0}000000 - epoch_us(t))"
    cols = ", ".join(f"arg_min(p, ({off.format(s)}, t, event_id)) FILTER (WHERE {off.format(s)} <= {tol}000000) AS {n}" for n, s in windows.items())
    return f"SELECT a.token_id, arg_max(p, (t, event_id)) AS last, {cols} FROM (SELECT token_id, max(t) AS kickoff FROM prices GROUP BY token_id) a JOIN prices USING (token_id) GROUP BY a.token_id"


query("j3_nearest_within", f"SELECT token_id, w1h, w4h, w24h FROM ({near_sql(NEAR, 3600)})", "w1h w4h w24h")(
    lambda t: asof.nearest_within(t("prices"), t("prices").groupBy("token_id").agg(F.max("t").alias("kickoff")), NEAR, tolerance=3600).drop("kickoff")
)
query("w18_price_changes", f"SELECT token_id, last, last - w30m AS w30m, last - w1h AS w1h, last - w4h AS w4h, last - w24h AS w24h FROM ({near_sql({'w30m': 1800} | NEAR, 300)})", "last w30m w1h w4h w24h")(lambda t: prices.price_changes(t("prices"), {"w30m": 1800} | NEAR))
query(
    "w19_sparkline",
    """WITH n AS (SELECT token_id, p, row_number() OVER (PARTITION BY token_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY token_id) AS n FROM prices),
    k AS (SELECT * FROM n WHERE n <= 5 OR i IN (0, round_even((n - 1) / 4.0, 0), round_even((n - 1) / 4.0 * 2, 0), round_even((n - 1) / 4.0 * 3, 0), n - 1))
    SELECT token_id, string_agg(printf('%.3f', p), '→' ORDER BY i) AS line FROM k GROUP BY token_id""",
)(lambda t: prices.sparkline(t("prices")))
query("w20_returns", "SELECT token_id, event_id, p - lag(p) OVER (PARTITION BY token_id ORDER BY t, event_id) AS r FROM prices", "r")(lambda t: prices.returns(t("prices")).select("token_id", "event_id", "r"))
query(
    "a25_return_volatility",
    "WITH r AS (SELECT token_id, p - lag(p) OVER (PARTITION BY token_id ORDER BY t, event_id) AS r FROM prices WHERE p > 0 AND p < 1) SELECT token_id, count(*) AS n_points, CASE WHEN count(*) >= 5 THEN stddev_pop(r) END AS volatility FROM r GROUP BY token_id", "volatility",
)(lambda t: prices.return_volatility(t("prices")))
query(
    "a26_build_backtest_rows",
    f"""WITH b AS (SELECT p.*, kickoff FROM prices p JOIN anchors USING (token_id) WHERE t <= kickoff), q AS ({asof_sql(OFFSETS)}),
    f AS (SELECT token_id, arg_min(p, (t, event_id)) AS open_p, count(*) AS n_points FROM b GROUP BY token_id),
    r AS (SELECT token_id, p - lag(p) OVER (PARTITION BY token_id ORDER BY t, event_id) AS r FROM b WHERE p > 0 AND p < 1), v AS (SELECT token_id, CASE WHEN count(*) >= 5 THEN stddev_pop(r) END AS volatility FROM r GROUP BY token_id)
    SELECT a.token_id, a.outcome, open_p, n_points, p_24h, p_1h, p_1m, volatility, p_1m - p_24h AS movement FROM anchors a JOIN f USING (token_id) JOIN q USING (token_id) LEFT JOIN v USING (token_id)""", "open_p p_24h p_1h p_1m volatility movement",
)(lambda t: prices.build_backtest_rows(t("prices"), t("anchors")).select("token_id", "outcome", "open_p", "n_points", "p_24h", "p_1h", "p_1m", "volatility", "movement"))
query(
    "a24_book_summary",
    """SELECT market_id, max(price) FILTER (WHERE side = 'bid') AS bid_top, sum(size) FILTER (WHERE side = 'bid' AND price = best_bid) AS bid_size, sum(price * size) FILTER (WHERE side = 'bid') AS bid_value, count(*) FILTER (WHERE side = 'bid') AS bid_depth,
    min(price) FILTER (WHERE side = 'ask') AS ask_top, sum(size) FILTER (WHERE side = 'ask' AND price = best_ask) AS ask_size, sum(price * size) FILTER (WHERE side = 'ask') AS ask_value, count(*) FILTER (WHERE side = 'ask') AS ask_depth
    FROM (SELECT *, max(CASE WHEN side = 'bid' THEN price END) OVER (PARTITION BY market_id) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) OVER (PARTITION BY market_id) AS best_ask FROM levels) GROUP BY market_id""", "bid_top bid_size bid_value ask_top ask_size ask_value",
)(lambda t: prices.book_summary(t("levels")))


def cut_sql(x: str, edges: list[float], lowest: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN {x} {'>=' if lowest and i == 0 else '>'} {a} AND {x} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


def calibration_sql(edges: list[float], lowest: bool) -> str:
    return f"SELECT * FROM (SELECT {cut_sql('close_p', edges, lowest)} AS bucket, count(*) AS n, avg(close_p) AS mean_p, avg(won) AS win_rate, avg(won) - avg(close_p) AS edge, CAST(round_even((avg(won) - avg(close_p)) * 10000, 0) AS BIGINT) AS edge_bps FROM backtest GROUP BY 1) WHERE bucket IS NOT NULL"


TENTHS, BANDS, DRIFTS = [i / 10 for i in range(11)], [0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 1.0], [-1.0, -0.15, -0.1, -0.02, 0.02, 0.1, 0.15, 1.0]
query("a12_bucket_calibration", calibration_sql(TENTHS, True), "mean_p win_rate edge")(lambda t: prices.bucket_calibration(t("backtest"), "close_p", TENTHS))
query("a13_favorite_longshot", calibration_sql(BANDS, False), "mean_p win_rate edge")(lambda t: prices.bucket_calibration(t("backtest"), "close_p", BANDS, lowest=False))
query("a14_calibration_by_league", "SELECT *, brier_open - brier_close AS improvement FROM (SELECT league, count(*) AS n, avg((open_p - won) ** 2) AS brier_open, avg((close_p - won) ** 2) AS brier_close FROM backtest GROUP BY league) WHERE n >= 30", "brier_open brier_close improvement")(lambda t: prices.calibration_by_league(t("backtest")))
query("a15_drift_signal", f"SELECT * FROM (SELECT {cut_sql('drift', DRIFTS)} AS bucket, count(*) AS n, avg(close_p) AS mean_close, avg(won) AS win_rate, avg(won) - avg(close_p) AS edge FROM backtest WHERE close_p BETWEEN .2 AND .8 GROUP BY 1) WHERE bucket IS NOT NULL", "mean_close win_rate edge")(lambda t: prices.drift_signal(t("backtest"), DRIFTS))
query(
    "a16_overround",
    "SELECT league, count(*) AS events, avg(c) AS mean_close, median(c) AS median_close, avg(o) AS mean_open, median(o) AS median_open FROM (SELECT league, event_id, coalesce(sum(close_p), 0) AS c, coalesce(sum(open_p), 0) AS o FROM backtest GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY league", "mean_close median_close mean_open median_open",
)(lambda t: prices.overround(t("backtest")))
query(
    "a17_quantile_bucket_brier",
    """WITH e AS (SELECT quantile_cont(volatility, [0.25, 0.5, 0.75]) AS e FROM backtest) SELECT CAST(CASE WHEN volatility <= e[1] THEN 0 WHEN volatility <= e[2] THEN 1 WHEN volatility <= e[3] THEN 2 ELSE 3 END AS INT) AS bucket, count(*) AS n,
    avg(volatility) AS mean_x, avg(won) AS win_rate, avg((close_p - won) ** 2) AS brier FROM backtest, e WHERE volatility IS NOT NULL GROUP BY 1""", "mean_x win_rate brier",
)(lambda t: prices.quantile_bucket_brier(t("backtest"), "volatility"))
query("a18_headroom", "SELECT count(*) AS n, avg((close_p - won) ** 2) AS brier, avg((close_p + 0.2 * (won - close_p) - won) ** 2) AS brier_moved FROM backtest", "brier brier_moved")(lambda t: prices.headroom(t("backtest")))
query(
    "a19_convergence",
    f"WITH q AS ({asof_sql(CONVERGENCE)}), j AS (SELECT q.*, outcome FROM q JOIN anchors USING (token_id)) " + " UNION ALL ".join(f"SELECT {i} AS place, '{o}' AS \"offset\", count({o}) AS n, 100 * count({o}) / count(*) AS coverage, avg(({o} - outcome) ** 2) AS brier FROM j" for i, o in enumerate(CONVERGENCE)), "coverage brier",
)(lambda t: prices.convergence(asof.asof_price(t("prices"), t("anchors").select("token_id", "kickoff"), CONVERGENCE).join(t("anchors").select("token_id", "outcome"), "token_id"), list(CONVERGENCE)))
