"""Bindings: views of the given tables that have the operators' input schemas, and the registry of queries.

A view is one SELECT that Spark and DuckDB both run, so a query and its oracle read the same rows.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    # One forecast a line item: the model's and the market's probability of the picked side, and how it ended.
    "forecasts": """
        SELECT l_orderkey * 8 + l_linenumber AS event_id, CAST(l_suppkey % 5 AS INT) AS run_id, l_linenumber AS line_no,
               'lg' || CAST(l_partkey % 7 AS STRING) || '-' || CAST(l_orderkey % 2000 AS STRING) AS slug, 'lg' || CAST(l_partkey % 7 AS STRING) AS league,
               CASE l_partkey % 3 WHEN 0 THEN 'tennis' WHEN 1 THEN 'soccer' ELSE 'Cricket' END AS sport,
               CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
               l_quantity / 51e0 AS p, CASE WHEN l_linenumber = 7 THEN NULL ELSE ROUND(5e-2 + l_discount * 8e0 + l_tax, 4) END AS m,
               CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE NULL END AS won,
               CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE (l_partkey % 101) / 100e0 END AS defens, l_suppkey % 2 = 0 AS is_a,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (l_partkey % 97) / 97e0 END AS model_p, (l_orderkey % 89) / 89e0 AS sim_p,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 51e0 - 5e-1 - l_discount END AS gap_market,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_tax * 3e0 - 1e-1 END AS gap_model,
               CASE l_linestatus WHEN 'O' THEN 'atp' ELSE 'wta' END AS tour, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS dollars, l_partkey AS partkey, l_suppkey AS suppkey
        FROM {lineitem}""",
    # One contest an order: two players, who won, a score from player 1's side, and box-score counters.
    "matches": """
        SELECT o_orderkey AS match_id, CASE o_orderstatus WHEN 'O' THEN 'atp' WHEN 'F' THEN 'wta' ELSE 'itf' END AS tour, CAST(o_orderdate AS DATE) AS match_date,
               o_custkey AS p1, o_custkey + 1 + o_orderkey % 3 AS p2, CASE WHEN (o_orderkey % 7) * 3 % 5 < 3 THEN 1 ELSE 2 END AS winner_side,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS INT) END AS court_id, CAST(o_orderkey % 8 AS INT) AS rank_id, CAST(o_orderkey % 9 AS INT) AS round_id,
               CASE o_orderkey % 10 WHEN 0 THEN '6-4 6-3' WHEN 1 THEN '7-6(3) 6-4' WHEN 2 THEN '4-6 6-2 6-3' WHEN 3 THEN '6-7(5) 7-6(8) 7-6(4)' WHEN 4 THEN '6-2 3-1 ret.' WHEN 5 THEN NULL
                   WHEN 6 THEN '6-4 3-6 6-2 7-5' WHEN 7 THEN '2-6 3-6' WHEN 8 THEN '6-3 x 6-4' ELSE '' END AS score,
               30 + CAST(FLOOR(o_totalprice) AS BIGINT) % 40 AS p1_fs_att, 15 + CAST(FLOOR(o_totalprice) AS BIGINT) % 15 AS p1_fs_in, 8 + CAST(FLOOR(o_totalprice) AS BIGINT) % 7 AS p1_fs_won, 4 + o_orderkey % 9 AS p1_ss_won,
               30 + (CAST(FLOOR(o_totalprice) AS BIGINT) + o_custkey) % 40 AS p2_fs_att, 15 + (CAST(FLOOR(o_totalprice) AS BIGINT) + o_custkey) % 15 AS p2_fs_in, 8 + (CAST(FLOOR(o_totalprice) AS BIGINT) + o_custkey) % 7 AS p2_fs_won, 4 + o_orderkey % 7 AS p2_ss_won,
               o_orderkey % 12 AS p1_bp_of, CAST(FLOOR((o_orderkey % 12) * (o_custkey % 4) / 4e0) AS BIGINT) AS p1_bp_conv, CAST(FLOOR((o_orderkey % 10) * (o_custkey % 3) / 3e0) AS BIGINT) AS p2_bp_conv, o_orderkey % 10 AS p2_bp_of, o_orderkey % 6 AS p1_aces, o_custkey % 6 AS p2_aces, o_orderkey % 5 AS p1_dfs, o_custkey % 4 AS p2_dfs,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 100 + CAST(FLOOR(o_totalprice) AS BIGINT) % 5000 END AS p1_points, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 100 + (CAST(FLOOR(o_totalprice) AS BIGINT) * 7 + o_custkey) % 5000 END AS p2_points
        FROM {orders}""",
    "profiles": """
        SELECT CASE c_custkey % 3 WHEN 0 THEN 'atp' WHEN 1 THEN 'wta' ELSE 'itf' END AS tour, c_custkey AS player_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'left' ELSE 'right' END AS plays,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(CAST(1965 + c_custkey % 25 AS STRING) || '-0' || CAST(1 + c_custkey % 9 AS STRING) || '-15' AS DATE) END AS birthdate
        FROM {customer}""",
    # A ranking snapshot an order: where its customer stood on its day.
    "rankings": """
        SELECT CASE o_orderstatus WHEN 'O' THEN 'atp' WHEN 'F' THEN 'wta' ELSE 'itf' END AS tour, CAST(o_orderdate AS DATE) AS ranking_date, o_custkey + o_orderkey % 2 AS player_id,
               CAST(1 + MIN(CAST(FLOOR(o_totalprice) AS BIGINT)) % 800 AS INT) AS rank, CAST(MAX(CAST(FLOOR(o_totalprice) AS BIGINT)) % 9000 AS INT) AS rank_points
        FROM {orders} GROUP BY 1, 2, 3""",
    # A price point an event: its user is the token.
    "prices": """
        SELECT user_id AS token_id, ts AS t, event_id, CASE WHEN value >= 400 THEN 1e0 ELSE value / 400e0 END AS p FROM {events}""",
    # An anchor a token: the event whose prices before it are looked up.
    "anchors": """
        SELECT user_id AS token_id, MAX(ts) AS kickoff, COUNT(*) % 2 AS outcome, CAST(user_id % 4 AS INT) AS league_no FROM {events} GROUP BY user_id""",
    # A two- or three-way market an order: a row for each line item, with quotes.
    "markets": """
        SELECT l_orderkey AS event_id, l_linenumber AS market_no, 'lg' || CAST(l_orderkey % 5 AS STRING) || '-' || CAST(l_orderkey AS STRING) AS slug, 'lg' || CAST(l_orderkey % 5 AS STRING) AS league,
               CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE 'side' || CAST(l_linenumber AS STRING) END AS label, l_shipdate AS start,
               CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE ROUND(l_discount * 9e0, 4) END AS bid, ROUND(l_discount * 9e0 + l_tax / 1e1 + 1e-2, 4) AS ask,
               l_quantity AS bid_size, l_quantity + l_suppkey % 7 AS ask_size, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_extendedprice / 1e2 END AS open_interest, l_extendedprice AS volume,
               l_returnflag <> 'R' AS accepting, l_linestatus = 'F' AND l_returnflag = 'A' AS closed, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 40 AS STRING) || '-' || CAST(l_suppkey % 30 AS STRING) END AS record
        FROM {lineitem}""",
    # Order-book levels: a price and size a line item, in its order's book.
    "levels": """
        SELECT l_orderkey AS market_id, CASE WHEN l_linenumber % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, ROUND(l_discount * 9e0 + l_tax, 3) AS price, l_quantity AS size FROM {lineitem}""",
    # Backtest rows: an outcome a line item, its closing and opening price and movement.
    "backtest": """
        SELECT l_orderkey AS event_id, 'lg' || CAST(l_orderkey % 40 AS STRING) AS league, l_quantity / 50e0 AS close_p, CASE WHEN l_linenumber = 6 THEN NULL ELSE ROUND(l_discount * 1e1, 4) END AS open_p,
               CASE WHEN l_linenumber = 5 THEN NULL ELSE ROUND(l_tax * 6e0 - 2e-1, 3) END AS drift, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice / 1e5 END AS volatility,
               CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS won
        FROM {lineitem}""",
    # Pairs of candidates: a contest an order, with both sides' records, rates, ages, ratings, and a forecast and a price.
    "pairs": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'atp' WHEN 'F' THEN 'wta' ELSE 'itf' END AS tour, CAST(date_trunc('month', o_orderdate) AS DATE) AS day,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS STRING) END AS surface, o_orderkey % 9 AS round_id, CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 3 END AS best_of,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 100 + CAST(FLOOR(o_totalprice) AS BIGINT) % 5000 END AS a_points, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE 100 + (CAST(FLOOR(o_totalprice) AS BIGINT) * 7 + o_custkey) % 5000 END AS b_points,
               o_orderkey % 11 AS a_form_n, CAST(FLOOR((o_orderkey % 11) * (o_custkey % 5) / 4e0) AS BIGINT) AS a_form_w, (o_orderkey + 3) % 11 AS b_form_n, CAST(FLOOR(((o_orderkey + 3) % 11) * (o_custkey % 3) / 2e0) AS BIGINT) AS b_form_w,
               o_orderkey % 10 AS a_surf_n, CAST(FLOOR((o_orderkey % 10) * (o_custkey % 6) / 5e0) AS BIGINT) AS a_surf_w, (o_custkey + 2) % 10 AS b_surf_n, CAST(FLOOR(((o_custkey + 2) % 10) * (o_orderkey % 3) / 2e0) AS BIGINT) AS b_surf_w,
               o_orderkey % 31 AS a_all_n, CAST(FLOOR((o_orderkey % 31) * (o_custkey % 7) / 6e0) AS BIGINT) AS a_all_w, o_custkey % 29 AS b_all_n, CAST(FLOOR((o_custkey % 29) * (o_orderkey % 4) / 3e0) AS BIGINT) AS b_all_w,
               CASE WHEN o_custkey % 21 = 0 THEN NULL ELSE 6e-1 + (o_custkey % 20) / 1e2 END AS a_serve, 6e-1 + (o_orderkey % 20) / 1e2 AS b_serve, 25e-2 + (o_custkey % 12) / 1e2 AS a_ret, 25e-2 + (o_orderkey % 12) / 1e2 AS b_ret,
               (o_custkey % 50) / 5e1 AS a_decider, CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE (o_orderkey % 50) / 5e1 END AS b_decider, (o_custkey % 40) / 4e1 AS a_tiebreak, (o_orderkey % 40) / 4e1 AS b_tiebreak,
               CAST(18 + o_custkey % 20 AS DOUBLE) AS a_age, CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE CAST(18 + o_orderkey % 20 AS DOUBLE) END AS b_age, o_custkey % 60 AS a_last_days, CASE WHEN o_orderkey % 18 = 0 THEN NULL ELSE o_orderkey % 60 END AS b_last_days,
               CAST(1400 + o_custkey % 300 AS DOUBLE) AS a_elo, CAST(1400 + o_orderkey % 300 AS DOUBLE) AS b_elo, o_orderkey % 8 AS meetings, CAST(FLOOR((o_orderkey % 8) * (o_custkey % 4) / 3e0) AS BIGINT) AS a_h2h_wins,
               CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE 5e-2 + (o_orderkey % 91) / 1e2 END AS p, 5e-2 + (o_custkey % 90) / 1e2 AS m, CASE WHEN (o_orderkey % 7) * 3 % 5 < 3 THEN 1 ELSE 0 END AS won,
               CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE CAST(1 + o_custkey % 200 AS INT) END AS a_rank, CAST(1 + o_custkey % 40 AS INT) AS a_best_rank, CAST(1 + o_orderkey % 300 AS INT) AS b_rank,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 60 AS INT) END AS b_best_rank, CASE WHEN o_orderkey % 16 = 0 THEN NULL ELSE (o_custkey % 33) / 33e0 END AS a_consistency,
               (o_orderkey % 27) / 27e0 AS b_consistency, CAST(o_orderkey % 8 AS INT) AS rank_id, o_orderkey % 4 AS surface_meetings,
               CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'right' END AS a_plays, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'left' END AS b_plays, CASE WHEN o_custkey % 26 = 0 THEN NULL ELSE 6e-1 END AS a_bp, CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE 5e-1 END AS b_bp
        FROM {orders}""",
    # Forecasts of a player to win, with the names and titles they come with; listings of contests, and the markets of these.
    "picks": """
        SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Ann-Lee Sur' || CAST(o_custkey AS STRING) END AS a_name, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Bo Riv' || CAST(o_orderkey % 1000 AS STRING) END AS b_name,
               CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE 'Cup: Ann-Lee Sur' || CAST(o_custkey AS STRING) || ' vs. Bo Riv' || CAST(o_orderkey % 1000 AS STRING) END AS title,
               CASE WHEN o_orderkey % 12 = 3 THEN 'Somebody Else' WHEN o_orderkey % 4 = 0 THEN 'ann lee Sur' || CAST(o_custkey AS STRING) WHEN o_orderkey % 4 = 2 THEN 'A. Sur' || CAST(o_custkey AS STRING) ELSE 'BO RIV' || CAST(o_orderkey % 1000 AS STRING) END AS predicted
        FROM {orders}""",
    "listings": """
        SELECT o_orderkey AS listing_id, 'Sur' || CAST(o_custkey AS STRING) || ' vs Riv' || CAST(o_orderkey % 1000 AS STRING) || CASE WHEN o_orderkey % 11 = 0 THEN ': Exact Score' ELSE '' END AS title FROM {orders} WHERE o_orderkey % 3 > 0
        UNION ALL SELECT -o_orderkey, 'Sur' || CAST(o_custkey AS STRING) || ' vs Riv' || CAST(o_orderkey % 1000 AS STRING) FROM {orders} WHERE o_orderkey % 13 = 0""",
    "listing_markets": """
        SELECT o_orderkey AS listing_id, 1 AS market_no, CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE 'Ann-Lee Sur' || CAST(o_custkey AS STRING) END AS label, CASE WHEN o_orderkey % 6 = 4 THEN 'closed' ELSE 'Active' END AS status, CASE WHEN o_orderkey % 8 = 6 THEN NULL ELSE 5e-1 END AS ask FROM {orders}
        UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderkey % 14 = 1 THEN 'Cy' ELSE 'Bo Riv' || CAST(o_orderkey % 1000 AS STRING) END, 'active', CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE 4e-1 END FROM {orders}
        UNION ALL SELECT o_orderkey, 3, 'Di Riv' || CAST(o_orderkey % 1000 AS STRING), 'active', 3e-1 FROM {orders} WHERE o_orderkey % 22 = 5""",
    "names": """
        SELECT s_suppkey AS id, s_name || ' O''Né-' || CASE s_suppkey % 4 WHEN 0 THEN 'Ångström' WHEN 1 THEN 'de  la Cruz' WHEN 2 THEN 'Müller' ELSE 'Li' END AS name, 'Cup ' || CAST(s_nationkey AS STRING) || ': ' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' vs. ' ELSE ' vs ' END || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'Other ' || CAST(s_suppkey % 11 AS STRING) END AS title FROM {supplier}""",
    "calls": """
        SELECT event_id, event_type AS model, user_id % 3 AS event_no, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(FLOOR(value * 10) AS BIGINT) END AS tokens_in, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE CAST(FLOOR(value * 3) AS BIGINT) END AS tokens_out,
               CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(FLOOR(value) AS BIGINT) END AS tokens_cached, CAST(FLOOR(value / 2) AS BIGINT) AS tokens_written
        FROM {events}""",
    "trades": """
        SELECT CAST(event_id % 6 AS INT) AS run_id, user_id AS event_no, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'filled' WHEN 'click' THEN 'partial' WHEN 'signup' THEN 'submitted' WHEN 'error' THEN 'skipped' ELSE 'dry_run' END AS status,
               CASE WHEN event_type = 'error' THEN 'reason' || CAST(event_id % 3 AS STRING) ELSE NULL END AS reason, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS cost
        FROM {events}""",
}

#: Views that only oracles use, in terms of the others: contests with facts of their scores, and contests as two rows.
ORACLE_VIEWS = {
    "facts": """
        SELECT m.*, CASE court_id WHEN 1 THEN 'hard' WHEN 2 THEN 'clay' WHEN 3 THEN 'hard' WHEN 4 THEN 'carpet' WHEN 5 THEN 'grass' END AS surface, len(a) AS n_sets, bo,
            len(a) = bo AS decider, CAST(len(list_filter(t, lambda x: x)) AS INT) AS breaks, CAST(len(list_filter(range(1, len(a) + 1), lambda i: t[i] AND (CASE WHEN winner_side = 1 THEN a[i] > b[i] ELSE b[i] > a[i] END))) AS INT) AS winner_breaks,
            (a[1] > b[1]) = (winner_side = 1) AS winner_set1, abs(a[-1] - b[-1]) <= 2 OR (greatest(a[-1], b[-1]) = 7 AND least(a[-1], b[-1]) = 6) AS is_close
        FROM matches m LEFT JOIN (
            SELECT *, CASE WHEN len(a) >= 4 OR len(a) = 3 AND rank_id = 4 THEN 5 ELSE 3 END AS bo FROM (
                SELECT match_id, rank_id, list_transform(s, lambda x: CAST(regexp_extract(x, '^(\\d+)-', 1) AS INT)) AS a, list_transform(s, lambda x: CAST(regexp_extract(x, '-(\\d+)', 1) AS INT)) AS b, list_transform(s, lambda x: contains(x, '(')) AS t
                FROM (SELECT match_id, rank_id, list_filter(string_split_regex(trim(score), '\\s+'), lambda x: regexp_full_match(x, '\\d+-\\d+(\\(\\d+\\))?')) AS s FROM matches WHERE NOT regexp_matches(lower(score), 'ret|w/o|walkover|def\\.'))
                WHERE len(s) > 0)) k USING (match_id)""",
    "pr": " UNION ALL ".join(
        f"""
        SELECT match_id, tour, match_date, surface, round_id, {n} AS side, p{n} AS player, p{o} AS opponent, CASE WHEN winner_side = {n} THEN 1 ELSE 0 END AS won, date_diff('day', DATE '1995-01-01', match_date) AS day,
            p{n}_fs_att AS s_fs_att, p{n}_fs_in AS s_fs_in, p{n}_fs_won AS s_fs_won, p{n}_ss_won AS s_ss_won, p{n}_bp_of AS s_bp_of, p{n}_bp_conv AS s_bp_conv, p{n}_aces AS s_aces, p{n}_dfs AS s_dfs, p{n}_points AS s_points,
            p{o}_fs_att AS o_fs_att, p{o}_fs_in AS o_fs_in, p{o}_fs_won AS o_fs_won, p{o}_ss_won AS o_ss_won, p{o}_bp_of AS o_bp_of, p{o}_bp_conv AS o_bp_conv, p{o}_aces AS o_aces, p{o}_dfs AS o_dfs, p{o}_points AS o_points, rank_id, bo,
            CASE WHEN decider THEN 1 WHEN NOT decider THEN 0 END AS decider, CASE WHEN is_close THEN 1 WHEN NOT is_close THEN 0 END AS close, breaks AS tb_played, CASE WHEN winner_side = {n} THEN winner_breaks ELSE breaks - winner_breaks END AS tb_won,
            CASE WHEN winner_set1 IS NOT NULL THEN CASE WHEN winner_set1 <> (winner_side = {n}) THEN 1 ELSE 0 END END AS lost_set1,
            (CASE WHEN winner_side = {n} THEN 1 ELSE -1 END) * (bo // 2 + 1 - greatest(n_sets - (bo // 2 + 1), 0)) AS set_diff
        FROM facts""" for n, o in ((1, 2), (2, 1))),
}


class Tables:
    """The given tables and the views of them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        paths = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in TABLES}
        return self.spark.sql(VIEWS[name].format(**paths))


def shared(t: Tables) -> str:
    """A new folder in the shared one that the cluster names; a temporary one only on a local master, where one machine does all work."""
    named = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="forecastlab-")
    return f"{named.rstrip('/')}/forecastlab-{uuid4().hex}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, floats: str = ""):
    """Registers a function of Tables as query `name`, and sql as its oracle. Columns in floats are rounded to 6 places on both sides, ties up."""
    rounded = floats.split()

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double") + 1e-9, 6) + F.lit(0.0) for c in rounded}) if rounded else df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, rounded)
        return f

    return wrap


def oracle(sql: str, rounded: list[str]) -> str:
    """sql with the views it names, and with the rounded columns."""
    known, used, todo = VIEWS | ORACLE_VIEWS, [], sql
    while todo:
        new = [v for v in known if v not in used and re.search(rf"\b(FROM|JOIN)\s+{v}\b", todo)]
        used, todo = new + used, " ".join(known[v] for v in new)
    used = [v for v in known if v in used]
    ctes = [f"{v} AS ({(VIEWS[v].format(**{t: t for t in TABLES}) if v in VIEWS else ORACLE_VIEWS[v]).strip()})" for v in used]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        first, body = body[5:], ""
        return _rounding(f"WITH {', '.join([*ctes, first])}" if ctes else f"WITH {first}", rounded)
    return _rounding((f"WITH {', '.join(ctes)} " if ctes else "") + body, rounded)


def _rounding(sql: str, rounded: list[str]) -> str:
    if not rounded:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + 1e-9, 6) + 0.0 AS {c}' for c in rounded)}) FROM ({sql})"
