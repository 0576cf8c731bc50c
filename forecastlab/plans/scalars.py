"""Queries of the scalar functions (F), each over a whole view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from forecastlab.functions import decision as D
from forecastlab.functions import probability as P
from forecastlab.functions import score as S
from forecastlab.functions import text as X
from forecastlab.operators.markets import both_sides
from forecastlab.operators.player_rows import match_stats
from forecastlab.operators.usage import priced

from .base import query

c = F.col


def scalar(name: str, view: str, columns: Callable[[], dict], sql: str, floats: str = "", keys: str = "event_id"):
    """A query of computed columns of one view, next to its keys. Columns are made when it runs, for that takes a session."""
    names = keys.split()
    query(name, f"SELECT {', '.join(names)}, {sql} FROM {view}", floats)(lambda t: t(view).select(*names, *[v.alias(k) for k, v in columns().items()]))


EV = "CASE WHEN m > 0 AND m < 1 AND p BETWEEN 0 AND 1 THEN p * (1 - m) / m - (1 - p) END"
scalar("f1_ev_per_dollar", "forecasts", lambda: {"ev": D.ev_per_dollar(c("p"), c("m"))}, f"{EV} AS ev", "ev")
scalar("f2_realized_return", "forecasts", lambda: {"r": D.realized_return(c("m"), c("won") == 1)}, "CASE WHEN m > 0 AND m < 1 AND won IS NOT NULL THEN CASE won WHEN 1 THEN 1 / m - 1 ELSE -1 END END AS r", "r")
scalar(
    "f3_kelly_bet_size", "forecasts", lambda: {"stake": D.kelly_bet_size(c("p"), c("m"), F.lit(25_000.0), 0.5, 0.125)},
    "CASE WHEN m > 0 AND m < 1 AND ((1 - m) / m * p - (1 - p)) / ((1 - m) / m) > 0 THEN CAST(floor(25000 * least(((1 - m) / m * p - (1 - p)) / ((1 - m) / m) * 0.5, 0.125)) AS BIGINT) ELSE 0 END AS stake",
)
TEMPERED = "1 / (1 + exp(-ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) / 1.6))"
scalar("f4_apply_temperature", "forecasts", lambda: {"q": D.apply_temperature(c("p"), 1.6)}, f"{TEMPERED} AS q", "q")
scalar("f5_edge_flags", "forecasts", lambda: dict(zip(("negative_edge", "market_favorite"), D.edge_flags(c("p"), c("m")))), "p < m AS negative_edge, m >= 0.5 AS market_favorite")
scalar(
    "f6_probability_bucket", "forecasts", lambda: {"bucket": D.probability_bucket(c("p"))},
    "CASE WHEN p >= 0.95 THEN '0.95-1.00' ELSE '0.' || lpad(CAST(CAST(floor(p * 20) AS INT) * 5 AS VARCHAR), 2, '0') || '-0.' || lpad(CAST(CAST(floor(p * 20) AS INT) * 5 + 5 AS VARCHAR), 2, '0') END AS bucket",
)
scalar("f7_case_bucket", "forecasts", lambda: {"bucket": D.case_bucket(c("defens"))}, "CASE WHEN defens >= .85 THEN 5 WHEN defens >= .65 THEN 4 WHEN defens >= .45 THEN 3 WHEN defens >= .25 THEN 2 WHEN defens IS NOT NULL THEN 1 END AS bucket")
scalar("f8_ev_bar_level", "forecasts", lambda: {"level": D.ev_bar_level(D.ev_per_dollar(c("p"), c("m")))}, f"CASE WHEN {EV} >= .5 THEN 5 WHEN {EV} >= .3 THEN 4 WHEN {EV} >= .15 THEN 3 WHEN {EV} >= .05 THEN 2 WHEN {EV} >= 0 THEN 1 WHEN {EV} < 0 THEN 0 END AS level")
scalar("f9_divergence_label", "forecasts", lambda: {"label": D.divergence_label(c("gap_model"))}, "CASE WHEN gap_model IS NULL THEN 'no GBT prior' WHEN abs(gap_model) <= .05 THEN 'aligned' WHEN abs(gap_model) <= .1 THEN 'moderate' ELSE 'divergent' END AS label")
EV_GRADE = f"CASE WHEN {EV} IS NULL THEN 'Unrated' WHEN {EV} >= .3 THEN 'Prime' WHEN {EV} >= .15 THEN 'Edge' WHEN {EV} >= 0 THEN 'Thin' ELSE 'Negative' END"
scalar("f10_classify_ev", "forecasts", lambda: {"bucket": D.classify_ev(c("p"), c("m"))}, f"{EV_GRADE} AS bucket")


def decay_sql(gap: str) -> str:
    return f"CASE WHEN {gap} IS NOT NULL THEN greatest(0, least(1, 1 - greatest(0, -({gap})) / 0.2 - greatest(0, {gap}) / 0.4 - greatest(0, 0.5 - (p - ({gap}))) / 0.2)) END"


scalar("f11_gap_decay", "forecasts", lambda: {"decay": D.gap_decay(c("gap_market"), c("p"))}, f"{decay_sql('gap_market')} AS decay", "decay")
TURN = {g: f"(CASE WHEN is_a THEN {g} ELSE -{g} END)" for g in ("gap_market", "gap_model")}
RISK = f"""CASE WHEN defens IS NOT NULL THEN (0.4 * ({TEMPERED}) + 0.25 * greatest(0, least(1, defens)) + coalesce(0.15 * ({decay_sql(TURN['gap_market'])}), 0) + coalesce(0.2 * ({decay_sql(TURN['gap_model'])}), 0))
    / (0.65 + CASE WHEN gap_market IS NULL THEN 0 ELSE 0.15 END + CASE WHEN gap_model IS NULL THEN 0 ELSE 0.2 END) END"""
RISK_GRADE = f"CASE WHEN ({RISK}) IS NULL THEN 'Unrated' WHEN ({RISK}) >= .75 THEN 'Lock' WHEN ({RISK}) >= .6 THEN 'Lean' WHEN ({RISK}) >= .45 THEN 'Coin-flip' ELSE 'Avoid' END"
query("f12_classify_risk", f"SELECT event_id, {RISK} AS score, {RISK_GRADE} AS bucket FROM forecasts", "score")(lambda t: D.with_risk(t("forecasts"), 1.6, bucket="bucket").select("event_id", "score", "bucket"))


def graded(t):
    """Forecasts with their risk and value grades."""
    return D.with_risk(t("forecasts"), 1.6).withColumn("ev", D.ev_per_dollar(c("p"), c("m"))).withColumn("ev_bucket", D.ev_grade(c("ev"))).drop("ev")


query(
    "f13_bucket_rank",
    f"SELECT event_id, CAST(list_position(['Lock', 'Lean', 'Coin-flip', 'Avoid', 'Unrated'], {RISK_GRADE}) - 1 AS INT) AS risk_rank, CAST(list_position(['Prime', 'Edge', 'Thin', 'Negative', 'Unrated'], {EV_GRADE}) - 1 AS INT) AS ev_rank FROM forecasts",
)(lambda t: graded(t).select("event_id", D.bucket_rank(c("risk_bucket"), D.RISK_BUCKETS).alias("risk_rank"), D.bucket_rank(c("ev_bucket"), D.EV_BUCKETS).alias("ev_rank")))
RETRO = f"CASE WHEN {EV} IS NULL THEN 'no_ev' WHEN {EV} >= .5 THEN '50%+' WHEN {EV} >= .3 THEN '30-50%' WHEN {EV} >= .15 THEN '15-30%' WHEN {EV} >= 0 THEN '0-15%' ELSE 'negative' END"
scalar("f14_ev_retro_bucket", "forecasts", lambda: {"bucket": D.ev_retro_bucket(D.ev_per_dollar(c("p"), c("m")))}, f"{RETRO} AS bucket")
def NOTABLE():
    return F.when(c("partkey") % 4 > 0, (c("partkey") % 4) - 1)
def SMART():
    return F.when(c("partkey") % 4 > 0, (c("suppkey") % 3) - 1)
FLOW = "CASE WHEN partkey % 4 = 0 THEN 'no_snapshot' WHEN suppkey % 3 - 1 >= 1 THEN 'smart_present' WHEN partkey % 4 - 1 >= 1 THEN 'notable_only' ELSE 'no_insiders' END"
scalar("f15_flow_tier", "forecasts", lambda: {"tier": D.flow_tier(NOTABLE(), SMART())}, f"{FLOW} AS tier")

# Scores: the oracle reads sets with DuckDB's list functions.
SETS = """CASE WHEN regexp_matches(lower(score), 'ret|w/o|walkover|def\\.') THEN NULL ELSE list_filter(string_split_regex(trim(score), '\\s+'), lambda x: regexp_full_match(x, '\\d+-\\d+(\\(\\d+\\))?')) END"""
SET_A = "CAST(regexp_extract(x, '^(\\d+)-', 1) AS INT)"
SET_B = "CAST(regexp_extract(x, '-(\\d+)', 1) AS INT)"
def _BO():
    return F.when(c("match_id") % 4 == 0, 5).otherwise(3)
def _PARSED():
    return S.parse_score(c("score"), _BO(), c("winner_side"))
query(
    "f16_parse_score",
    f"""WITH m AS (SELECT match_id, winner_side, CASE WHEN match_id % 4 = 0 THEN 5 ELSE 3 END AS bo, {SETS} AS s FROM matches),
    n AS (SELECT *, list_transform(s, lambda x: {SET_A}) AS a, list_transform(s, lambda x: {SET_B}) AS b, list_transform(s, lambda x: contains(x, '(')) AS t FROM m WHERE len(s) > 0),
    k AS (SELECT match_id, CAST(len(a) AS INT) AS n_sets, len(a) = bo AS went_to_decider, CAST(len(list_filter(t, lambda x: x)) AS INT) AS n_tiebreaks,
        CAST(len(list_filter(range(1, len(a) + 1), lambda i: t[i] AND (CASE WHEN winner_side = 1 THEN a[i] > b[i] ELSE b[i] > a[i] END))) AS INT) AS winner_tiebreaks,
        (a[1] > b[1]) = (winner_side = 1) AS winner_won_set1, abs(a[-1] - b[-1]) AS final_margin, abs(a[-1] - b[-1]) <= 2 OR (greatest(a[-1], b[-1]) = 7 AND least(a[-1], b[-1]) = 6) AS is_close FROM n)
    SELECT match_id, n_sets, went_to_decider, n_tiebreaks, winner_tiebreaks, winner_won_set1, final_margin, is_close FROM matches LEFT JOIN k USING (match_id)""",
)(lambda t: t("matches").select("match_id", _PARSED().alias("s")).select("match_id", "s.*"))
query(
    "f17_set_games",
    f"""WITH m AS (SELECT match_id, {SETS} AS s FROM matches), g AS (SELECT match_id, CAST(list_sum(list_transform(s, lambda x: {SET_A})) AS INT) AS g1, CAST(list_sum(list_transform(s, lambda x: {SET_B})) AS INT) AS g2 FROM m)
    SELECT match_id, g1, g2, greatest(g1, g2) / (g1 + g2) AS completeness FROM g""", "completeness",
)(lambda t: t("matches").select("match_id", S.set_games(c("score")).alias("g")).select("match_id", "g.*").withColumn("completeness", S.match_completeness(c("g1"), c("g2"))))
def N_SETS():
    return F.when(c("match_id") % 6 > 0, (c("match_id") % 6).cast("int"))
scalar("f18_infer_best_of", "matches", lambda: {"best_of": S.infer_best_of(N_SETS(), S.keyed(c("rank_id"), S.TIERS))}, "CASE WHEN match_id % 6 >= 4 THEN 5 WHEN match_id % 6 = 3 AND rank_id = 4 THEN 5 ELSE 3 END AS best_of", keys="match_id")
scalar(
    "f19_surface_and_tier", "matches", lambda: {"surface": S.keyed(c("court_id"), S.SURFACES), "tier": S.keyed(c("rank_id"), S.TIERS)},
    "CASE court_id WHEN 1 THEN 'hard' WHEN 2 THEN 'clay' WHEN 3 THEN 'hard' WHEN 4 THEN 'carpet' WHEN 5 THEN 'grass' END AS surface, "
    "CASE rank_id WHEN 0 THEN 'futures' WHEN 1 THEN 'challenger' WHEN 2 THEN 'main_tour' WHEN 3 THEN 'masters' WHEN 4 THEN 'grand_slam' WHEN 5 THEN 'team_cup' WHEN 7 THEN 'tour_finals' END AS tier", keys="match_id",
)
scalar(
    "f20_set_diff", "matches", lambda: {"diff": S.set_diff(N_SETS(), S.infer_best_of(N_SETS(), S.keyed(c("rank_id"), S.TIERS)), c("winner_side") == 1)},
    "CASE WHEN match_id % 6 = 0 THEN NULL ELSE (CASE WHEN winner_side = 1 THEN 1 ELSE -1 END) * (CASE WHEN match_id % 6 >= 4 OR (match_id % 6 = 3 AND rank_id = 4) THEN 3 - greatest(match_id % 6 - 3, 0) ELSE 2 - greatest(match_id % 6 - 2, 0) END) END AS diff", keys="match_id",
)

# Probabilities.
def FI():
    return c("p1_fs_in") / c("p1_fs_att")
def FW():
    return c("p1_fs_won") / c("p1_fs_in")
def SW():
    return c("p1_ss_won") / (c("p1_fs_att") - c("p1_fs_in"))
PW = "(p1_fs_in / p1_fs_att * (p1_fs_won / p1_fs_in) + (1 - p1_fs_in / p1_fs_att) * (p1_ss_won / (p1_fs_att - p1_fs_in)))"
GAME = "pow({0}, 4) * (1 + 4 * (1 - {0}) + 10 * pow(1 - {0}, 2)) + 20 * pow({0}, 5) * pow(1 - {0}, 3) / (pow({0}, 2) + pow(1 - {0}, 2))"
scalar("f21_service_points", "matches", lambda: {"point": P.service_point_win(FI(), FW(), SW()), "hold": P.game_prob(P.service_point_win(FI(), FW(), SW()))}, f"{PW} AS point, CASE WHEN {PW} <= 0 THEN 0 WHEN {PW} >= 1 THEN 1 ELSE {GAME.format(PW)} END AS hold", "point hold", keys="match_id")
scalar(
    "f22_matchup_point_win", "matches", lambda: {"point": P.service_point_win(FI(), P.matchup_point_win(FW(), 1 - c("p2_fs_won") / c("p2_fs_in")), P.matchup_point_win(SW(), F.lit(0.5)))},
    "p1_fs_in / p1_fs_att * ((p1_fs_won / p1_fs_in + p2_fs_won / p2_fs_in) / 2) + (1 - p1_fs_in / p1_fs_att) * ((p1_ss_won / (p1_fs_att - p1_fs_in) + 0.5) / 2) AS point", "point", keys="match_id",
)
query(
    "f23_wilson_interval",
    """SELECT league, n, greatest(0, (rate + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(rate * (1 - rate) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) AS low,
              least(1, (rate + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(rate * (1 - rate) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)) AS high
       FROM (SELECT league, count(won) AS n, avg(won) AS rate FROM forecasts GROUP BY league)""", "low high",
)(lambda t: t("forecasts").groupBy("league").agg(F.count("won").alias("n"), F.avg("won").alias("rate")).select("league", "n", *[x.alias(k) for k, x in zip(("low", "high"), P.wilson_interval(c("rate"), c("n")))]))
L5 = "greatest(.001, least(.999, coalesce({0}, .5)))"
scalar("f24_log5", "forecasts", lambda: {"q": P.log5(c("model_p"), c("m"))}, f"{L5.format('model_p')} * (1 - {L5.format('m')}) / ({L5.format('model_p')} * (1 - {L5.format('m')}) + {L5.format('m')} * (1 - {L5.format('model_p')})) AS q", "q")
scalar("f25_paired_comparison", "matches", lambda: {"elo": P.elo_expected(1400.0 + c("p1") % 200, 1400.0 + c("p2") % 200), "bt": P.bradley_terry(c("p1_points"), c("p2_points"))}, "1 / (1 + pow(10, (p2 % 200 - p1 % 200) / 400.0)) AS elo, CASE WHEN p1_points > 0 AND p2_points > 0 THEN p1_points / (p1_points + p2_points) END AS bt", "elo bt", keys="match_id")
scalar("f26_season_encoding", "matches", lambda: dict(zip(("s", "k"), P.season_encoding(c("match_date")))), "sin(2 * pi() * dayofyear(match_date) / 366) AS s, cos(2 * pi() * dayofyear(match_date) / 366) AS k", "s k", keys="match_id")
query("f27_age_years", "SELECT player_id, date_diff('day', birthdate, DATE '2001-08-01') / 365.25 AS age, CAST(greatest(0, date_sub('year', birthdate, DATE '2001-08-01')) AS INT) AS whole FROM profiles WHERE birthdate IS NOT NULL", "age")(
    lambda t: t("profiles").filter("birthdate IS NOT NULL").select("player_id", P.age_years(F.lit("2001-08-01").cast("date"), c("birthdate")).alias("age"), P.age_whole_years(F.lit("2001-08-01").cast("date"), c("birthdate")).alias("whole"))
)
scalar("f28_prime_distance", "forecasts", lambda: {"d": P.prime_distance((c("partkey") % 25 + 16).cast("double")), "decay": P.peak_decay(c("suppkey") % 40, F.lit(20))}, "greatest(0, abs(partkey % 25 + 16 - 26.5) - 2.5) AS d, log10(greatest(suppkey % 40, 1) / 20.0) AS decay", "d decay")
scalar("f29_win_pct_from_record", "markets", lambda: {"wp": X.win_pct_from_record(c("record"))}, "CAST(split_part(record, '-', 1) AS INT) / nullif(CAST(split_part(record, '-', 1) AS INT) + CAST(split_part(record, '-', 2) AS INT), 0) AS wp", "wp", keys="event_id market_no")

# Names.
NORM = "trim(regexp_replace(replace(lower(strip_accents({0})), '-', ' '), '\\s+', ' ', 'g'))"
CAND = "list_distinct(list_filter(list_transform(CASE WHEN len({0}) >= 3 THEN [{0}[-1], {0}[-2]] ELSE [{0}[-1]] END, lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> ''))".format("string_split(" + NORM.format("{0}") + ", ' ')")
scalar("f30_normalize_name", "names", lambda: {"norm": X.normalize_name(c("name"))}, f"{NORM.format('name')} AS norm", keys="id")
query("f31_surname_candidates", f"SELECT id, list_aggregate(list_sort({CAND.format('name')}), 'string_agg', ',') AS candidates FROM names")(lambda t: t("names").select("id", F.array_join(F.array_sort(X.surname_candidates(c("name"))), ",").alias("candidates")))
query(
    "f32_pair_keys",
    f"""WITH k AS (SELECT id, unnest({CAND.format('name')}) AS x, {CAND.format("name2")} AS ys FROM (SELECT id, name, 'Rival ' || CAST(id % 3 AS VARCHAR) || ' Van Li' AS name2 FROM names)), j AS (SELECT id, x, unnest(ys) AS y FROM k)
    SELECT DISTINCT id, least(x, y) AS a, greatest(x, y) AS b FROM j WHERE x <> y""",
)(lambda t: t("names").select("id", F.explode(X.pair_keys(c("name"), F.concat(F.lit("Rival "), (c("id") % 3).cast("string"), F.lit(" Van Li")))).alias("k")).select("id", c("k")[0].alias("a"), c("k")[1].alias("b")))
REST = "substr(title, instr(title, ':') + 1)"
query(
    "f33_parse_h2h_title",
    f"""WITH h AS (SELECT id, CASE WHEN contains({REST}, ' vs. ') THEN string_split({REST}, ' vs. ') ELSE string_split({REST}, ' vs ') END AS h FROM names)
    SELECT id, CASE WHEN len(h) = 2 AND trim(h[1]) <> '' AND trim(h[2]) <> '' THEN trim(h[1]) END AS yes, CASE WHEN len(h) = 2 AND trim(h[1]) <> '' AND trim(h[2]) <> '' THEN trim(h[2]) END AS no FROM h""",
)(lambda t: t("names").select("id", X.parse_h2h_title(c("title")).alias("h")).select("id", "h.yes", "h.no"))
def _SLUG():
    return F.concat(F.element_at(F.array(*map(F.lit, ["atp", "wta", "itf", "epl"])), (c("partkey") % 4 + 1).cast("int")), F.lit("-x-y-"), c("day").cast("string"), F.when(c("partkey") % 5 == 0, "-exact-score").otherwise(""))
SLUG = "['atp', 'wta', 'itf', 'epl'][partkey % 4 + 1] || '-x-y-' || CAST(day AS VARCHAR) || CASE WHEN partkey % 5 = 0 THEN '-exact-score' ELSE '' END"
scalar(
    "f34_slug_predicates", "forecasts", lambda: {"game": X.is_game_event(_SLUG()), "variant": X.is_variant(_SLUG()), "league": X.league_of(_SLUG()), "tours": F.array_join(X.tours_of(X.league_of(_SLUG())), "+")},
    "partkey % 5 <> 0 AS game, partkey % 5 = 0 AS variant, ['atp', 'wta', 'itf', 'epl'][partkey % 4 + 1] AS league, ['atp', 'wta', 'atp+wta', ''][partkey % 4 + 1] AS tours",
)
#: Slugs of all known events, and of some that are none, of either tour and of no tour.
EVENT_NAMES = [*X.EVENT_SURFACES, "adelaide", "open-rome", ""]


def _EVENT_SLUG():
    part = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    return F.concat(part(["atp-", "wta-", "itf-"], c("suppkey") % 3), part(EVENT_NAMES, c("partkey") % len(EVENT_NAMES)), F.lit("-2026-x-vs-y"))


_NAME, _TOUR = f"{EVENT_NAMES}[partkey % {len(EVENT_NAMES)} + 1]", "suppkey % 3 < 2"
scalar(
    "f34_slug_surface_tier", "forecasts", lambda: {"surface": X.slug_surface(_EVENT_SLUG()), "tier": X.slug_tier(_EVENT_SLUG())},
    f"""CASE WHEN NOT ({_TOUR}) OR {_NAME} IN ('adelaide', 'open-rome', '') THEN NULL WHEN {_NAME} = 'wimbledon' THEN 'grass' WHEN regexp_matches({_NAME}, 'french|roland|monte|madrid|italian|rome') THEN 'clay' ELSE 'hard' END AS surface,
    CASE WHEN NOT ({_TOUR}) OR {_NAME} IN ('adelaide', 'open-rome', '') THEN NULL WHEN regexp_matches({_NAME}, '^(aus|french|roland|wimbledon|us-)') THEN 'grand_slam' ELSE 'masters' END AS tier""",
)


def _RAW():
    return F.element_at(F.array(*map(F.lit, ['["1","0"]', '["0.0005","0.9995"]', '["0.4","0.6"]', '["0", "1"]', '{"a"', "[]"])), (c("partkey") % 6 + 1).cast("int"))
_KIND = "partkey % 6"
scalar("f35_parse_json_list", "forecasts", lambda: {"n": F.size(X.parse_json_list(_RAW())), "first": F.try_element_at(X.parse_json_list(_RAW()), F.lit(1))}, f"[2, 2, 2, 2, NULL, 0][{_KIND} + 1] AS n, ['1', '0.0005', '0.4', '0', NULL, NULL][{_KIND} + 1] AS first")
scalar("f36_settled_yes", "forecasts", lambda: {"y": X.settled_yes(X.parse_json_list(_RAW()))}, f"[1, 0, NULL, 0, NULL, NULL][{_KIND} + 1] AS y")
scalar("f37_winning_index", "forecasts", lambda: {"i": X.winning_index(X.parse_json_list(_RAW()))}, f"[0, NULL, NULL, 1, NULL, NULL][{_KIND} + 1] AS i")
scalar("f38_market_state", "markets", lambda: {"state": D.market_state(c("accepting"), c("closed"))}, "CASE WHEN closed THEN 'CLOSED' WHEN accepting THEN 'OPEN' ELSE 'HALTED' END AS state", keys="event_id market_no")
def _quoted(t):
    """Markets with ladders of two levels a side, a change, dollars, and the session's prices."""
    level = lambda p, z: F.struct(p.alias("price"), z.cast("double").alias("size"))
    return t("markets").select(
        "event_id", "market_no", "bid", "ask", "bid_size", "ask_size", (c("bid") * c("bid_size")).alias("bid_dollars"), (c("ask") * c("ask_size")).alias("ask_dollars"),
        F.array(level(c("bid"), c("bid_size")), level(c("bid") - 0.01, c("ask_size"))).alias("bids"), F.array(level(c("ask"), c("ask_size")), level(c("ask") + 0.02, c("bid_size"))).alias("asks"),
        (c("bid") - 0.4).alias("change_1h"), (c("ask") + 0.05).alias("high"), (c("ask") - 0.05).alias("low"),
    )


NO = "SELECT event_id, market_no, 'no' AS side, 1 - ask AS bid, 1 - bid AS ask, ask_size AS bid_size, bid_size AS ask_size, ask * ask_size AS bid_dollars, bid * bid_size AS ask_dollars, 1 - ask AS best_bid, 1 - (ask + 0.02) AS next_bid, bid_size AS next_bid_size, 1 - bid AS best_ask, 1 - (bid - 0.01) AS next_ask, -(bid - 0.4) AS change_1h, NULL AS high, NULL AS low FROM markets"
query(
    "f39_invert_no_side",
    f"SELECT event_id, market_no, 'yes' AS side, bid, ask, bid_size, ask_size, bid * bid_size AS bid_dollars, ask * ask_size AS ask_dollars, bid AS best_bid, bid - 0.01 AS next_bid, ask_size AS next_bid_size, ask AS best_ask, ask + 0.02 AS next_ask, bid - 0.4 AS change_1h, ask + 0.05 AS high, ask - 0.05 AS low FROM markets UNION ALL {NO}",
    "bid ask bid_size ask_size bid_dollars ask_dollars best_bid next_bid next_bid_size best_ask next_ask change_1h high low",
)(lambda t: both_sides(_quoted(t)).select("*", c("bids")[0]["price"].alias("best_bid"), c("bids")[1]["price"].alias("next_bid"), c("bids")[1]["size"].alias("next_bid_size"), c("asks")[0]["price"].alias("best_ask"), c("asks")[1]["price"].alias("next_ask")).drop("bids", "asks"))
scalar("f40_mid_and_notional", "markets", lambda: {"mid": D.mid(c("bid"), c("ask")), "notional": c("bid") * c("bid_size")}, "(bid + ask) / 2 AS mid, bid * bid_size AS notional", "mid notional", keys="event_id market_no")
_arr = lambda n: F.array_repeat(F.lit("x"), n.cast("int"))
scalar(
    "f41_actionable", "forecasts", lambda: {"notable": D.is_notable(c("dollars") / 20000), "signal": D.has_actionable_signal(_arr(c("partkey") % 2), _arr(c("suppkey") % 2), c("p") * 10)},
    "dollars / 20000 >= 2 AS notable, partkey % 2 = 1 OR suppkey % 2 = 1 OR p * 10 >= 5 AS signal",
)
scalar("f42_reorient_probability", "forecasts", lambda: {"q": D.reorient_probability(c("p"), F.concat(F.lit(" "), F.upper("sport")), F.when(c("partkey") % 10 > 0, F.when(c("is_a"), c("sport")).otherwise("other")))}, "CASE WHEN partkey % 10 = 0 THEN NULL WHEN is_a THEN p ELSE 1 - p END AS q", "q")
scalar("f43_stack_probability", "forecasts", lambda: {"q": D.stack_probability(c("model_p"), c("sim_p"), [c("gap_model"), c("gap_market") / 4, c("defens") - 0.5])}, "greatest(0, least(1, coalesce(model_p, sim_p) + coalesce(gap_model, 0) + coalesce(gap_market / 4, 0) + coalesce(defens - 0.5, 0))) AS q", "q")
def _SHIFTS():
    return [c("gap_model"), c("gap_market") / 4, c("defens") - 0.5]
SHIFT = ["coalesce(gap_model, 0)", "coalesce(gap_market / 4, 0)", "coalesce(defens - 0.5, 0)"]
def _TOWARD():
    return F.when(c("is_a"), 1).otherwise(-1)
scalar(
    "f44_audit_flags", "forecasts",
    lambda: {"override": D.override_without_retract(c("p") - c("model_p"), _arr(c("partkey") % 2)), "should_be_low": D.should_be_low(_SHIFTS(), _TOWARD(), c("confidence")), "split": D.split_unjustified(c("model_p"), c("sim_p"), F.concat(F.lit("The Surface of "), c("sport")), ["tennis", "soccer"])},
    f"abs(p - model_p) > 0.01 AND partkey % 2 = 0 AS override, abs({' + '.join(SHIFT)}) >= 0.1 AND ({' + '.join(f'CASE WHEN {s} * (CASE WHEN is_a THEN 1 ELSE -1 END) >= 0.04 THEN 1 ELSE 0 END' for s in SHIFT)}) >= 2 AND confidence <> 'low' AS should_be_low, model_p < 0.5 AND sim_p >= 0.5 AND sport = 'Cricket' AS split",
)
scalar("f45_gaps", "forecasts", lambda: dict(zip(("to_market", "to_sim", "to_model"), D.gaps(c("p"), c("m"), c("is_a"), c("sim_p"), c("model_p")))), "p - CASE WHEN is_a THEN m ELSE 1 - m END AS to_market, p - sim_p AS to_sim, p - model_p AS to_model", "to_market to_sim to_model")
scalar("f46_grade_form", "forecasts", lambda: {"grade": D.grade_form(c("defens"), c("suppkey") % 12)}, "CASE WHEN suppkey % 12 < 5 OR defens IS NULL THEN 'average' WHEN defens >= .8 THEN 'elite' WHEN defens >= .65 THEN 'strong' WHEN defens >= .5 THEN 'average' WHEN defens >= .35 THEN 'below_avg' ELSE 'poor' END AS grade")
query(
    "f47_token_cost",
    "SELECT event_id, (coalesce(tokens_in, 0) * i + coalesce(tokens_out, 0) * o + coalesce(tokens_cached, 0) * k + coalesce(tokens_written, 0) * w) / 1e6 AS cost FROM calls LEFT JOIN (VALUES ('view', 3.0, 15.0, 0.3, 3.75), ('click', 1.0, 5.0, 0.1, 1.25), ('error', 0.25, 1.25, 0.03, 0.3)) AS r(model, i, o, k, w) USING (model)", "cost",
)(lambda t: priced(t("calls"), t.spark.createDataFrame([("view", 3.0, 15.0, 0.3, 3.75), ("click", 1.0, 5.0, 0.1, 1.25), ("error", 0.25, 1.25, 0.03, 0.3)], "model string, r_in double, r_out double, r_cached double, r_written double")).select("event_id", "cost"))
def _TXT():
    return F.element_at(F.array(*map(F.lit, [" 1.5 ", "x", "", "2e3"])), (c("partkey") % 4 + 1).cast("int"))
def _TIME():
    return F.element_at(F.array(*map(F.lit, ["2024-01-02T03:04:05", "nope", "2024-13-01", " 2020-02-29 00:00:00 "])), (c("partkey") % 4 + 1).cast("int"))
scalar(
    "f48_coerce", "forecasts", lambda: {"x": X.coerce_float(_TXT()), "year": F.year(X.coerce_time(_TIME())), "s": X.coerce_str(_TXT())},
    "[1.5, NULL, NULL, 2000][partkey % 4 + 1] AS x, [2024, NULL, NULL, 2020][partkey % 4 + 1] AS year, ['1.5', 'x', NULL, '2e3'][partkey % 4 + 1] AS s", "x",
)
scalar("f49_safe_ratio", "matches", lambda: {"r": D.safe_ratio(c("p1_bp_conv"), c("p1_bp_of").cast("double"))}, "CASE WHEN p1_bp_of > 0 THEN p1_bp_conv / p1_bp_of END AS r", "r", keys="match_id")
query(
    "f50_per_match_stats",
    """SELECT match_id, p1 AS subject, p1_fs_won / p1_fs_in AS fs_win, CASE WHEN p2_bp_of > 0 THEN (p2_bp_of - p2_bp_conv) / p2_bp_of END AS bp_saved FROM matches
       UNION ALL SELECT match_id, p2, p2_fs_won / p2_fs_in, CASE WHEN p1_bp_of > 0 THEN (p1_bp_of - p1_bp_conv) / p1_bp_of END FROM matches""", "fs_win bp_saved",
)(lambda t: match_stats(t("matches")))
def _CELLS():
    return F.map_from_arrays(F.array(F.lit("2021"), F.lit("career"), c("year")), F.array(*[F.struct(w.cast("int").alias("w"), x.cast("int").alias("l")) for w, x in ((F.lit(9), F.lit(9)), (F.lit(5), F.lit(5)), (c("partkey") % 3, c("suppkey") % 3))]))
query(
    "f51_latest_year_cells", "SELECT event_id, CASE WHEN line_no % 2 = 0 THEN 9 WHEN partkey % 3 + suppkey % 3 > 0 THEN CAST(partkey % 3 AS INT) END AS w, CASE WHEN line_no % 2 = 0 THEN 9 WHEN partkey % 3 + suppkey % 3 > 0 THEN CAST(suppkey % 3 AS INT) END AS l FROM forecasts",
)(lambda t: t("forecasts").withColumn("year", F.when(c("line_no") % 2 == 0, "2019").otherwise("2023")).select("event_id", X.latest_year_cells(_CELLS()).alias("k")).select("event_id", "k.w", "k.l"))
