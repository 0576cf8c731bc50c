"""Queries of point-in-time features."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from forecastlab.functions.score import SURFACES, TIERS, keyed
from forecastlab.operators import contests as C
from forecastlab.operators import elo as E
from forecastlab.operators import features as W
from forecastlab.operators.player_rows import player_rows
from forecastlab.session import remove, spent_shuffles

from .base import query, shared

c = F.col
FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
BY = "PARTITION BY tour, player ORDER BY match_date, match_id"
#: The counters that rates divide, in SQL.
COUNT = {
    "one": "1", "s_ss_att": "s_fs_att - s_fs_in", "o_ss_att": "o_fs_att - o_fs_in", "o_fs_lost": "o_fs_in - o_fs_won", "o_ss_lost": "o_fs_att - o_fs_in - o_ss_won",
    "o_bp_missed": "o_bp_of - o_bp_conv", "points_played": "s_points + o_points", "points_won": "CASE WHEN s_points + o_points IS NOT NULL THEN s_points END", "decider_won": "decider * won", "comeback": "lost_set1 * won", "close_won": "close * won",
}


def rate_sql(n: str, d: str, window: str = f"({BY} {FRAME})") -> str:
    part = lambda x: f"sum(coalesce({COUNT.get(x, x)}, 0) * exp(day / 365.0)) OVER {window}"
    return f"CASE WHEN {part(d)} * exp(-(max(day) OVER {window}) / 365.0) > 1e-9 THEN {part(n)} / {part(d)} END"


rows = lambda t: player_rows(t("matches"))
some = list(W.RATES)
query("w1_decayed_rate", f"SELECT match_id, player, {rate_sql('won', 'one')} AS winrate FROM pr", "winrate")(lambda t: W.rates(W.with_counts(rows(t)), ["winrate"]).select("match_id", "player", "winrate"))
query("w2_rates", f"SELECT match_id, player, {', '.join(f'{rate_sql(*W.RATES[k])} AS r_{k}' for k in some)} FROM pr", " ".join(f"r_{k}" for k in some))(
    lambda t: W.with_counts(rows(t)).select("match_id", "player", *[W.decayed_rate(*W.RATES[k], W.before("tour", "player")).alias(f"r_{k}") for k in some])
)
SURF = f"(PARTITION BY tour, player, surface ORDER BY match_date, match_id {FRAME})"
query("w3_surface_rate", f"SELECT match_id, player, {rate_sql('won', 'one', SURF)} AS rate, count(*) OVER {SURF} AS n, coalesce(sum(won) OVER {SURF}, 0) AS wins FROM pr WHERE surface IS NOT NULL", "rate")(
    lambda t: W.with_counts(rows(t)).filter("surface IS NOT NULL").select("match_id", "player", W.decayed_rate("won", "one", W.before("tour", "player", "surface")).alias("rate"), F.count("*").over(W.before("tour", "player", "surface")).alias("n"), F.coalesce(F.sum("won").over(W.before("tour", "player", "surface")), F.lit(0)).alias("wins"))
)
last = lambda n: f"avg(won) OVER ({BY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
query("w4_last_n_winrate", f"SELECT match_id, player, {last(5)} AS last_5, {last(10)} AS last_10, {last(25)} AS last_25, CASE WHEN surface IS NOT NULL THEN avg(won) OVER (PARTITION BY tour, player, surface ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS last_10_surface FROM pr", "last_5 last_10 last_25 last_10_surface")(
    lambda t: W.form(rows(t)).select("match_id", "player", "last_5", "last_10", "last_25", "last_10_surface")
)
query("w5_form_string", f"SELECT match_id, player, string_agg(CASE WHEN won = 1 THEN 'W' ELSE 'L' END, '') OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS form_string FROM pr")(lambda t: W.form(rows(t)).select("match_id", "player", "form_string"))
query("w6_prior_counts", f"SELECT match_id, player, count(*) OVER ({BY} {FRAME}) AS prior_count, CAST(coalesce(sum(won) OVER ({BY} {FRAME}), 0) AS BIGINT) AS prior_wins FROM pr")(lambda t: W.form(rows(t)).select("match_id", "player", "prior_count", "prior_wins"))
H = f"(PARTITION BY tour, player, opponent ORDER BY match_date, match_id {FRAME})"
H2H = {"h2h_wins": "won", "h2h_decider_n": "decider", "h2h_decider_w": "decider * won", "h2h_tb_n": "tb_played", "h2h_tb_w": "tb_won", "h2h_comeback_n": "lost_set1", "h2h_comeback_w": "lost_set1 * won", "h2h_close_n": "close", "h2h_close_w": "close * won"}
query("w7_h2h_state", f"SELECT match_id, player, count(*) OVER {H} AS h2h_total, {', '.join(f'CAST(coalesce(sum({v}) OVER {H}, 0) AS BIGINT) AS {k}' for k, v in H2H.items())}, CASE WHEN count(*) OVER {H} > 0 THEN sum(won) OVER {H} / count(*) OVER {H} - 0.5 END AS h2h_advantage FROM pr", "h2h_advantage")(
    lambda t: W.h2h_state(W.with_counts(rows(t))).select("match_id", "player", "h2h_total", *H2H, "h2h_advantage")
)
query("w8_days_since_last", f"SELECT match_id, player, CASE WHEN max(day) OVER ({BY} {FRAME}) IS NOT NULL THEN CAST(least(greatest(day - max(day) OVER ({BY} {FRAME}), 0), 30) AS INT) END AS d FROM pr")(
    lambda t: W.workload(rows(t)).select("match_id", "player", c("days_since_last").cast("int").alias("d"))
)
query("w9_contests_in_last_days", "SELECT a.match_id, a.player, CAST(least(count(b.match_id), 32) AS BIGINT) AS n FROM pr a LEFT JOIN pr b ON a.tour = b.tour AND a.player = b.player AND b.day > a.day - 14 AND (b.day < a.day OR b.day = a.day AND b.match_id < a.match_id) GROUP BY a.match_id, a.player")(
    lambda t: W.workload(rows(t)).select("match_id", "player", c("contests_14d").cast("long").alias("n"))
)
RECENT = """WITH k AS ({src}), j AS (SELECT a.match_id, a.player, b.v, row_number() OVER (PARTITION BY a.match_id, a.player ORDER BY b.match_date DESC, b.match_id DESC) AS i
    FROM k a JOIN k b ON a.tour = b.tour AND a.player = b.player AND b.v IS NOT NULL AND (b.match_date < a.match_date OR b.match_date = a.match_date AND b.match_id < a.match_id))
    SELECT k.match_id, k.player, (SELECT avg(v) FROM j WHERE j.match_id = k.match_id AND j.player = k.player AND i <= 10) AS r FROM k"""
OPP = "SELECT p.*, r.rank AS v FROM pr p ASOF LEFT JOIN rankings r ON p.tour = r.tour AND p.opponent = r.player_id AND p.match_date >= r.ranking_date"
query("w10_avg_recent_opp_rank", RECENT.format(src=OPP), "r")(lambda t: W.recent_known(W.with_ranks(rows(t), t("rankings")), {"opp_rank": "r"}).select("match_id", "player", "r"))
query("w11_avg_recent_set_diff", RECENT.format(src="SELECT *, set_diff AS v FROM pr"), "r")(lambda t: W.recent_known(rows(t), {"set_diff": "r"}).select("match_id", "player", "r"))
PERIODS = [f"{y}-0{m}-01" for y in range(1995, 2002) for m in (1, 7)]
ON = "CASE surface " + " ".join(f"WHEN '{x}' THEN {{0}}.on_{x}" for x in E.ON) + " END"


def elo_sql(where: str) -> str:
    """CTEs that end in er (match_id, player, elo, surface_elo): ratings before each contest, period after period."""
    out = [
        f"cm AS MATERIALIZED (SELECT match_id, tour, p1, p2, surface, winner_side, make_date(year(match_date), CASE WHEN month(match_date) < 7 THEN 1 ELSE 7 END, 1) AS period FROM facts WHERE {where})",
        f"st0 AS (SELECT CAST(NULL AS VARCHAR) AS tour, CAST(NULL AS BIGINT) AS player, {', '.join(f'CAST(NULL AS DOUBLE) AS {r}' for r in E.RATINGS)} WHERE false)",
    ]
    for k, period in enumerate(PERIODS, 1):
        side = lambda n, who: f"coalesce({who}.elo, 1500.0) AS e{n}, coalesce({ON.format(who)}, {who}.elo, 1500.0) AS s{n}"
        out.append(
            f"m{k} AS MATERIALIZED (SELECT c.*, {side(1, 'a')}, {side(2, 'b')} FROM cm c LEFT JOIN st{k - 1} a ON a.tour = c.tour AND a.player = c.p1 "
            f"LEFT JOIN st{k - 1} b ON b.tour = c.tour AND b.player = c.p2 WHERE c.period = DATE '{period}')"
        )
        gain = lambda r: f"24 * ((winner_side = 1)::INT - 1 / (1 + pow(10, ({r}2 - {r}1) / 400)))"
        moves = f"SELECT tour, p1 AS player, surface, {gain('e')} AS g, {gain('s')} AS h FROM m{k} UNION ALL SELECT tour, p2, surface, -{gain('e')}, -{gain('s')} FROM m{k}"
        sums = ", ".join(f"sum(CASE WHEN surface = '{x}' THEN h END) AS g_{x}" for x in E.ON)
        on = ", ".join(f"CASE WHEN g_{x} IS NOT NULL THEN coalesce(on_{x}, elo, 1500.0) + g_{x} ELSE on_{x} END AS on_{x}" for x in E.ON)
        out.append(
            f"st{k} AS MATERIALIZED (SELECT coalesce(s.tour, v.tour) AS tour, coalesce(s.player, v.player) AS player, coalesce(elo, 1500.0) + coalesce(g, 0) AS elo, {on} "
            f"FROM st{k - 1} s FULL JOIN (SELECT tour, player, sum(g) AS g, {sums} FROM ({moves}) GROUP BY 1, 2) v ON s.tour = v.tour AND s.player = v.player)"
        )
    both = " UNION ALL ".join(f"SELECT match_id, p{n} AS player, e{n} AS elo, s{n} AS surface_elo FROM m{k}" for k in range(1, len(PERIODS) + 1) for n in (1, 2))
    return ", ".join([*out, f"er AS ({both})"])


def rated(t, matches, folder: str | None = None):
    """Contests with both players' ratings before their half-year, kept in the shared folder."""
    surface, period = keyed(c("court_id"), SURFACES).alias("surface"), E.half_year(c("match_date")).alias("period")
    return E.rated_contests(matches.select("match_id", "match_date", "tour", "p1", "p2", "winner_side", surface, period), folder or shared(t), ("match_id", "match_date"))


query("w12_elo", f"WITH {elo_sql('true')} SELECT * FROM er", "elo surface_elo")(lambda t: E.by_player(rated(t, t("matches"))).select("match_id", "player", "elo", "surface_elo"))
query("w13_history_snapshot", "SELECT tour, player, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, max(match_date) AS last_date, sum(won * exp(day / 365.0)) / sum(exp(day / 365.0)) AS winrate, sum(s_fs_won * exp(day / 365.0)) / sum(s_fs_in * exp(day / 365.0)) AS first_serve_win, sum((o_bp_of - o_bp_conv) * exp(day / 365.0)) / nullif(sum(o_bp_of * exp(day / 365.0)), 0) AS bp_save FROM pr WHERE match_date < DATE '1999-06-01' GROUP BY tour, player", "winrate first_serve_win bp_save")(
    lambda t: W.history_snapshot(rows(t), "1999-06-01")
)
PAIR = f"WITH f AS (SELECT *, {rate_sql('won', 'one')} AS wr, {last(10)} AS l10 FROM pr) SELECT a.match_id, a.player AS anchor, a.wr AS a_wr, b.wr AS b_wr, a.l10 AS a_l10, b.l10 AS b_l10 FROM f a JOIN f b ON a.match_id = b.match_id AND a.side <> b.side"
query("j13_pair_histories", PAIR, "a_wr b_wr a_l10 b_l10")(lambda t: W.pair_histories(W.form(W.rates(W.with_counts(rows(t)), ["winrate"])).withColumnsRenamed({"winrate": "wr", "last_10": "l10"}), ["wr", "l10"]).select("match_id", "anchor", "a_wr", "b_wr", "a_l10", "b_l10"))
query("w14_anchor_features", f"WITH q AS ({PAIR.replace('WITH f', 'WITH f', 1)}) SELECT match_id, anchor, a_wr - b_wr AS wr_diff, a_l10 - b_l10 AS l10_diff FROM q", "wr_diff l10_diff")(
    lambda t: W.anchor_features(W.pair_histories(W.form(W.rates(W.with_counts(rows(t)), ["winrate"])).withColumnsRenamed({"winrate": "wr", "last_10": "l10"}), ["wr", "l10"]), ["wr", "l10"]).select("match_id", "anchor", "wr_diff", "l10_diff")
)
def valid_matches(t):
    """Contests, some of them without a winner."""
    return t("matches").withColumn("winner_side", F.when(c("match_id") % 97 != 0, c("winner_side")))


def training(t, matches, min_priors: int, **observed):
    return W.training_table(matches, t("rankings"), t("profiles"), rated(t, matches.filter(W.valid_contest())), min_priors=min_priors, **observed)


def tours_in_turns(matches, contests: int) -> list[list]:
    """Tours in groups of about so many contests, or of one larger tour."""
    groups, room = [], 0
    for r in matches.groupBy("tour").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tour").collect():
        if r["n"] > room:
            groups, room = [*groups, []], contests
        groups[-1].append(r["tour"])
        room -= r["n"]
    return groups


def write_training(t, matches, min_priors: int, path: str, columns: list, at_once: int = 3_000_000) -> None:
    """Columns of the training table, written group after group of tours: their players never meet, so only a group's rows are shuffled at a time.

    What the steps leave on disk goes with them: shuffles when a group is written, ratings after the last one.
    """
    ratings, sources = shared(t), (matches, t("rankings"), t("profiles"))
    with spent_shuffles(t.spark):
        known = rated(t, matches.filter(W.valid_contest()), ratings)
        for tours in tours_in_turns(matches, at_once) or [[]]:
            among = F.lit(False)
            for tour in tours:
                among = among | c("tour").eqNullSafe(F.lit(tour))
            rows = W.training_table(*[s.filter(among) for s in sources], known.filter(among), min_priors=min_priors)
            rows.select(*columns).write.mode("append").option("compression", "zstd").parquet(path)
    remove(t.spark, ratings)


W_ = f"({BY} {FRAME})"
LAST = f"(PARTITION BY tour, player, surface ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
ten = lambda v: f"list_avg(list_slice(list({v}) FILTER ({v} IS NOT NULL) OVER {W_}, -10, -1))"
#: The states that the training table compares, in SQL; those in terms of others come after.
STATE_SQL = {k: rate_sql(*W.RATES[k]) for k in W.RATES if k in W.STATES} | {
    "surface_first_serve_win": rate_sql("s_fs_won", "s_fs_in", SURF), "surface_winrate": rate_sql("won", "one", SURF), "last_10_on_surface": f"avg(won) OVER {LAST}",
    "last_5": last(5), "last_10": last(10), "last_25": last(25), "days_since_last": f"least(greatest(day - max(day) OVER {W_}, 0), 30)",
    "contests_14d": "least(count(*) OVER (PARTITION BY tour, player ORDER BY day RANGE BETWEEN 13 PRECEDING AND 1 PRECEDING) + row_number() OVER (PARTITION BY tour, player, day ORDER BY match_id) - 1, 32)",
    "recent_opp_rank": ten("opp_rank"), "recent_set_diff": ten("set_diff"), "prior_count": f"count(*) OVER {W_}", "h2h_total": f"count(*) OVER {H}",
    "h2h_advantage": f"CASE WHEN count(*) OVER {H} > 0 THEN sum(won) OVER {H} / count(*) OVER {H} - 0.5 END",
    "age": "date_diff('day', coalesce(birthdate, CAST(min(match_date) OVER (PARTITION BY tour, player) - INTERVAL 228 MONTHS AS DATE)), match_date) / 365.25",
}
TIER = "CASE rank_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TIERS.items()) + " ELSE 'unknown' END"
TRAINING = f"""{elo_sql('match_id % 97 <> 0')}, v AS (SELECT * FROM pr WHERE match_id % 97 <> 0),
    o AS (SELECT v.*, r.rank AS opp_rank FROM v ASOF LEFT JOIN rankings r ON v.tour = r.tour AND v.opponent = r.player_id AND v.match_date >= r.ranking_date),
    s AS (SELECT o.*, r.rank, r.rank_points FROM o ASOF LEFT JOIN rankings r ON o.tour = r.tour AND o.player = r.player_id AND o.match_date >= r.ranking_date),
    q AS (SELECT s.*, er.elo, er.surface_elo, b.birthdate FROM s JOIN er USING (match_id, player) LEFT JOIN profiles b ON b.tour = s.tour AND b.player_id = s.player),
    g AS (SELECT match_id, tour, match_date, side, player, opponent, won, surface, rank_id, bo, rank, rank_points, elo, surface_elo, {', '.join(f'{v} AS {k}' for k, v in STATE_SQL.items())} FROM q),
    h AS (SELECT *, abs(age - 30) AS age_to_30, age * elo AS age_x_elo, first_serve_in * first_serve_win + (1 - first_serve_in) * second_serve_win AS serve_point_win FROM g),
    f AS (SELECT *, CASE WHEN serve_point_win <= 0 THEN 0 WHEN serve_point_win >= 1 THEN 1 ELSE pow(serve_point_win, 4) * (1 + 4 * (1 - serve_point_win) + 10 * pow(1 - serve_point_win, 2))
        + 20 * pow(serve_point_win, 5) * pow(1 - serve_point_win, 3) / (pow(serve_point_win, 2) + pow(1 - serve_point_win, 2)) END AS hold FROM h)"""
differences = ", ".join(f"{'b.{0} - a.{0}' if k in W.REVERSED else 'a.{0} - b.{0}'} AS {{0}}_diff".format(k) for k in W.STATES)
turn = "2 * pi() * dayofyear(a.match_date) / 366"
query(
    "w15_training_table",
    f"""WITH {TRAINING} SELECT a.match_id, a.player AS anchor, a.won, a.prior_count AS anchor_priors, b.prior_count AS other_priors, {differences}, a.h2h_advantage, a.h2h_total AS h2h_meetings,
    sin({turn}) AS season_sin, cos({turn}) AS season_cos, coalesce(a.surface, 'unknown') AS surface, {TIER.replace('rank_id', 'a.rank_id')} AS tier, CAST(coalesce(a.bo, 3) AS VARCHAR) AS best_of
    FROM f a JOIN f b ON a.match_id = b.match_id AND a.side <> b.side WHERE a.prior_count >= 5 AND b.prior_count >= 5""", " ".join(n for n in W.NUMERIC if n != "h2h_meetings"),
)(lambda t: training(t, valid_matches(t), 5).select("match_id", "anchor", "won", "anchor_priors", "other_priors", *W.NUMERIC, *W.CATEGORICAL))


@query(
    "w15_drop_counters",
    """WITH k AS (SELECT match_id, count(*) OVER (PARTITION BY tour, player ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM pr WHERE match_id % 97 <> 0), m AS (SELECT match_id, min(n) AS n FROM k GROUP BY 1)
    SELECT 2 * count(*) FILTER (WHERE n >= 5) AS n_rows, count(*) FILTER (WHERE n < 5) AS cold_start, (SELECT count(*) FROM matches WHERE match_id % 97 = 0) AS other FROM m""",
)
def _counters(t):
    """What the one pass that writes the table counts on its way."""
    read, paired = Observation("read"), Observation("paired")
    training(t, valid_matches(t), 5, read=read, paired=paired).write.parquet(shared(t))
    found = W.drop_counters(read, paired)
    return t.spark.createDataFrame([(found["rows"], found["cold_start"], found["other"])], "n_rows long, cold_start long, other long")


DAY = "(PARTITION BY tour, player ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
query("w16_slate_state", f"SELECT match_id, player, count(*) OVER {DAY} AS prior_count, CAST(coalesce(sum(won) OVER {DAY}, 0) AS BIGINT) AS prior_wins, {rate_sql('won', 'one', DAY)} AS winrate FROM pr", "winrate")(lambda t: W.slate_state(rows(t)).select("match_id", "player", "prior_count", "prior_wins", "winrate"))
query(
    "w17_project_player", "WITH l AS (SELECT *, max(day) OVER (PARTITION BY tour, player) AS last FROM pr) SELECT tour, player, surface, CAST(round_even(sum(won * exp((day - last) / 365.0)), 0) AS INT) AS w, CAST(round_even(sum((1 - won) * exp((day - last) / 365.0)), 0) AS INT) AS l, CAST(sum(won) AS BIGINT) AS raw_w, CAST(sum(1 - won) AS BIGINT) AS raw_l FROM l WHERE surface IS NOT NULL GROUP BY 1, 2, 3",
)(lambda t: W.project_player(rows(t)))
query("a44_first_appearance", "SELECT tour, player, min(match_date) AS first_seen FROM pr GROUP BY tour, player")(lambda t: W.first_appearance(rows(t)))
query("j7_join_profiles", "WITH s AS (SELECT tour, player, min(match_date) AS f FROM pr GROUP BY 1, 2) SELECT match_id, pr.player, name, coalesce(birthdate, CAST(f - INTERVAL 228 MONTHS AS DATE)) AS birthdate FROM pr JOIN s USING (tour, player) LEFT JOIN profiles q ON q.tour = pr.tour AND q.player_id = pr.player")(
    lambda t: W.join_profiles(rows(t), t("profiles")).select("match_id", "player", "name", "birthdate")
)
query(
    "a27_clutch_records",
    """SELECT tour, player, CAST(sum(tb_won) AS BIGINT) AS tb_won, CAST(nullif(sum(tb_played), 0) AS BIGINT) AS tb_played, CAST(sum(decider * won) AS BIGINT) AS decider_won, CAST(nullif(sum(decider), 0) AS BIGINT) AS deciders, CAST(sum(lost_set1 * won) AS BIGINT) AS comebacks, CAST(nullif(sum(lost_set1), 0) AS BIGINT) AS lost_first,
    CAST(sum(close * won) AS BIGINT) AS close_won, CAST(nullif(sum(close), 0) AS BIGINT) AS close_played, sum(CASE WHEN match_date > DATE '2000-06-01' - 180 THEN o_bp_of - o_bp_conv END) / nullif(sum(CASE WHEN match_date > DATE '2000-06-01' - 180 THEN o_bp_of END), 0) AS bp_save FROM pr WHERE match_date <= DATE '2000-06-01' GROUP BY tour, player""", "bp_save",
)(lambda t: C.clutch_records(W.with_counts(rows(t)), "2000-06-01"))
@query(
    "a28_h2h_summary",
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY tour, player, opponent ORDER BY match_date DESC, match_id DESC) AS i FROM pr),
    s AS (SELECT tour, player, opponent, string_agg(surface || '=' || CAST(w AS VARCHAR) || '-' || CAST(n - w AS VARCHAR), ',' ORDER BY surface) AS surfaces FROM (SELECT tour, player, opponent, surface, count(*) AS n, CAST(sum(won) AS BIGINT) AS w FROM pr WHERE surface IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3),
    g AS (SELECT tour, player, opponent, count(*) AS meetings, CAST(sum(won) AS BIGINT) AS wins, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 3) AS last_three FROM k GROUP BY 1, 2, 3)
    SELECT g.*, coalesce(s.surfaces, '') AS surfaces FROM g LEFT JOIN s USING (tour, player, opponent)""",
)
def _h2h(t):
    text = F.transform(F.map_entries("surfaces"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["w"].cast("string"), F.lit("-"), e["value"]["l"].cast("string")))
    return C.h2h_summary(rows(t)).withColumn("surfaces", F.array_join(F.array_sort(text), ","))


def record_sql(w: str, n: str, name: str) -> str:
    return f"CAST(CASE WHEN sum({n}) > 0 THEN sum({w}) END AS BIGINT) AS {name}_w, CAST(nullif(sum({n}), 0) AS BIGINT) AS {name}_n"


OF = lambda k: (f"CASE WHEN coalesce(bo, 3) = {k} THEN won END", f"CASE WHEN coalesce(bo, 3) = {k} THEN 1 END")
query(
    "a29_matchup_stats",
    f"""SELECT tour, player, opponent, {record_sql('decider * won', 'decider', 'decider')}, {record_sql('tb_won', 'tb_played', 'tiebreak')}, {record_sql(*OF(3), 'best_of_3')}, {record_sql(*OF(5), 'best_of_5')},
    sum(CASE WHEN lost_set1 = 0 THEN won END) / nullif(sum(1 - lost_set1), 0) AS set1_conversion, sum(lost_set1 * won) / nullif(sum(lost_set1), 0) AS comeback, sum(s_fs_won) / nullif(sum(s_fs_in), 0) AS first_serve_win, sum(s_bp_conv) / nullif(sum(s_bp_of), 0) AS bp_convert
    FROM pr GROUP BY 1, 2, 3""", "set1_conversion comeback first_serve_win bp_convert",
)(lambda t: C.matchup_stats(W.with_counts(rows(t))).select("tour", "player", "opponent", *[c(r)[k].alias(f"{r}_{k}") for r in ("decider", "tiebreak", "best_of_3", "best_of_5") for k in ("w", "n")], "set1_conversion", "comeback", "first_serve_win", "bp_convert"))
query(
    "a30_consistency",
    """WITH k AS (SELECT tour, player, stddev_pop(x) AS s1, count(x) AS n1, stddev_pop(y) AS s2, count(y) AS n2 FROM (SELECT tour, player, s_fs_in / nullif(s_fs_att, 0) AS x, s_fs_won / nullif(s_fs_in, 0) AS y FROM pr) GROUP BY 1, 2),
    m AS (SELECT tour, player, CASE WHEN n1 >= 5 THEN greatest(0, least(1, 1 - s1 / 0.25)) END AS a, CASE WHEN n2 >= 5 THEN greatest(0, least(1, 1 - s2 / 0.2)) END AS b FROM k) SELECT tour, player, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS consistency FROM m""", "consistency",
)(lambda t: C.consistency(rows(t), F.try_divide(c("s_fs_in"), c("s_fs_att")), F.try_divide(c("s_fs_won"), c("s_fs_in"))))
query(
    "a31_modal_surface",
    "WITH k AS (SELECT tour, player, surface, count(*) AS n, sum(count(*)) OVER (PARTITION BY tour, player) AS total, row_number() OVER (PARTITION BY tour, player ORDER BY count(*) DESC, surface) AS i FROM pr WHERE surface IS NOT NULL GROUP BY 1, 2, 3) SELECT tour, player, surface, n, CAST(total AS BIGINT) AS total FROM k WHERE i = 1 AND total >= 3 AND n >= 0.6 * total",
)(lambda t: C.modal_surface(rows(t)))
