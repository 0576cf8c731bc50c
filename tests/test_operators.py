"""Operators against naive folds, and properties: no leakage, no dependence on row order."""

import json
import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from forecastlab.operators import asof, decisions, elo, features, markets, models, prices, retro, scoring, selection, usage
from forecastlab.operators.player_rows import player_rows
from forecastlab.plans.base import Tables
from forecastlab.plans.features import training
from forecastlab.sources import readers, writers
from forecastlab.streaming import streams


@pytest.fixture(scope="module")
def tables(spark, sf):
    return Tables(spark, sf)


@pytest.fixture(scope="module")
def contests(spark):
    rng, rows = random.Random(4), []
    for i in range(220):
        a, b = rng.sample(range(9), 2)
        rows.append((i, "atp", date(2020, 1, 1) + timedelta(days=rng.randint(0, 200)), a, b, rng.choice([1, 2]), rng.choice(["hard", "clay", None])))
    return spark.createDataFrame(rows, "match_id long, tour string, match_date date, p1 long, p2 long, winner_side int, surface string")


def long_rows(matches):
    side = lambda own, other, n: F.struct(F.lit(n).alias("side"), F.col(own).alias("player"), F.col(other).alias("opponent"), (F.col("winner_side") == n).cast("int").alias("won"))
    return matches.select("match_id", "tour", "match_date", "surface", F.datediff("match_date", F.lit("2019-01-01")).alias("day"), F.inline(F.array(side("p1", "p2", 1), side("p2", "p1", 2))))


def test_decay_and_form_match_a_fold(contests):
    rows = long_rows(contests).withColumn("one", F.lit(1))
    got = {(r["match_id"], r["player"]): r for r in features.workload(features.form(rows.withColumn("winrate", features.decayed_rate("won", "one", features.before("tour", "player"))))).collect()}
    state = {}
    for m in sorted(contests.collect(), key=lambda r: (r["match_date"], r["match_id"])):
        for side, player in ((1, m["p1"]), (2, m["p2"])):
            past, r = state.get(player, []), got[m["match_id"], player]
            n = d = 0.0
            last = None
            for when, won in past:
                f = math.exp(-(when - last).days / 365) if last else 1.0
                n, d, last = n * f + won, d * f + 1, when
            assert (r["winrate"] is None) == (d <= 1e-9) and (d <= 1e-9 or r["winrate"] == pytest.approx(n / d))
            assert r["prior_count"] == len(past) and r["form_string"] == ("".join("LW"[w] for _, w in past[-10:]) or None)
            assert r["last_5"] == (pytest.approx(sum(w for _, w in past[-5:]) / len(past[-5:])) if past else None)
            assert r["contests_14d"] == min(32, sum((m["match_date"] - when).days < 14 for when, _ in past))
        for side, player in ((1, m["p1"]), (2, m["p2"])):
            state.setdefault(player, []).append((m["match_date"], int(m["winner_side"] == side)))


@pytest.mark.parametrize("days", [1, 40])
def test_elo_matches_a_fold_by_periods(spark, contests, tmp_path, days):
    """Ratings before each contest's period, against a fold that closes a period's contests together."""
    period = lambda d: date(2020, 1, 1) + timedelta(days=(d - date(2020, 1, 1)).days // days * days)
    as_period = F.date_add(F.lit("2020-01-01").cast("date"), (F.floor(F.datediff("match_date", F.lit("2020-01-01")) / days) * days).cast("int"))
    matches = contests.withColumn("period", as_period)
    history = elo.elo_history(matches, str(tmp_path / "elo"))
    got = {(r["match_id"], r["side"]): r for r in elo.with_elo(long_rows(contests).withColumn("period", as_period), history).collect()}
    rating, on, rows = {}, {}, sorted(contests.collect(), key=lambda r: period(r["match_date"]))
    assert len(got) == 2 * len(rows)
    for p in sorted({period(r["match_date"]) for r in rows}):
        now, new, new_on = [r for r in rows if period(r["match_date"]) == p], dict(rating), dict(on)
        for m in now:
            a, b = rating.get(m["p1"], 1500.0), rating.get(m["p2"], 1500.0)
            sa, sb = on.get((m["p1"], m["surface"]), a), on.get((m["p2"], m["surface"]), b)
            one, two = got[m["match_id"], 1], got[m["match_id"], 2]
            assert (one["elo"], two["elo"]) == (pytest.approx(a), pytest.approx(b))
            assert (one["surface_elo"], two["surface_elo"]) == ((pytest.approx(sa), pytest.approx(sb)) if m["surface"] else (pytest.approx(a), pytest.approx(b)))
            won = float(m["winner_side"] == 1)
            g, h = 24 * (won - 1 / (1 + 10 ** ((b - a) / 400))), 24 * (won - 1 / (1 + 10 ** ((sb - sa) / 400)))
            for player, base, sign in ((m["p1"], a, 1), (m["p2"], b, -1)):
                new[player] = new.get(player, 1500.0) + sign * g
                if m["surface"]:
                    new_on[player, m["surface"]] = new_on.get((player, m["surface"]), base) + sign * h
        rating, on = new, new_on


def test_elo_of_no_contests(spark, contests, tmp_path):
    none = contests.limit(0).withColumn("period", F.col("match_date"))
    history = elo.elo_history(none, str(tmp_path / "none"))
    assert history.count() == 0
    rows = elo.with_elo(long_rows(contests).withColumn("period", F.col("match_date")), history)
    assert {(r["elo"], r["surface_elo"]) for r in rows.collect()} == {(1500.0, 1500.0)}


def test_features_do_not_leak_and_ignore_row_order(tables):
    matches = tables("matches")
    exact = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    table = lambda m: {(r["match_id"], r["anchor"]): exact(r) for r in training(tables, m, 2).collect()}
    whole = table(matches)
    assert table(matches.orderBy(F.rand(3)).repartition(5)) == whole
    early = table(matches.filter("match_date < DATE '1998-06-01'"))
    assert early and all(whole[k] == v for k, v in early.items())


def test_budget_equals_the_greedy_loop(spark):
    rng = random.Random(2)
    rows = [(g, i, float(rng.randint(0, 40))) for g in range(60) for i in range(rng.randint(1, 12))]
    got = {(r["g"], r["i"]): r["alloc"] for r in decisions.budget_allocation(spark.createDataFrame(rows, "g int, i int, size double"), 100.0, 15.0, "g", ["i"]).collect()}
    for g in range(60):
        left = 85.0
        for _, i, size in [r for r in rows if r[0] == g]:
            alloc = min(size, left)
            left -= alloc
            assert got[g, i] == pytest.approx(alloc)


def test_scores_on_small_cases(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.3, 0), (0.3, 1), (0.0, 0), (1.0, 1)], "p double, y int")
    assert scoring.auc(df).first()["auc"] == pytest.approx((4 * 2 - 0.5 * 1) / 8)
    assert scoring.auc(df.filter("y = 1")).first()["auc"] is None
    assert df.agg(scoring.brier()).first()[0] == pytest.approx((0.01 + 0.04 + 0.09 + 0.49) / 6)
    curve = scoring.calibration_curve(df).orderBy("bin").collect()
    assert len(curve) == 10 and curve[9]["n"] == 2 and curve[5]["n"] == 0 and curve[5]["mean_p"] is None
    assert scoring.scorecard(df.limit(0)).count() == 0 and df.limit(0).agg(scoring.log_loss()).first()[0] is None


def test_temperature_round_trip(spark):
    rng, rows = random.Random(9), []
    for _ in range(4000):
        p = rng.uniform(0.05, 0.95)
        q = 1 / (1 + math.exp(-math.log(p / (1 - p)) / 1.6))
        rows.append((round(p, 3), int(rng.random() < q)))
    df = spark.createDataFrame(rows, "p double, y int")
    assert models.fit_temperature(df, tolerance=1e-2) == pytest.approx(1.6, abs=0.2)
    assert models.fit_temperature(df.limit(20)) is None and models.fit_temperature(df.withColumn("y", F.lit(1))) is None


def test_asof_and_nearest(spark):
    points = spark.createDataFrame([("a", 100, 0.1, 1), ("a", 200, 0.2, 2), ("b", 50, 0.3, 3)], "token_id string, s long, p double, event_id long").withColumn("t", F.timestamp_seconds("s"))
    anchors = spark.createDataFrame([("a", 260), ("b", 40), ("c", 1)], "token_id string, s long").select("token_id", F.timestamp_seconds("s").alias("kickoff"))
    got = {r["token_id"]: (r["x"], r["y"]) for r in asof.asof_price(points, anchors, {"x": 60, "y": 61}).collect()}
    assert got == {"a": (0.2, 0.1), "b": (None, None), "c": (None, None)}
    near = {r["token_id"]: r["w"] for r in asof.nearest_within(points, anchors, {"w": 110}, tolerance=60).collect()}
    assert near == {"a": 0.1, "b": None, "c": None}
    last = asof.last_before(points.select("token_id", "t", "p"), anchors, ["token_id"], "t", "kickoff", ["p"], through=False)
    assert {r["token_id"]: r["p"] for r in last.collect()} == {"a": 0.2, "b": None, "c": None}


def test_sparkline_short_and_inverted(spark):
    points = spark.createDataFrame([("a", i, i / 10) for i in range(9)] + [("b", 0, 0.25)], "token_id string, event_id long, p double").withColumn("t", F.timestamp_seconds("event_id"))
    assert {r["token_id"]: r["line"] for r in prices.sparkline(points).collect()} == {"a": "0.000→0.200→0.400→0.600→0.800", "b": "0.250"}
    assert {r["token_id"]: r["line"] for r in prices.sparkline(points, 2, invert=True).collect()} == {"a": "1.000→0.200", "b": "0.750"}


def test_filters_drop_unknowns(spark):
    df = spark.createDataFrame([(1, "high", 0.5, 0.6, 0.5), (2, None, 0.5, 0.6, 0.5), (3, "high", None, 0.6, 0.5), (4, "high", 0.5, 0.6, None), (5, "high", 0.5, 0.4, 0.5)], "id int, confidence string, defens double, p double, m double")
    assert [r["id"] for r in decisions.filter_forecasts(df, ["high"], 0.1, True).collect()] == [1]
    assert decisions.filter_forecasts(df).count() == 5


def test_coverage_gate_is_off_without_fixtures(spark):
    events = spark.createDataFrame([(1, "atp"), (2, "epl")], "event_id long, league string")
    none = spark.createDataFrame([], "event_id long")
    assert markets.coverage_filter(events, none, ["atp"]).count() == 2
    assert [r["event_id"] for r in markets.coverage_filter(events, spark.createDataFrame([(9,)], "event_id long"), ["atp"]).collect()] == [2]


def test_last_resolution_and_upsert(spark):
    lines = spark.createDataFrame([(1, "a", False, None, 0), (1, "a", True, 1, 1), (2, "a", False, None, 0)], "run_id int, slug string, settled boolean, outcome int, line int")
    assert {(r["run_id"], r["settled"]) for r in retro.last_lines(lines).collect()} == {(1, True), (2, False)}
    old = spark.createDataFrame([("a", True, 1), ("b", False, None)], "slug string, settled boolean, outcome int")
    new = spark.createDataFrame([("a", True, 0), ("b", True, 0), ("c", False, None)], "slug string, settled boolean, outcome int")
    assert {r["slug"]: (r["settled"], r["outcome"]) for r in retro.upsert_resolutions(old, new).collect()} == {"a": (True, 1), "b": (True, 0), "c": (False, None)}


def test_user_scorer_is_clamped(spark):
    import pandas as pd

    score = selection.as_udf(lambda x: pd.Series([v * 3 if v > 0 else None for v in x]))
    df = spark.createDataFrame([(0.1,), (0.9,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(score(F.col("x"))).collect()] == pytest.approx([0.3, 1.0, 0.0])
    noise = {r["id"]: r["s"] for r in spark.range(50).select("id", selection.random_score(F.col("id"), 1).alias("s")).collect()}
    assert noise == {r["id"]: r["s"] for r in spark.range(50).repartition(7).select("id", selection.random_score(F.col("id"), 1).alias("s")).collect()}


def test_populate_rate(spark):
    df = spark.createDataFrame([("", 0, []), ("x", None, ["a"])], "s string, n int, a array<string>")
    assert {r["field"]: r["populated"] for r in usage.populate_rate(df, ["s", "n", "a"]).collect()} == {"s": 1, "n": 1, "a": 1}
    assert usage.populate_rate(df.limit(0), ["s"]).first()["rate"] is None


def test_logs_round_trip(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    good = {"record_type": "prediction", "event_id": 1, "market_slug": "s", "predicted_winner": "a", "predicted_yes_probability": 0.5, "confidence": "high"}
    (runs / "r1.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", json.dumps(good | {"confidence": None}), json.dumps({"record_type": "meta"})]))
    (runs / "r1.resolutions.jsonl").write_text("\n".join(json.dumps(x) for x in ({"slug": "s", "settled": False}, {"slug": "s", "settled": True, "outcome": 1})))
    assert [(r["event_id"], r["run"]) for r in readers.read_forecast_log(spark, str(runs)).collect()] == [(1, "r1.jsonl")]
    assert [(r["run"], r["settled"], r["outcome"]) for r in readers.read_resolutions(spark, str(runs)).collect()] == [("r1.jsonl", True, 1)]
    history = tmp_path / "prices"
    history.mkdir()
    (history / "tok.json").write_text('[{"t": 20, "p": 0.5}, {"t": "x", "p": 1}, {"t": 10, "p": "0.25"}]')
    assert sorted((r["token_id"], r["p"]) for r in readers.read_price_history(spark, str(history)).collect()) == [("tok", 0.25), ("tok", 0.5)]
    lines = tmp_path / "bundles"
    lines.mkdir()
    (lines / "a.json").write_text("\n".join(['{"token_id": "k", "history": [{"t": 20, "p": 0.5}, {"t": "x", "p": 1}, {"t": 10, "p": "0.25"}]}', "{bad", '{"history": [{"t": 1, "p": 1}]}', '{"token_id": "n", "history": null}']))
    assert sorted((r["token_id"], r["p"]) for r in readers.read_price_history(spark, str(lines), bundled=True).collect()) == [("k", 0.25), ("k", 0.5)]
    events = tmp_path / "events"
    events.mkdir()
    (events / "p1.json").write_text('[{"event_id": 1, "title": "t", "markets": [{"slug": "a"}, {"slug": "b"}]}, {"event_id": 2, "title": "u"}]')
    assert sorted((r["event_id"], r["slug"] or "") for r in readers.read_events_snapshot(spark, str(events)).collect()) == [(1, "a"), (1, "b"), (2, "")]


def test_trader_profiles_never_multiply(spark):
    positions = spark.createDataFrame([(1, "w"), (2, "w"), (3, "x"), (4, None)], "position_id long, address string")
    profiles = spark.createDataFrame([("w", 0.5, 2), ("w", 0.25, 1), (None, 0.9, 0)], "address string, edge double, at int")
    found = retro.attach_trader_profile(positions, profiles, [F.col("at")])
    assert sorted((r["position_id"], r["edge"]) for r in found.collect()) == [(1, 0.25), (2, 0.25), (3, None), (4, None)]
    assert found.filter("edge IS NULL").count() == 2 and retro.attach_trader_profile(positions, profiles.limit(0), [F.col("at")]).count() == 4


def test_gates_of_sinks(spark, tmp_path):
    none = spark.createDataFrame([], "event_id long")
    assert not writers.write_dataset(none, str(tmp_path / "d")) and not (tmp_path / "d").exists()
    unjudged = spark.createDataFrame([(1, None)], "event_id long, judge_score double")
    assert not writers.write_forecast_log(unjudged, none, none, str(tmp_path / "l")) and not (tmp_path / "l").exists()


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "token_id long, event_id long, s long, p double"
    for i, rows in enumerate(([(1, 1, 0, 0.5), (1, 2, 90_000, 0.7)], [(1, 3, 10, 0.9)], [(1, 4, 180_000, 0.1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1).withColumn("t", F.timestamp_seconds("s"))
    got = streams.run_available(streams.stream_price_windows(stream, "1 hour", None, "10 minutes"), str(tmp_path / "out")).collect()
    assert sum(r["n"] for r in got) in (2, 3) and all(r["low"] <= r["mean_p"] <= r["high"] for r in got)
