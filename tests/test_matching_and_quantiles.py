"""Market matching, NO sides, quantiles, places and the training table's counters against plain versions."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastlab.operators import asof, contests, markets, models, quantiles
from forecastlab.operators.decisions import rank_leaderboard

PICKS = "event_id long, predicted string, a_name string, b_name string, title string"
LISTINGS, MARKETS = "listing_id long, title string", "listing_id long, market_no int, label string, status string, ask double"


def outcome(spark, pick, listings, sides):
    rows = markets.match_markets(spark.createDataFrame([(1, *pick)], PICKS), spark.createDataFrame(listings, LISTINGS), spark.createDataFrame(sides, MARKETS)).collect()
    assert len(rows) == 1
    return rows[0]["status"], rows[0]["listing_id"], rows[0]["market_no"]


def test_every_status_of_a_market_match(spark):
    pick = ("Frances Tiafoe", None, None, "Rome: Frances Tiafoe vs. Andrea Pellegrino")
    title = [(7, "Tiafoe vs Pellegrino")]
    sides = [(7, 1, "Frances Tiafoe", "active", 0.6), (7, 2, "Andrea Pellegrino", "active", 0.5)]
    assert outcome(spark, pick, title, sides) == ("matched", 7, 1)
    assert outcome(spark, ("pellegrino", *pick[1:]), title, sides) == ("matched", 7, 2)
    assert outcome(spark, ("A. Pellegrino", "F. Tiafoe", "Andrea Pellegrino", None), title, sides) == ("matched", 7, 2)
    assert outcome(spark, pick, title, [(7, 1, "Frances Tiafoe", "closed", 0.6)])[0] == "market_closed"
    assert outcome(spark, pick, title, [(7, 1, "Frances Tiafoe", "Active", None)])[0] == "market_closed"
    assert outcome(spark, pick, title, [(7, 1, "Frances Tiafoe", None, 0.5)])[0] == "market_closed"
    assert outcome(spark, pick, title, [(7, 1, None, "active", 0.5), (7, 2, "Andrea Pellegrino", "active", 0.5)])[0] == "no_yes_market"
    assert outcome(spark, pick, title, [*sides, (7, 3, "Ann Tiafoe", "active", 0.2)])[0] == "ambiguous_match"
    assert outcome(spark, pick, [*title, (8, "Pellegrino vs Tiafoe")], sides)[0] == "ambiguous_match"
    assert outcome(spark, pick, [(7, "Tiafoe vs Pellegrino: Exact Score"), (8, None), (9, "Tiafoes vs Pellegrino")], sides)[0] == "no_match"
    for bad in (("Solo Player", None, None, None), ("Nobody", *pick[1:]), (None, *pick[1:]), ("", "", "", "")):
        assert outcome(spark, bad, title, sides) == ("unparseable_players", None, None)


def test_the_view_of_picks_has_every_status(spark):
    from forecastlab.plans import registry

    found = registry.QUERIES["j9_match_markets"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r["status"] for r in found} == {"matched", "no_match", "ambiguous_match", "no_yes_market", "market_closed", "unparseable_players"}


def test_common_surnames_join_only_their_own_pairs(spark):
    picks = [(i, f"Bo Li{i}", "Ann Smith", f"Bo Li{i}", None) for i in range(300)]
    listings = [(i, f"Smith vs Li{i}") for i in range(300)]
    sides = [(i, 2, f"Bo Li{i}", "active", 0.5) for i in range(300)]
    rows = markets.match_markets(spark.createDataFrame(picks, PICKS), spark.createDataFrame(listings, LISTINGS), spark.createDataFrame(sides, MARKETS)).collect()
    assert {(r["event_id"], r["status"], r["listing_id"]) for r in rows} == {(i, "matched", i) for i in range(300)} and len(rows) == 300


def test_no_side_twice_is_the_market(spark):
    level = "array<struct<price: double, size: double>>"
    schema = f"id int, bid double, ask double, bid_size double, ask_size double, bid_depth int, ask_depth int, bid_dollars double, ask_dollars double, bids {level}, asks {level}, change_1h double, history array<struct<t: int, p: double>>, high double, low double, open double, close double, last_price double"
    rows = [
        (1, 0.25, 0.5, 10.0, 20.0, 2, 1, 2.5, 10.0, [(0.25, 10.0), (0.125, 5.0)], [(0.5, 20.0), (0.75, 1.0)], 0.125, [(1, 0.25), (2, 0.5)], 0.75, 0.125, 0.5, 0.25, 0.375),
        (2, None, 0.5, None, 20.0, None, 1, None, 10.0, [], [(0.5, 20.0)], None, None, None, None, None, None, None),
        (3, None, None, None, None, None, None, None, None, None, None, None, [], 0.5, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    once = {r["id"]: r for r in markets.no_side(df, session="mirror").collect()}
    assert [tuple(q) for q in once[1]["bids"]] == [(0.5, 20.0), (0.25, 1.0)] and [tuple(q) for q in once[1]["asks"]] == [(0.75, 10.0), (0.875, 5.0)]
    assert (once[1]["high"], once[1]["low"]) == (0.875, 0.25)
    twice = markets.no_side(markets.no_side(df, session="mirror"), session="mirror").orderBy("id").collect()
    assert twice == df.orderBy("id").collect()
    assert all(r[c] is None for r in markets.no_side(df).collect() for c in ("high", "low", "open", "close", "last_price"))


def test_enrichment_turns_round_for_no_rows(spark):
    sides = spark.createDataFrame([("s", "yes"), ("s", "no"), ("t", "no"), (None, "yes")], "slug string, side string")
    facts = spark.createDataFrame([("s", 1.0, 2.0, 0.5)], "slug string, bid_size double, ask_size double, change_1h double")
    got = {(r["slug"], r["side"]): (r["bid_size"], r["ask_size"], r["change_1h"]) for r in markets.attach_enrichment(sides, facts).collect()}
    assert got == {("s", "yes"): (1.0, 2.0, 0.5), ("s", "no"): (2.0, 1.0, -0.5), ("t", "no"): (None, None, None), (None, "yes"): (None, None, None)}


@pytest.mark.parametrize("kind", ["spread", "one value", "ties", "few"])
def test_quantiles_equal_percentile(spark, kind):
    rng = random.Random(kind)
    draw = {"spread": lambda: rng.gauss(0, 5), "one value": lambda: 3.0, "ties": lambda: float(rng.choice([1, 2, 2, 2, 7])), "few": lambda: rng.random()}[kind]
    rows = [(rng.choice("abc"), draw() if rng.random() > 0.1 else None) for _ in range(7 if kind == "few" else 4000)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    want = {r["g"]: (r["n"], r["q"]) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect() if r["n"]}
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, "x", shares, ["g"]).collect()}
    assert set(got) == set(want) and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1]) for g in want)
    whole = quantiles.exact_quantiles(df, "x", [0.5]).first()
    assert whole["q"][0] == pytest.approx(statistics.median(x for _, x in rows if x is not None))
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_range_check_of_equal_forecasts_takes_the_middle_bin(spark):
    from forecastlab.operators.scoring import range_calibration_check

    df = spark.createDataFrame([(0.4, 0.5, i % 2) for i in range(40)], "p double, m double, won int")
    assert [(r["bin"], r["n"]) for r in range_calibration_check(df, 0.3, 0.65).collect()] == [(2, 40)]


def test_places_equal_row_numbers(spark):
    rng = random.Random(1)
    score = lambda: rng.choice([None, 0.5, rng.random(), rng.random()])
    rows = [(i % 5 if i % 3 else 0, i, i % 7, i % 4, rng.choice(["Lock", "Lean", "Avoid", None]), rng.choice(["Prime", "Thin", None]), score()) for i in range(3000)]
    df = spark.createDataFrame(rows, "run_id int, event_id int, partkey int, suppkey int, risk_bucket string, ev_bucket string, score double")
    got = {r["event_id"]: r["place"] for r in rank_leaderboard(df, "run_id").collect()}
    grade = lambda x, names: names.index(x) if x in names else 9
    order = sorted(rows, key=lambda r: (grade(r[4], ["Lock", "Lean", "Coin-flip", "Avoid"]), grade(r[5], ["Prime", "Edge", "Thin", "Negative"]), r[6] is None, -(r[6] or 0), r[1:4]))
    seen, want = Counter(), {}
    for r in order:
        seen[r[0]] += 1
        want[r[1]] = seen[r[0]]
    assert got == want


def test_best_before(spark):
    points = spark.createDataFrame([("a", 1, 50), ("a", 3, 10), ("a", 5, 70), ("b", 2, 4)], "k string, t int, rank int")
    asked = spark.createDataFrame([("a", t) for t in range(7)] + [("c", 3)], "k string, at int")
    got = {(r["k"], r["at"]): (r["rank"], r["best"]) for r in asof.best_before(points, asked, ["k"], "t", "at", "rank", "best").collect()}
    assert [got["a", t] for t in range(7)] == [(None, None), (50, 50), (50, 50), (10, 10), (10, 10), (70, 10), (70, 10)] and got["c", 3] == (None, None)


def test_records_by_surface_and_format(spark):
    rng = random.Random(6)
    rows = [("atp", i, 1, 2, rng.choice(["hard", "clay", None]), rng.randint(0, 1), rng.choice([3, 5])) for i in range(60)]
    cols = "tour string, match_id int, player int, opponent int, surface string, won int, best_of int, match_date date"
    from datetime import date

    df = spark.createDataFrame([(*r, date(2020, 1, 1 + r[1] % 28)) for r in rows], cols)
    got = contests.h2h_summary(df).first()
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        if r[4]:
            want[r[4]][1 - r[5]] += 1
    assert {k: [v["w"], v["l"]] for k, v in got["surfaces"].items()} == dict(want) and got["meetings"] == 60
    extra = df.withColumns({c: F.lit(None).cast("long") for c in ("decider_won", "decider", "tb_won", "tb_played", "lost_set1", "comeback", "s_fs_won", "s_fs_in", "s_bp_conv", "s_bp_of")})
    stats = contests.matchup_stats(extra).first()
    for k in (3, 5):
        assert tuple(stats[f"best_of_{k}"]) == (sum(r[5] for r in rows if r[6] == k), sum(r[6] == k for r in rows))
    assert stats["decider"] is None and stats["comeback"] is None


def test_trees_take_categories_and_unseen_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), "abc"[k], int(rng.random() < (0.9 if k == 1 else 0.1))) for x, k in zip(rng.random(400), rng.integers(0, 3, 400))]
    train = spark.createDataFrame(rows, "x double, kind string, won int")
    model = models.train_outcome_model(train, None, ["x"], ["kind"], trees=3, depth=2)
    asked = spark.createDataFrame([(0.5, "b", 1), (0.5, "a", 0), (0.5, "unseen", 0), (None, None, 0)], "x double, kind string, won int")
    got = models.predict(model, asked, ["x"]).collect()
    assert len(got) == 4 and got[0]["q"] > 0.6 > 0.4 > got[1]["q"] and all(0 <= r["q"] <= 1 for r in got)
