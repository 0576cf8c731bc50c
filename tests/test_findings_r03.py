"""What the findings of round 3 found: whole jobs, exact rounding, expressions that are computed once."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from forecastlab.functions import decision as D
from forecastlab.functions.text import fixed
from forecastlab.operators import markets, prices, selection


def test_listing_filter_sees_the_markets_of_all_events(spark, sf):
    got = {r["event_id"] % 9 for r in __spark_entry__.queries()["p11_listing_filter"](spark, sf).collect()}
    assert got == set(range(9))


def test_insider_counts_has_every_event_with_trades(spark, sf):
    q = __spark_entry__.queries()["a34_insider_counts"](spark, sf)
    assert q.count() == spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 8 + l_linenumber AS e").distinct().count()


def test_fixed_rounds_the_exact_binary_value(spark):
    rng = random.Random(3)
    some = [0.0005, 0.2 / 400, 0.0625, 0.1875, 0.9995, 0.99949, 1.0, 0.0, -0.25, 12.3456, 1234.0005, 7 / 3]
    some += [(2 * k + 1) / 2000 for k in range(1000)] + [k / 16 for k in range(16)] + [rng.random() for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", fixed(F.col("x"), 3).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in got if r["s"] != f"{r['x']:.3f}"] == []
    assert spark.createDataFrame([(None,)], "x double").select(fixed(F.col("x"), 3)).first()[0] is None


def written(df, name):
    """How often a function is written out in the plan that runs."""
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(f"{name}(")


def test_risk_terms_are_computed_once(spark, sf):
    rows = spark.createDataFrame(
        [(p, d, g, h, a) for p in (0.0, 0.4, 1.0, None) for d in (0.1, 1.2, None) for g in (-0.1, 0.3, None) for h in (0.05, None) for a in (True, False)],
        "p double, defens double, gap_market double, gap_model double, is_a boolean",
    )
    plain = D.risk_score(F.col("p"), F.col("defens"), F.col("gap_market"), F.col("is_a"), 1.6, F.col("gap_model"))
    for r in D.with_risk(rows, 1.6).withColumns({"s": plain, "b": D.risk_bucket(plain)}).collect():
        assert (r["score"], r["risk_bucket"]) == (r["s"], r["b"])
    for q in ("f12_classify_risk", "f13_bucket_rank", "w24_rank_leaderboard"):
        assert written(__spark_entry__.queries()[q](spark, sf), "exp") <= 4, q


def test_places_of_buckets(spark):
    got = spark.createDataFrame([("Lock",), ("Unrated",), ("none",), (None,)], "b string").select(D.bucket_rank(F.col("b"), D.RISK_BUCKETS).alias("k")).collect()
    assert [r["k"] for r in got] == [0, 4, 5, 5]


def test_records_are_matched_once(spark):
    df = spark.createDataFrame([("1", "3-1"), ("1", "1-1-2"), ("1", "0-0"), ("2", "5-0"), ("2", None), ("3", "x")], "event_id string, record string")
    spread = markets.record_spread(df)
    assert written(spread, "regexp_extract") <= 3
    assert {r["event_id"]: r["spread"] for r in spread.collect()} == {"1": 0.25, "2": None, "3": None}


def test_slates_are_cut_before_the_shuffle(spark):
    rows = [(i, "a" if i < 7 else "b" if i < 10 else "c", float(i % 4)) for i in range(14)]
    top = selection.top_k_per_slate(spark.createDataFrame(rows, "id int, day string, score double"), 3, slate=("day",))
    want = {d: [r[0] for r in sorted((r for r in rows if r[1] == d), key=lambda r: (-r[2], r[0]))[:3]] for d in "ac"}  # b has no more than three
    assert sorted((r["day"], r["id"]) for r in top.collect()) == sorted((d, i) for d, ids in want.items() for i in ids)
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


def test_books_are_dealt_to_tasks_of_bounded_size(spark):
    rng = random.Random(17)
    rows = [(rng.randrange(400) if i % 2 else 7, rng.choice(["bid", "ask"]), rng.randrange(50) / 8, float(rng.randrange(1, 9))) for i in range(4000)] + [(900, "bid", 0.5, 2.0), (None, "ask", 0.25, 1.0)]
    levels = spark.createDataFrame(rows, "market_id long, side string, price double, size double").coalesce(1)
    small, whole = prices.book_summary(levels, per_task=100), prices.book_summary(levels)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.rindex("RepartitionByExpression") > plan.rindex("Aggregate")  # dealt out before anything is summed
    assert small.rdd.getNumPartitions() == -(-len(rows) // 100)
    want = {}
    for k in {r[0] for r in rows}:
        out = []
        for side, best in (("bid", max), ("ask", min)):
            here = [(p, s) for m, x, p, s in rows if m == k and x == side]
            top = best((p for p, _ in here), default=None)
            out += [top, sum(s for p, s in here if p == top) if here else None, sum(p * s for p, s in here) if here else None, len(here)]
        want[k] = tuple(out)
    for got in (small, whole):
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
