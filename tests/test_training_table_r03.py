"""The training table at size: few sorts and shuffles of whole rows, ratings met by contest, frames that hold the last known values."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from forecastlab.operators import elo, features
from forecastlab.plans.base import Tables
from forecastlab.plans.features import training


def test_the_training_table_sorts_and_shuffles_rows_few_times(spark, sf):
    t = Tables(spark, sf)
    run = training(t, t("matches"), 3)._jdf.queryExecution()
    assert run.sparkPlan().toString().count("Window [") <= 10 and run.executedPlan().toString().count(" Sort [") <= 8  # 15 and 14 before


def test_contests_without_a_date_rate_nobody(spark, tmp_path):
    day = date(2020, 1, 1)
    some = [(1, "atp", day, 1, 2, 1, "hard"), (2, "atp", None, 1, 2, 1, "hard"), (3, "atp", date(2020, 7, 2), 1, 2, 2, None)]
    contests = spark.createDataFrame(some, "match_id long, tour string, match_date date, p1 long, p2 long, winner_side int, surface string").withColumn("period", elo.half_year(F.col("match_date")))
    got = {r["match_id"]: (r["p1_elo"], r["p2_elo"], r["p1_surface_elo"]) for r in elo.rated_contests(contests, str(tmp_path / "rated")).collect()}
    assert got[1] == got[2] == (1500.0, 1500.0, 1500.0) and got[3] == (1512.0, 1488.0, 1512.0)
    only = elo.rated_contests(contests.filter("match_id = 2"), str(tmp_path / "undated")).collect()
    assert [(r["match_id"], r["p1_elo"]) for r in only] == [(2, 1500.0)]
    assert elo.rated_contests(contests.limit(0), str(tmp_path / "none")).count() == 0


def test_last_known_values_match_a_fold(spark):
    rng = random.Random(8)
    rows = [(i, "atp" if i % 3 else "wta", rng.randint(1, 3), (date(2020, 1, 1) + timedelta(days=rng.randint(0, 60))), rng.choice([None, rng.randint(1, 90)]), rng.choice([None, -1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "match_id long, tour string, player long, match_date date, v int, u int").withColumn("day", F.datediff("match_date", F.lit("2019-01-01")))
    got = {r["match_id"]: r for r in features.recent_known(df, {"v": "a", "u": "b"}).collect()}
    past = {}
    for i, tour, player, _, v, u in sorted(rows, key=lambda r: (r[3], r[0])):
        for k, x, name in (("v", v, "a"), ("u", u, "b")):
            known = past.setdefault((tour, player, k), [])
            assert got[i][name] == (pytest.approx(sum(known[-10:]) / len(known[-10:])) if known else None)
            if x is not None:
                known.append(x)
