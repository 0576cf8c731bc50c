"""What the findings of round 4 found: fits that leave little on disk, and a grid of whole models."""

import inspect
import time
from math import prod
from pathlib import Path

from pyspark.sql import functions as F

from forecastlab.operators import features, models
from forecastlab.plans import features as plan
from forecastlab.plans import models as fits
from forecastlab.plans.base import Tables, shared
from forecastlab.session import remove, spent_shuffles


def shuffled(spark) -> set[str]:
    return {str(p) for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}


def gone(spark, before: set[str]) -> bool:
    """Whether all newer shuffle files go; block managers remove them a moment after they are told to."""
    for _ in range(300):
        if shuffled(spark) <= before:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled(spark)
    old = spark.conf.get(key, None)
    with spent_shuffles(spark):
        spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "a"))
        assert gone(spark, before) and spark.read.parquet(str(tmp_path / "a")).count() == 7
    assert spark.conf.get(key, None) == old


def test_removes_only_what_it_is_told(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).write.parquet(str(tmp_path / name))
    remove(spark, str(tmp_path / "a"))
    assert not (tmp_path / "a").exists() and spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_tours_in_turns_hold_each_tour_once(spark):
    some = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [(None,)] * 2 + [("c",)], "tour string")
    assert plan.tours_in_turns(some, 100) == [["a", "b", None, "c"]]
    assert plan.tours_in_turns(some, 4) == [["a"], ["b"], [None, "c"]] and plan.tours_in_turns(some.limit(0), 4) == []


def test_training_rows_in_turns_are_those_of_one_query(spark, sf, tmp_path):
    t = Tables(spark, sf)
    matches = t("matches").withColumn("tour", F.when(F.col("match_id") % 23 > 0, F.col("tour")))
    columns = ["match_id", "side", "anchor", "won", *features.NUMERIC, *features.CATEGORICAL]
    one = plan.training(t, matches, 3).select(*columns).persist()
    for at_once in (1, 3_000_000):
        plan.write_training(t, matches, 3, str(tmp_path / f"{at_once}"), columns, at_once)
        got = spark.read.parquet(str(tmp_path / f"{at_once}"))
        assert got.count() == one.count() > 0 and got.exceptAll(one).isEmpty()
    one.unpersist()
    plan.write_training(t, matches.limit(0), 3, str(tmp_path / "none"), columns)
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_a_fit_finds_nothing_but_its_table_on_disk(spark, sf):
    t = Tables(spark, sf)
    folder = Path(shared(t)).parent
    before, files = set(folder.iterdir()), shuffled(spark)
    fits.table(t)
    (left,) = set(folder.iterdir()) - before
    assert all(p.name.startswith(("part-", ".part-", "_SUCCESS", "._SUCCESS")) for p in left.iterdir()) and gone(spark, files)


def test_pairs_travel_without_what_they_can_compute(spark, sf):
    matches, most = Tables(spark, sf)("matches").limit(9), "spark.sql.debug.maxToStringFields"
    spark.conf.set(most, 1000)
    t = Tables(spark, sf)
    known = matches.select("match_id", "match_date", "tour", "p1", "p2", *[F.lit(1500.0).alias(f"p{n}_{r}") for n in (1, 2) for r in ("elo", "surface_elo")])
    text = features.training_table(matches, t("rankings"), t("profiles"), known)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset(most)
    below = text[text.index("RepartitionByExpression [match_id"):]
    assert " AS surface_winrate#" in below and not any(f" AS {name}#" in below for name in features.DERIVED)


def test_fits_of_a_large_table_run_one_by_one(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [models.fits_at_once(spark.range(10_000, numPartitions=n)) for n in (1, cores, 2 * cores, 4 * cores, 40 * cores)] == [8, 4, 2, 1, 1]


def test_flags_that_all_rows_share_take_no_part_in_fits(spark, tmp_path):
    some = [(i, side, i, (i + side) % 2, float(i % 9) * (3 - 2 * side), None if i % 4 == 0 else float(i % 5), "ab"[i % 2]) for i in range(120) for side in (1, 2)]
    rows = spark.createDataFrame(some, "match_id long, side int, anchor long, won int, x double, y double, k string")
    ready = models.prepare({"train": rows, "holdout": rows}, str(tmp_path), ["x", "y"], ["k"])
    assert ready.flagged == ["y"] and ready.splits() == [0, 1, 3, 4] and ready.splits(["x", "k"]) == [0, 4] and ready.places(["x", "k"]) == [0, 2, 4]
    short, whole = (models.fit_trees(ready.parts["train"], at, trees=4, depth=3) for at in (ready.splits(), None))
    q = [[r["q"] for r in models.forecasts(m, ready.parts["holdout"]).orderBy("match_id", "side").collect()] for m in (short, whole)]
    assert q[0] == q[1] and len(set(q[0])) > 2


def test_grid_fits_whole_models(monkeypatch):
    asked = {}
    monkeypatch.setattr(fits, "prepared", lambda t: "rows")
    monkeypatch.setattr(models, "grid_search", lambda table, part, grid, **how: asked.update(points=prod(map(len, grid.values())), **how))
    fits._grid(None)
    trees = inspect.signature(models.fit_trees).parameters["trees"].default
    assert asked.get("trees", trees) >= trees == 20 and asked["points"] == 81
