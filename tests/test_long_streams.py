"""Streams with nearly all rows in one key: the same answers, and no range holds the key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from forecastlab.operators import asof, long_streams


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.99 else rng.choice([2, 3, None]), datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 3000)), i, rng.choice([None, rng.random()])) for i in range(6000)]
    return spark.createDataFrame(rows, "token_id int, t timestamp, event_id int, p double"), rows


def by_key(rows):
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


def test_numbers_and_previous_values(points):
    df, rows = points
    numbers = {r["event_id"]: (r["_i"], r["_n"]) for r in long_streams.numbered(df, ["token_id"], "t", ["event_id"]).collect()}
    before = {r["event_id"]: r["b"] for r in long_streams.with_previous(df, ["token_id"], "t", ["event_id"], "p", "b").collect()}
    assert len(numbers) == len(before) == len(rows)
    for stream in by_key(rows).values():
        for i, r in enumerate(stream):
            assert numbers[r[2]] == (i, len(stream)) and before[r[2]] == (stream[i - 1][3] if i else None)


def test_no_range_holds_the_hot_key(points):
    df, rows = points
    most = long_streams.in_ranges(df, long_streams.micros("t")).groupBy("token_id", "_r").count().agg(F.max("count")).first()[0]
    assert most < len(rows) / 20


@pytest.mark.parametrize("through", [True, False])
def test_last_before_equals_the_whole_stream(points, through):
    df, _ = points
    once = df.dropDuplicates(["token_id", "t"]).select("token_id", "t", F.col("event_id").alias("v"))
    asked = df.select("token_id", F.col("t").alias("at"), "event_id")
    ways = [f(once, asked, ["token_id"], "t", "at", ["v"], through) for f in (asof.last_before, long_streams.last_before)]
    a, b = [{r["event_id"]: r["v"] for r in w.collect()} for w in ways]
    assert a == b and len(a) == 6000
    assert long_streams.last_before(once.limit(0), asked, ["token_id"], "t", "at", ["v"]).filter("v IS NOT NULL").count() == 0
