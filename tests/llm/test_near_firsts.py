"""A group of near texts makes a row for each text and cell, and the same nearest and leading ones as all of its candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecastlab.llm import near_copies


@pytest.mark.parametrize("crowd", [4096, 40])
def test_firsts_are_those_of_all_candidates(spark, crowd):
    rng = np.random.default_rng(5)
    base, n = rng.integers(0, 2**63, 2, dtype=np.uint64), 120
    fps = [base ^ np.array([1 << int(b), 1 << int(d)], dtype=np.uint64) for b, d in rng.integers(0, 63, (n, 2))]
    rows = [(i, int(f[0].view(np.int64)), int(f[1].view(np.int64)), 100, i, True) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, low long, high long, size int, label long, asks boolean")
    found, some = near_copies.candidates(nodes, 1, crowd), near_copies.firsts(nodes, crowd)
    want = found.groupBy("guest").agg(
        F.min_by("home", F.struct("apart", "home")), F.min_by("home", F.struct("lead", "home")), F.min("home"), F.max("home"), F.max("besides")
    )
    got = some.groupBy("guest").agg(F.min_by("nearest", F.struct("apart", "nearest")), F.min_by("leader", F.struct("lead", "leader")), F.min("low"), F.max("high"), F.max("besides"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    if crowd == 4096:  # one cell
        assert some.count() == n < found.count() / 2
    assert near_copies.firsts(nodes.filter("node = 0"), crowd).count() == 0
