"""Every registered query runs, and equals its oracle where it has one."""

import duckdb
import pytest

import __spark_entry__
from forecastlab.plans import registry
from forecastlab.plans.base import TABLES

SLOW = {"m4_outcome_model", "m5_predict_symmetric", "m6_bag", "m7_ablate", "m7_grid_search", "m8_learning_curve", "m10_feature_importance"}


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(names, data):
    order = [names.index(c) for c in sorted(names)]
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, sf, oracle, name):
    df = registry.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in registry.ORACLE_SQL:
        want = oracle.sql(registry.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_not_need_the_corpus_subpackage():
    from pathlib import Path

    top = Path(__spark_entry__.__file__).parent / "forecastlab"
    assert all("llm" not in p.read_text() for p in top.rglob("*.py") if "llm" not in p.parts)
