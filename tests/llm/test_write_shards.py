"""What is written in shards is what was given: each row once, with its columns, within the limit."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from forecastlab.llm import sharding


@pytest.mark.parametrize("limit", [60, 100_000])
def test_each_row_is_written_once(spark, tmp_path, limit):
    rows = [(1, "one text", "x"), (1, "another text of the id", "y"), (1, "one text", "z"), (None, None, "n"), (None, "", "m"), (2, "", None), *[(3, "copies of one row", str(i)) for i in range(200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("kept", F.col("shard"))
    path = str(tmp_path / f"shards-{limit}")
    sharding.write_shards(docs, path, limit)
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    assert Counter((r["doc_id"], r["text"], r["kept"]) for r in back.collect()) == Counter(rows)
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] is None or r["b"] <= limit or r["n"] == 1 for r in sizes)


def test_an_empty_table_writes_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    sharding.write_shards(empty, str(tmp_path / "none"), 100)
    assert spark.read.schema("doc_id long, text string").parquet(str(tmp_path / "none")).count() == 0
