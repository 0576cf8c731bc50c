"""Sinks: datasets, forecast logs, append-only trades and scorecards, by Spark's own committers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str) -> bool:
    """Replaces a Parquet dataset, only by a non-empty one; whether it did."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_forecast_log(predictions: DataFrame, errors: DataFrame, meta: DataFrame, path: str) -> bool:
    """A run as JSON lines of three record types. A run with forecasts of which none has a judge's score is not written."""
    n, judged = predictions.agg(F.count("*"), F.count("judge_score")).first()
    if n and not judged:
        return False
    typed = [df.withColumn("record_type", F.lit(k)) for k, df in (("prediction", predictions), ("error", errors), ("meta", meta))]
    typed[0].unionByName(typed[1], allowMissingColumns=True).unionByName(typed[2], allowMissingColumns=True).write.mode("append").json(path)
    return True


def append_trades(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_scorecard(result: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    result.coalesce(1).write.mode("overwrite").json(path)
