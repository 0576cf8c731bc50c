"""Streaming forms of batch operators: deduplication, price windows, activity counts, latest prices.

Late rows beyond the watermark are dropped, and state is bounded by it, but for latest prices, whose state is a row a token.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_dedup(trades: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return trades.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stream_price_windows(prices: DataFrame, width: str, slide: str | None, delay: str) -> DataFrame:
    """Number, mean, lowest and highest price of each token and window, once the watermark passes its end."""
    window = F.window("t", width, slide) if slide else F.window("t", width)
    return prices.withWatermark("t", delay).groupBy("token_id", window.alias("w")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.min("p").alias("low"), F.max("p").alias("high")).select("token_id", F.col("w.start").alias("start"), "n", "mean_p", "low", "high")


def stream_activity_count(events: DataFrame, key: str, width: str, slide: str, delay: str) -> DataFrame:
    return events.withWatermark("t", delay).groupBy(key, F.window("t", width, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def stream_latest(prices: DataFrame) -> DataFrame:
    """The newest price of each token so far; for complete or update mode."""
    return prices.groupBy("token_id").agg(F.max("t").alias("t"), F.max_by("p", F.struct("t", "event_id")).alias("p"))


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, and reads what it wrote. In complete mode each batch replaces the one before."""
    spark, at = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{at}/out")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))
    writer.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
