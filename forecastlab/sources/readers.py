"""Sources: typed reads of landed files, and flattening of nested rows. Rows that cannot be read are left out, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORECAST = "record_type string, event_id long, market_slug string, predicted_winner string, predicted_yes_probability double, confidence string, sport string, _bad string"
RESOLUTION = "slug string, settled boolean, outcome int, _bad string"
REQUIRED = ["event_id", "market_slug", "predicted_winner", "predicted_yes_probability", "confidence"]


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, sort: str | None = None) -> DataFrame:
    """A Parquet table; columns and filters after it reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.orderBy(sort) if sort else df


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def read_forecast_log(spark: SparkSession, path: str, record_type: str = "prediction", schema: str = FORECAST) -> DataFrame:
    """Rows of one type of a folder of JSON-lines runs, with run (the file) and run_time; resolution files and bad rows are left out."""
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    named = raw.select("*", F.col("_metadata.file_name").alias("run"), F.col("_metadata.file_modification_time").alias("run_time"))
    kept = named.filter(~F.col("run").endswith(".resolutions.jsonl") & F.col("_bad").isNull() & (F.coalesce("record_type", F.lit("prediction")) == record_type))
    return kept.dropna(subset=[c for c in REQUIRED if c in kept.columns] if record_type == "prediction" else None, how="any" if record_type == "prediction" else "all").drop("_bad")


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each run and slug of the resolution files of a folder and those inside it."""
    raw = spark.read.schema(RESOLUTION).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.resolutions.jsonl").option("recursiveFileLookup", True).json(path)
    lines = raw.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.resolutions\.jsonl$", ".jsonl").alias("run"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    good = lines.filter("_bad IS NULL AND slug IS NOT NULL")
    return good.groupBy("run", "slug").agg(F.max_by(F.struct("settled", "outcome"), F.struct("_block", "_line")).alias("r")).select("run", "slug", "r.*")


def explode_history(df: DataFrame) -> DataFrame:
    """token_id, t, p of rows with an array of (t, p) texts; points whose t or p is no number are dropped."""
    return df.select("token_id", F.inline("history")).select("token_id", F.col("t").cast("string").try_cast("double").alias("s"), F.col("p").cast("string").try_cast("double").alias("p")).filter("s IS NOT NULL AND p IS NOT NULL").select("token_id", F.timestamp_seconds("s").alias("t"), "p")


def read_price_history(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """A folder of one JSON array [{t, p}] a token, whose file name is the token; bundled: of JSON lines {token_id, history},
    which many tokens need, as a file for each is small. Lines that cannot be read are left out."""
    if bundled:
        lines = spark.read.schema("token_id string, history array<struct<t: string, p: string>>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
        return explode_history(lines.filter("_bad IS NULL AND token_id IS NOT NULL"))
    raw = spark.read.schema("t string, p string").json(path, multiLine=True)
    named = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("token_id"), F.array(F.struct("t", "p")).alias("history"))
    return explode_history(named)


def explode_markets(events: DataFrame) -> DataFrame:
    """Events with an array of markets as a row a market; an event without markets stays, with nulls."""
    return events.select("event_id", "title", F.explode_outer("markets").alias("m")).select("event_id", "title", "m.*")


def read_events_snapshot(spark: SparkSession, path: str, market: str = "slug string, outcomes string, prices string, closed boolean") -> DataFrame:
    return explode_markets(spark.read.schema(f"event_id long, title string, markets array<struct<{market.replace(' ', ':').replace(',:', ', ')}>>").option("multiLine", True).json(path))


def flatten_match(raw: DataFrame) -> DataFrame:
    """Flat contests of nested vendor rows (id, date, tour, player1, player2, winner_id, score); incomplete ones are dropped."""
    side = F.when(F.col("winner_id") == F.col("player1.id"), 1).when(F.col("winner_id") == F.col("player2.id"), 2)
    flat = raw.select(F.col("id").alias("match_id"), "tour", F.to_date(F.substring("date", 1, 10)).alias("match_date"), F.col("player1.id").alias("p1"), F.col("player2.id").alias("p2"), side.alias("winner_side"), F.nullif(F.trim("score"), F.lit("")).alias("score"))
    return flat.dropna(subset=["match_id", "p1", "p2", "match_date", "winner_side"])


def flatten_rankings(raw: DataFrame) -> DataFrame:
    """Flat snapshots of nested vendor rows (date, tour, player, position, point); incomplete ones are dropped."""
    return raw.select("tour", F.to_date(F.substring("date", 1, 10)).alias("ranking_date"), F.col("player.id").alias("player_id"), F.col("position").alias("rank"), F.col("point").alias("rank_points")).dropna(subset=["ranking_date", "player_id", "rank"])
