"""Queries of model fitting (M), streams (ST), and sources and sinks (SRC, SNK) by way of files that they write and read."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecastlab.operators import features as W
from forecastlab.operators import models as M
from forecastlab.session import spent_shuffles
from forecastlab.sources import readers, writers
from forecastlab.streaming import streams as ST

from .base import query, shared
from .features import write_training
from .scoring import scored

c = F.col


FEATURES, CATEGORIES = W.NUMERIC, W.CATEGORICAL


def table(t):
    """The training table, written once for the fits that read it many times: contests until June 1999, of the next half-year, and later."""
    path = shared(t)
    write_training(t, t("matches"), 3, path, ["match_id", "side", "anchor", "won", *FEATURES, *CATEGORIES, c("match_date").alias("day")])
    rows = t.spark.read.parquet(path)
    return rows.filter("day <= DATE '1999-06-30'"), rows.filter("day > DATE '1999-06-30' AND day <= DATE '1999-12-31'"), rows.filter("day > DATE '1999-12-31'")


query("m1_fit_temperature")(lambda t: t.spark.createDataFrame([(M.fit_temperature(scored(t).select("p", "y")),)], "temperature double"))
query("m2_fit_blend_weight")(lambda t: t.spark.createDataFrame([(M.fit_blend_weight(scored(t), "p", "sim_p"),)], "weight double"))
query("m3_isotonic")(lambda t: M.apply_isotonic(M.fit_isotonic(scored(t)), scored(t).select("event_id", "p")).select("event_id", "p", "q"))


@query("m4_outcome_model")
def _outcome(t):
    train, valid, holdout = table(t)
    model = M.train_outcome_model(train, valid, FEATURES, CATEGORIES, trees=10, depth=4)
    return M.predict(model, holdout, FEATURES).select("match_id", "anchor", "q")


@query("m5_predict_symmetric")
def _symmetric(t):
    train, _, holdout = table(t)
    return M.predict_symmetric(M.predict(M.train_linear_model(train, FEATURES), holdout, FEATURES))


def prepared(t):
    """The training rows and the later ones, of all features, as vectors that all fits of a query read."""
    train, _, holdout = table(t)
    with spent_shuffles(t.spark):
        return M.prepare({"train": train, "holdout": holdout}, shared(t), FEATURES, CATEGORIES)


@query("m6_bag")
def _bag(t):
    return M.bag(prepared(t), "holdout", [42, 43, 44, 45, 46], trees=5, depth=4).select("match_id", "anchor", "q")


ALL = [*FEATURES, *CATEGORIES]
ABLATIONS = {
    "all": ALL, "no categories": FEATURES, "no rank": [f for f in ALL if "rank" not in f], "no elo": [f for f in ALL if "elo" not in f], "no h2h": [f for f in ALL if "h2h" not in f],
    "form": ["last_5_diff", "last_10_diff", "last_25_diff"],
}


@query("m7_ablate")
def _ablate(t):
    return M.ablate(prepared(t), "holdout", ABLATIONS, trees=5, depth=3)


#: Three values of each of four settings: 81 points.
GRID = {"depth": [2, 3, 4], "rate": [0.03, 0.1, 0.3], "least": [1, 10, 50], "subsample": [0.6, 0.8, 1.0]}


@query("m7_grid_search")
def _grid(t):
    return M.grid_search(prepared(t), "holdout", GRID)


@query("m8_learning_curve")
def _curve(t):
    return M.learning_curve(prepared(t), "holdout", [0.1, 0.25, 0.5, 0.75, 1.0], trees=5, depth=3)


@query("m10_feature_importance")
def _importance(t):
    train, valid, _ = table(t)
    return M.feature_importance(M.train_outcome_model(train, valid, FEATURES, CATEGORIES, trees=5, depth=3), [*FEATURES], t.spark, CATEGORIES)


# Streams over the prices, landed as files.
def landed(t, view: str):
    path = shared(t)
    df = t(view)
    df = df.withColumns({k: c(k).cast("timestamp") for k, kind in df.dtypes if kind == "timestamp_ntz"})
    df.repartition(4).write.parquet(path)
    return ST.read_stream(t.spark, path, df.schema)


query("st1_stream_dedup", "SELECT DISTINCT run_id, event_no FROM trades")(lambda t: ST.run_available(ST.stream_dedup(landed(t, "trades"), ["run_id", "event_no"], "ts", "60 days").select("run_id", "event_no"), shared(t)))
query(
    "st2_stream_price_windows",
    "SELECT token_id, time_bucket(INTERVAL 4 HOURS, t) AS start, count(*) AS n, avg(p) AS mean_p, min(p) AS low, max(p) AS high FROM prices GROUP BY 1, 2", "mean_p low high",
)(lambda t: ST.run_available(ST.stream_price_windows(landed(t, "prices"), "4 hours", None, "60 days"), shared(t), "complete").withColumn("start", c("start").cast("timestamp_ntz")))
query("st3_stream_activity_count", "SELECT token_id, time_bucket(INTERVAL 1 DAY, t) - INTERVAL (k) DAY AS start, count(*) AS n FROM prices, range(14) r(k) GROUP BY 1, 2")(
    lambda t: ST.run_available(ST.stream_activity_count(landed(t, "prices"), "token_id", "14 days", "1 day", "60 days"), shared(t), "complete").withColumn("start", c("start").cast("timestamp_ntz"))
)
query("st4_stream_latest", "SELECT token_id, max(t) AS t, arg_max(p, (t, event_id)) AS p FROM prices GROUP BY 1", "p")(lambda t: ST.run_available(ST.stream_latest(landed(t, "prices")), shared(t), "complete").withColumn("t", c("t").cast("timestamp_ntz")))


# Sources and sinks: what is written from the tables is read again.
def through(t, df, read, write=lambda df, path: df.write.parquet(path)):
    path = shared(t)
    write(df, path)
    return read(t.spark, path)


query("src1_read_matches", "SELECT match_id, match_date, p1, p2 FROM matches")(lambda t: through(t, t("matches"), readers.read_matches).select("match_id", "match_date", "p1", "p2"))
LOG = "SELECT event_id, slug, p FROM forecasts WHERE won IS NOT NULL AND m IS NOT NULL"


def _log(t):
    log = t("forecasts").select(F.when(c("won").isNotNull(), "prediction").otherwise("error").alias("record_type"), "event_id", c("slug").alias("market_slug"), F.when(c("m").isNotNull(), c("sport")).alias("predicted_winner"), c("p").alias("predicted_yes_probability"), "confidence", "sport")
    text = log.select(F.to_json(F.struct(*log.columns)).alias("value")).unionByName(t.spark.createDataFrame([("{not json",), ("",)], "value string"))
    return through(t, text, readers.read_forecast_log, lambda df, path: df.write.text(path)).select("event_id", c("market_slug").alias("slug"), c("predicted_yes_probability").alias("p"))


query("src2_read_forecast_log", LOG, "p")(_log)
LINE = "line_no, event_id, partkey, suppkey, p, day"


def _resolutions(t):
    """Each forecast as a line of its run, in order, in several files a run; a slug's lines of a run are in one file."""
    lines = t("forecasts").select("run_id", "slug", c("won").isNotNull().alias("settled"), c("won").alias("outcome"), *LINE.split(", "))
    ordered = lines.repartition("run_id", "slug").sortWithinPartitions("run_id", *LINE.split(", ")).select("run_id", "slug", "settled", "outcome")
    read = through(t, ordered, readers.read_resolutions, _as_resolutions)
    return read.select(F.regexp_extract("run", r"^run(\d+)-", 1).cast("long").alias("run_id"), "slug", "settled", "outcome")


def _as_resolutions(df, path: str) -> None:
    """Resolution lines in a folder a run, under names that mark them, by Hadoop's own rename, which any store has."""
    df.write.partitionBy("run_id").json(path)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for i, f in enumerate(x.getPath() for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "run_id=*/part-*"))):
        run = f.getParent().getName().partition("=")[2]
        fs.rename(f, jvm.org.apache.hadoop.fs.Path(f.getParent(), f"run{run}-{i}.resolutions.jsonl"))


query(
    "src3_read_resolutions",
    f"SELECT CAST(run_id AS BIGINT) AS run_id, slug, won IS NOT NULL AS settled, CAST(won AS INT) AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY run_id, slug ORDER BY {', '.join(x + ' DESC NULLS LAST' for x in LINE.split(', '))}) AS i FROM forecasts) WHERE i = 1",
)(_resolutions)


def _history(t):
    """Bundles of a token's points, some of whose times are no numbers."""
    when = F.when(c("event_id") % 5 > 0, c("event_id").cast("string")).otherwise("x").alias("t")
    points = t("prices").groupBy("token_id").agg(F.collect_list(F.struct(when, c("p"))).alias("history"))
    read = through(t, points, lambda spark, path: readers.read_price_history(spark, path, bundled=True), lambda df, path: df.write.json(path))
    return read.select(c("token_id").cast("long").alias("token_id"), F.unix_seconds("t").alias("s"), "p")


query("src4_price_history", "SELECT CAST(token_id AS BIGINT) AS token_id, CAST(event_id AS BIGINT) AS s, p FROM prices WHERE event_id % 5 > 0", "p")(_history)


def _snapshot(t):
    """Pages of events with their markets, one JSON array a file; every eleventh event has none."""
    market = F.when(c("event_id") % 11 > 0, F.struct("slug", "closed"))
    found = t("markets").groupBy("event_id").agg(F.max("league").alias("title"), F.collect_list(market).alias("markets"))
    pages = found.groupBy(F.floor(c("event_id") / 4000).alias("page")).agg(F.to_json(F.collect_list(F.struct("event_id", "title", "markets"))).alias("value"))
    read = through(t, pages.select("value"), readers.read_events_snapshot, lambda df, path: df.write.option("maxRecordsPerFile", 1).text(path))
    return read.select("event_id", "title", "slug", "closed")


query("src5_events_snapshot", "SELECT CAST(event_id AS BIGINT) AS event_id, league AS title, slug, closed FROM markets WHERE event_id % 11 > 0 UNION ALL SELECT DISTINCT CAST(event_id AS BIGINT), league, CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN) FROM markets WHERE event_id % 11 = 0")(_snapshot)
query("src6_flatten_match", "SELECT match_id, p1, p2, CAST(winner_side AS INT) AS winner_side, nullif(trim(score), '') AS score FROM matches WHERE p2 % 7 > 0 OR winner_side = 1")(
    lambda t: readers.flatten_match(t("matches").select(c("match_id").alias("id"), "tour", F.concat(c("match_date").cast("string"), F.lit("T00:00:00Z")).alias("date"), F.struct(c("p1").alias("id")).alias("player1"), F.struct(c("p2").alias("id")).alias("player2"), F.when(c("winner_side") == 1, c("p1")).when(c("p2") % 7 > 0, c("p2")).otherwise(-1).alias("winner_id"), "score")).select("match_id", "p1", "p2", "winner_side", "score")
)
query("src7_flatten_rankings", "SELECT tour, ranking_date, player_id, rank FROM rankings WHERE rank % 9 > 0")(
    lambda t: readers.flatten_rankings(t("rankings").select("tour", c("ranking_date").cast("string").alias("date"), F.struct(c("player_id").alias("id")).alias("player"), F.when(c("rank") % 9 > 0, c("rank")).alias("position"), c("rank_points").alias("point"))).select("tour", "ranking_date", "player_id", "rank")
)
query("snk1_write_dataset", "SELECT token_id, event_id, p FROM prices", "p")(lambda t: through(t, t("prices"), lambda s, p: s.read.parquet(p), writers.write_dataset).select("token_id", "event_id", "p"))


def _write_log(t):
    path = shared(t)
    predictions = t("forecasts").filter("won IS NOT NULL").select("event_id", "p", c("defens").alias("judge_score"))
    writers.write_forecast_log(predictions, t("forecasts").filter("won IS NULL").select("event_id"), t("forecasts").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("record_type string, event_id long, n long").json(path).groupBy("record_type").agg(F.count("*").alias("n_rows"), F.max("n").alias("n"))


query("snk2_write_forecast_log", "SELECT CASE WHEN won IS NULL THEN 'error' ELSE 'prediction' END AS record_type, count(*) AS n_rows, CAST(NULL AS BIGINT) AS n FROM forecasts GROUP BY 1 UNION ALL SELECT 'meta', 1, count(*) FROM forecasts")(_write_log)


def _append(t):
    path = shared(t)
    for status in ("filled", "partial"):
        writers.append_trades(t("trades").filter(c("status") == status), path)
    return t.spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


query("snk3_append_trades", "SELECT status, count(*) AS n FROM trades WHERE status IN ('filled', 'partial') GROUP BY 1")(_append)
query("snk4_write_scorecard", "SELECT sport, count(*) AS n FROM forecasts GROUP BY 1")(lambda t: through(t, t("forecasts").groupBy("sport").agg(F.count("*").alias("n")), lambda s, p: s.read.schema("sport string, n long").json(p), writers.write_scorecard))
