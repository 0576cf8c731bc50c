"""Price histories: changes, returns, volatility, sparklines, books, and backtest rows and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecastlab.functions.text import fixed

from .asof import asof_price, nearest_within
from .long_streams import numbered, with_previous
from .quantiles import exact_quantiles


def returns(points: DataFrame) -> DataFrame:
    """points with the difference to the token's previous price."""
    return with_previous(points, ["token_id"], "t", ["event_id"], "p", "_p").withColumn("r", F.col("p") - F.col("_p")).drop("_p")


def return_volatility(points: DataFrame) -> DataFrame:
    """The population deviation of successive differences over prices inside (0, 1); null with fewer than five prices."""
    inside = returns(points.filter((F.col("p") > 0) & (F.col("p") < 1)))
    return inside.groupBy("token_id").agg(F.count("*").alias("n_points"), F.when(F.count("*") >= 5, F.stddev_pop("r")).alias("volatility"))


def price_changes(points: DataFrame, windows: dict[str, int]) -> DataFrame:
    """The change of each token's latest price over each window, against the nearest point within five minutes."""
    latest = points.groupBy("token_id").agg(F.max("t").alias("kickoff"), F.max_by("p", F.struct("t", "event_id")).alias("last"))
    near = nearest_within(points, latest.select("token_id", "kickoff"), windows)
    return near.join(latest.select("token_id", "last"), "token_id").select("token_id", "last", *[(F.col("last") - F.col(w)).alias(w) for w in windows])


def sparkline(points: DataFrame, n: int = 5, invert: bool = False) -> DataFrame:
    """n prices evenly spaced by index, to three decimals, joined by arrows; all of them where there are no more than n."""
    placed = numbered(points, ["token_id"], "t", ["event_id"])
    p = 1 - F.col("p") if invert else F.col("p")
    step = (F.col("_n") - 1) / (n - 1)
    chosen = F.array_contains(F.array(*[F.bround(step * i).cast("long") for i in range(n)]), F.col("_i")) | (F.col("_n") <= n)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", fixed(p, 3).alias("s")))), lambda x: x["s"]), "→")
    return placed.filter(chosen).groupBy("token_id").agg(text.alias("line"))


def book_summary(levels: DataFrame, per_task: int = 500_000) -> DataFrame:
    """A row a book: for each side the best price, the size there, the value and the number of levels; nulls for an empty side.

    Prices and then books are dealt to tasks of about per_task levels each before they are summed, so that what a task
    holds does not grow with the table: few levels of a book share a price, and summing where they are read would hold nearly all.
    """
    tasks = max(int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-levels.count() // per_task))
    one = levels.repartition(tasks, "market_id", "side", "price").groupBy("market_id", "side", "price").agg(F.sum("size").alias("s"), F.count("*").alias("k"), F.sum(F.col("price") * F.col("size")).alias("v"))
    cols = []
    for name, best in (("bid", F.max_by), ("ask", F.min_by)):
        here = F.col("side") == name
        cols += [(F.max if name == "bid" else F.min)(F.when(here, F.col("price"))).alias(f"{name}_top"), best(F.when(here, F.col("s")), F.when(here, F.col("price"))).alias(f"{name}_size"), F.sum(F.when(here, F.col("v"))).alias(f"{name}_value"), F.coalesce(F.sum(F.when(here, F.col("k"))), F.lit(0)).alias(f"{name}_depth")]
    return one.repartition(tasks, "market_id").groupBy("market_id").agg(*cols)


def build_backtest_rows(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row a settled token: opening price, prices a day, an hour and a minute before kickoff, movement, volatility, points.

    Prices after kickoff are not looked at.
    """
    settled = anchors.filter(F.col("outcome").isNotNull())
    before = points.join(settled.select("token_id", "kickoff"), "token_id").filter(F.col("t") <= F.col("kickoff")).drop("kickoff")
    first = before.groupBy("token_id").agg(F.min_by("p", F.struct("t", "event_id")).alias("open_p"), F.count("*").alias("n_points"))
    prior = asof_price(before, settled.select("token_id", "kickoff"), {"p_24h": 86_400, "p_1h": 3_600, "p_1m": 60})
    out = settled.join(first, "token_id").join(prior.drop("kickoff"), "token_id").join(return_volatility(before).select("token_id", "volatility"), "token_id", "left")
    return out.withColumn("movement", F.col("p_1m") - F.col("p_24h"))


def right_closed(x: Column, edges: list[float], lowest: bool) -> Column:
    """The index of the interval (a, b] that x is in; the first takes its lower edge too, if lowest."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = (x >= edges[i]) if lowest and i == 0 else (x > edges[i])
        out = F.when(low & (x <= edges[i + 1]), i).otherwise(out)
    return out


def bucket_calibration(df: DataFrame, p: str, edges: list[float], lowest: bool = True) -> DataFrame:
    """Per bucket of prices: number, mean price, win rate, and the edge in basis points, rounded half to even."""
    edge = F.avg("won") - F.avg(p)
    return df.withColumn("bucket", right_closed(F.col(p), edges, lowest)).filter("bucket IS NOT NULL").groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg("won").alias("win_rate"), edge.alias("edge"), F.bround(edge * 10_000).cast("long").alias("edge_bps")
    )


def calibration_by_league(df: DataFrame, min_n: int = 30) -> DataFrame:
    """Leagues of at least min_n rows: the Brier score of opening and closing prices and the improvement. Unknown prices count only in n."""
    off = lambda c: F.avg((F.col(c) - F.col("won")) ** 2)
    return df.groupBy("league").agg(F.count("*").alias("n"), off("open_p").alias("brier_open"), off("close_p").alias("brier_close")).filter(F.col("n") >= min_n).withColumn("improvement", F.col("brier_open") - F.col("brier_close"))


def drift_signal(df: DataFrame, edges: list[float]) -> DataFrame:
    """Of closes in [.2, .8]: per bin of drift the number, mean close, win rate and edge against the close."""
    some = df.filter(F.col("close_p").between(0.2, 0.8)).withColumn("bucket", right_closed(F.col("drift"), edges, True)).filter("bucket IS NOT NULL")
    return some.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("close_p").alias("mean_close"), F.avg("won").alias("win_rate"), (F.avg("won") - F.avg("close_p")).alias("edge"))


def overround(df: DataFrame, outcomes: int = 3) -> DataFrame:
    """Per league, of events with that many outcomes: mean and median of the sums of closing and of opening prices; unknown ones add 0."""
    event = df.groupBy("league", "event_id").agg(F.count("*").alias("k"), F.coalesce(F.sum("close_p"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("open_p"), F.lit(0.0)).alias("o")).filter(F.col("k") == outcomes)
    means = event.groupBy("league").agg(F.count("*").alias("events"), F.avg("c").alias("mean_close"), F.avg("o").alias("mean_open"))
    middle = lambda x, name: exact_quantiles(event, x, [0.5], ["league"]).select("league", F.col("q")[0].alias(name))
    return means.join(middle("c", "median_close"), "league").join(middle("o", "median_open"), "league")


def quantile_bucket_brier(df: DataFrame, column: str, q: int = 4) -> DataFrame:
    """Per quantile bucket of a column (linear interpolation, right-closed, lowest included): number, mean, win rate, Brier score of the close."""
    known = df.filter(F.col(column).isNotNull())
    edges = exact_quantiles(known, column, [i / q for i in range(q + 1)]).select(F.col("q").alias("e"))
    placed = known.join(F.broadcast(edges))  # one row
    bucket = F.greatest(F.lit(1), F.size(F.filter("e", lambda e: e < F.col(column)))) - 1
    return placed.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(column).alias("mean_x"), F.avg("won").alias("win_rate"), F.avg((F.col("close_p") - F.col("won")) ** 2).alias("brier"))


def headroom(df: DataFrame, k: float = 0.2) -> DataFrame:
    """The Brier score of the close, and after moving it by k toward the outcome."""
    moved = F.col("close_p") + k * (F.col("won") - F.col("close_p"))
    return df.agg(F.count("*").alias("n"), F.avg((F.col("close_p") - F.col("won")) ** 2).alias("brier"), F.avg((moved - F.col("won")) ** 2).alias("brier_moved"))


def convergence(df: DataFrame, offsets: list[str], outcome: str = "outcome") -> DataFrame:
    """For each offset's price column, in order: number known, coverage in percent, Brier score."""
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(o).alias("offset"), F.col(o).alias("p")) for i, o in enumerate(offsets)])
    return df.select(outcome, F.inline(rows)).groupBy("place", "offset").agg(F.count("p").alias("n"), (100 * F.count("p") / F.count("*")).alias("coverage"), F.avg((F.col("p") - F.col(outcome)) ** 2).alias("brier"))
