"""Aggregates of contest rows: clutch records, head-to-head, consistency, surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clutch_records(rows: DataFrame, today: str) -> DataFrame:
    """Per player, up to today: won and played tiebreaks, deciders, comebacks and close contests, and break points saved in 180 days."""
    day = F.lit(today).cast("date")
    played = lambda c: F.nullif(F.sum(c), F.lit(0)).cast("long")
    recent = lambda c: F.sum(F.when(F.col("match_date") > F.date_sub(day, 180), F.col(c)))
    won = lambda c: F.sum(c).cast("long")
    return rows.filter(F.col("match_date") <= day).groupBy("tour", "player").agg(
        won("tb_won").alias("tb_won"), played("tb_played").alias("tb_played"), won("decider_won").alias("decider_won"), played("decider").alias("deciders"), won("comeback").alias("comebacks"), played("lost_set1").alias("lost_first"),
        won("close_won").alias("close_won"), played("close").alias("close_played"), F.try_divide(recent("o_bp_missed"), recent("o_bp_of")).alias("bp_save"),
    )


RECORD = "map<string, struct<w: bigint, l: bigint>>"


def h2h_summary(rows: DataFrame) -> DataFrame:
    """Per ordered pair: meetings, wins, a map from each known surface to the record (w, l) there, and the last three meetings, newest first.

    Records are added up by surface before they meet, so a pair's map has as many entries as there are surfaces.
    """
    pair = ["tour", "player", "opponent"]
    newest = Window.partitionBy(*pair).orderBy(F.desc("match_date"), F.desc("match_id"))
    numbered = rows.withColumn("_i", F.row_number().over(newest))
    by_surface = numbered.groupBy(*pair, "surface").agg(
        F.count("*").alias("n"), F.sum("won").alias("w"), F.collect_list(F.when(F.col("_i") <= 3, F.struct("_i", "match_id"))).alias("last")
    )
    entry = F.when(F.col("surface").isNotNull(), F.struct(F.col("surface").alias("key"), F.struct("w", (F.col("n") - F.col("w")).alias("l")).alias("value")))
    three = F.array_sort(F.flatten(F.collect_list("last")))
    return by_surface.groupBy(*pair).agg(
        F.sum("n").alias("meetings"), F.sum("w").alias("wins"), F.map_from_entries(F.array_sort(F.collect_list(entry))).cast(RECORD).alias("surfaces"),
        F.array_join(F.transform(three, lambda x: x["match_id"].cast("string")), ",").alias("last_three"),
    )


def matchup_stats(rows: DataFrame) -> DataFrame:
    """Per ordered pair: records (w, n; null without any) in deciders, tiebreaks, and contests of best of three and of five; the shares
    of contests won after winning and after losing set one; first serves won and break points converted, in these contests."""
    record = lambda w, n: F.when(F.sum(n) > 0, F.struct(F.sum(w).cast("long").alias("w"), F.sum(n).cast("long").alias("n")))
    of = lambda k: (F.when(F.col("best_of") == k, F.col("won")), F.when(F.col("best_of") == k, 1))
    share = lambda x, y: F.try_divide(F.sum(x), F.sum(y))
    return rows.groupBy("tour", "player", "opponent").agg(
        record("decider_won", "decider").alias("decider"), record("tb_won", "tb_played").alias("tiebreak"), record(*of(3)).alias("best_of_3"), record(*of(5)).alias("best_of_5"),
        share(F.when(F.col("lost_set1") == 0, F.col("won")), 1 - F.col("lost_set1")).alias("set1_conversion"), share(F.col("comeback"), F.col("lost_set1")).alias("comeback"),
        share(F.col("s_fs_won"), F.col("s_fs_in")).alias("first_serve_win"), share(F.col("s_bp_conv"), F.col("s_bp_of")).alias("bp_convert"),
    )


def consistency(rows: DataFrame, completeness: Column, serve: Column, least: int = 5) -> DataFrame:
    """Per player the mean of those of 1 - sd / .25 of one rate and 1 - sd / .20 of another, in [0, 1], that have at least five values."""
    part = lambda x, scale: F.when(F.count(x) >= least, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop(x) / scale)))
    got = rows.groupBy("tour", "player").agg(part(completeness, 0.25).alias("a"), part(serve, 0.20).alias("b"))
    known = F.array_compact(F.array("a", "b"))
    return got.select("tour", "player", F.try_divide(F.aggregate(known, F.lit(0.0), lambda x, y: x + y), F.size(known)).alias("consistency"))


def modal_surface(rows: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """The most common known surface of players with at least three contests, where it is at least that share of them."""
    counts = rows.filter("surface IS NOT NULL").groupBy("tour", "player", "surface").agg(F.count("*").alias("n"))
    top = counts.groupBy("tour", "player").agg(F.sum("n").alias("total"), F.min_by(F.struct("surface", "n"), F.struct(-F.col("n"), "surface")).alias("m"))
    return top.select("tour", "player", "m.surface", "m.n", "total").filter((F.col("total") >= least) & (F.col("n") >= share * F.col("total")))
