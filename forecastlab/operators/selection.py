"""Candidate scoring and selection: tiers as columns, composite scores, top picks per slate, and their backtest.

Pair rows have a_ and b_ columns: points, form_w, form_n, surf_w, surf_n, all_w, all_n, serve, ret, decider, tiebreak, age,
last_days, elo; and surface, meetings, a_h2h_wins, best_of, round_id. Tiers are 0 where inputs are unknown.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecastlab.functions.decision import classify_ev, clip, ev_per_dollar, realized_return
from forecastlab.functions.probability import log5, peak_decay, prime_distance
from forecastlab.functions.score import TIERS, keyed

c = F.col
Scorer = Callable[[], Column]


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def favorite_is_a() -> Column:
    return F.when((c("a_points") > 0) & (c("b_points") > 0), c("a_points") >= c("b_points"))


def signed(diff: Column) -> Column:
    """A difference a less b seen from the favourite; null without one."""
    return F.when(favorite_is_a(), diff).when(~favorite_is_a(), -diff)


def share(side: str, kind: str, least: int) -> Column:
    return F.when(c(f"{side}_{kind}_n") >= least, c(f"{side}_{kind}_w") / c(f"{side}_{kind}_n"))


def base_rank_points() -> Column:
    a, b = c("a_points"), c("b_points")
    return zero(F.when((a > 0) & (b > 0), F.least(F.lit(1.0), F.log10(F.greatest(a, b) / F.least(a, b)))))


def tier_form() -> Column:
    return zero(0.20 * signed(share("a", "form", 5) - share("b", "form", 5)))


def tier_surface() -> Column:
    return zero(F.when(c("surface").isNotNull(), 0.10 * signed(share("a", "surf", 5) - share("b", "surf", 5))))


def tier_surface_relative() -> Column:
    special = lambda s: share(s, "surf", 5) - F.try_divide(c(f"{s}_all_w"), c(f"{s}_all_n"))
    return zero(F.when(c("surface").isNotNull(), clip(0.10 * signed(special("a") - special("b")), -0.10, 0.10)))


def tier_h2h() -> Column:
    n = F.coalesce(c("meetings"), F.lit(0))
    bonus = F.when(n >= 6, 0.15).when(n >= 3, 0.10).when(n >= 1, 0.05).otherwise(0.0)
    return F.least(F.lit(0.175), bonus + F.when((n >= 3) & c("surface").isNotNull(), 0.025).otherwise(0.0))


def best_of_multiplier() -> Column:
    return F.when(c("best_of") == 5, 1.15).otherwise(1.0)


def scaled(kind: str, cap: float, by: float) -> Column:
    return zero(clip(cap * by * signed(c(f"a_{kind}") - c(f"b_{kind}")), -cap, cap))


def tier_serve() -> Column:
    return scaled("serve", 0.10, 5)


def tier_return() -> Column:
    return scaled("ret", 0.10, 5)


def tier_decider() -> Column:
    return scaled("decider", 0.10, 2)


def tier_tiebreak() -> Column:
    return scaled("tiebreak", 0.05, 2)


def tier_age() -> Column:
    return zero(-0.05 * F.tanh(signed(prime_distance(c("a_age")) - prime_distance(c("b_age"))) / 2))


def tier_layoff() -> Column:
    worst = F.when(c("a_last_days").isNotNull() & c("b_last_days").isNotNull(), F.greatest("a_last_days", "b_last_days"))
    return zero(-0.05 * clip((worst - 14) / 28, 0.0, 1.0))


def tier_info() -> Column:
    least = lambda k: F.least(c(f"a_{k}"), c(f"b_{k}"))
    depth = F.when(c("surface").isNotNull(), F.least(F.lit(1.0), F.coalesce(least("surf_n"), F.lit(0)) / 4)).otherwise(0.5)
    return zero(F.when(least("all_n") > 0, 0.10 * (0.6 * F.least(F.lit(1.0), least("all_n") / 8) + 0.4 * depth - 0.5) * 2))


def tier_round() -> Column:
    return zero(F.when(c("round_id") <= 2, 0.05).when(c("round_id") >= 5, -0.05))


def elo_p() -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (c("b_elo") - c("a_elo")) / 400))


def tier_elo_gap() -> Column:
    implied = F.when((c("a_points") > 0) & (c("b_points") > 0), c("a_points") / (c("a_points") + c("b_points")))
    return zero(clip(F.abs(elo_p() - implied) * 2, 0.0, 0.30))


def bonus(diff: Column, by: float, cap: float = 0.20) -> Column:
    """What the underdog has over the favourite, scaled and capped; never negative."""
    return zero(F.least(F.lit(cap), F.greatest(F.lit(0.0), -signed(diff) * by)))


def tier_underdog_form() -> Column:
    return bonus(share("a", "form", 5) - share("b", "form", 5), 0.8)


def tier_underdog_serve() -> Column:
    return bonus(c("a_serve") - c("b_serve"), 4.0)


def tier_underdog_surface() -> Column:
    return F.when(c("surface").isNotNull(), bonus(share("a", "surf", 5) - share("b", "surf", 5), 1.0)).otherwise(0.0)


def tier_underdog_elo() -> Column:
    elo = F.when(favorite_is_a(), c("b_elo")).when(~favorite_is_a(), c("a_elo"))
    return zero(F.least(F.lit(0.20), F.greatest(F.lit(0.0), elo - 1500) * 0.2 / 300))


def tier_underdog_h2h() -> Column:
    """The underdog's share of at least two past meetings over one half; meant as a share, of counts."""
    n = F.coalesce(c("meetings"), F.lit(0))
    part = F.try_divide(F.when(favorite_is_a(), n - c("a_h2h_wins")).when(~favorite_is_a(), c("a_h2h_wins")), n)
    return zero(F.when((n >= 2) & (part > 0.5), (part - 0.5) * 2 * 0.15))


def tier_competitive_floor() -> Column:
    return zero(F.when(base_log_ratio() > 0.6, -0.30 * F.least(F.lit(1.0), (base_log_ratio() - 0.6) / 0.4)))


def base_log_ratio() -> Column:
    return F.when((c("a_points") > 0) & (c("b_points") > 0), F.log10(F.greatest("a_points", "b_points") / F.least("a_points", "b_points")))


def composite(base: Column, tiers: list[tuple[float, Column]], multipliers: list[Column] = ()) -> Column:
    """clip01((base + weighted tiers) * product of multipliers)."""
    raw = base + reduce(Column.__add__, [w * t for w, t in tiers]) if tiers else base
    return clip(reduce(Column.__mul__, multipliers, raw), 0.0, 1.0)


def score_confidence_v1() -> Column:
    return composite(0.3 * base_rank_points(), [(1.0, tier_form()), (2.5, tier_serve()), (1.0, tier_h2h()), (1.0, tier_surface()), (1.0, tier_info())])


def score_ev_v1(tail: bool = False) -> Column:
    tiers = [(1.0, tier_elo_gap()), (1.0, tier_underdog_form()), (1.0, tier_underdog_serve()), (1.0, tier_underdog_surface()), (1.0, tier_underdog_h2h())]
    return composite(F.lit(0.4), tiers if tail else [*tiers, (1.0, tier_competitive_floor())])


def tier_consistency() -> Column:
    """The steadier favourite; pairs have a_consistency and b_consistency (see contests.consistency)."""
    return zero(0.10 * signed(c("a_consistency") - c("b_consistency")))


def tier_age_and_trajectory() -> Column:
    """Age and the fall from the best rank so far, both against a favourite whose points are stale; together capped at .075."""
    fall = signed(peak_decay(c("a_rank"), c("a_best_rank")) - peak_decay(c("b_rank"), c("b_best_rank")))
    return clip(tier_age() + zero(-0.05 * F.tanh(fall / 0.5)), -0.075, 0.075)


def tier_meetings_on_surface() -> Column:
    """The bonus for past meetings, and for at least two of them on the surface."""
    n = F.coalesce(c("meetings"), F.lit(0))
    bonus = F.when(n >= 6, 0.15).when(n >= 3, 0.10).when(n >= 1, 0.05).otherwise(0.0)
    return bonus + F.when(c("surface").isNotNull() & (c("surface_meetings") >= 2), 0.025).otherwise(0.0)


def tier_multiplier() -> Column:
    tier = keyed(c("rank_id"), TIERS)
    return F.when(tier == "grand_slam", 1.15).when(tier == "masters", 1.05).otherwise(1.0)


def score_legacy() -> Column:
    """The ten-tier score on the points base: the favourite's form, consistency, specialism, age and trajectory, information,
    record, layoff and meetings, times the event's tier."""
    record = zero(F.when((c("a_all_n") >= 10) & (c("b_all_n") >= 10), 0.05 * signed(share("a", "all", 10) - share("b", "all", 10))))
    tiers = (tier_form(), tier_consistency(), tier_surface_relative(), tier_age_and_trajectory(), tier_info(), record, tier_layoff(), tier_meetings_on_surface())
    return composite(base_rank_points(), [(1.0, t) for t in tiers], [tier_multiplier()])


def imbalance_score(sport_score: Column, spread: Column) -> Column:
    """The sport's own score, else the spread of records, else 0."""
    return F.coalesce(sport_score, spread, F.lit(0.0))


def form_surface_score() -> Column:
    """The win shares' log5, moved by recent form and surface record, in [.001, .999]."""
    form = clip(0.10 * (share("a", "form", 5) - share("b", "form", 5)), -0.04, 0.04)
    n = F.least(F.lit(1.0), F.sqrt(F.least("a_surf_n", "b_surf_n") / 30))
    surf = clip(0.15 * (share("a", "surf", 8) - share("b", "surf", 8)) * n, -0.06, 0.06)
    base = log5(F.try_divide(c("a_all_w"), c("a_all_n")), F.try_divide(c("b_all_w"), c("b_all_n")))
    return clip(base + zero(form) + zero(surf), 0.001, 0.999)


def form_surface_confidence() -> Column:
    """high where both have serve and return rates, eight contests on the surface and five recent ones; low where neither has
    the rates or one has under five contests on the surface; else medium."""
    n = lambda k: F.least(F.coalesce(c(f"a_{k}_n"), F.lit(0)), F.coalesce(c(f"b_{k}_n"), F.lit(0)))
    has = [c(f"{x}_serve").isNotNull() & c(f"{x}_ret").isNotNull() for x in "ab"]
    rich = has[0] & has[1] & (n("surf") >= 8) & (n("form") >= 5)
    return F.when(rich, "high").when(~(has[0] | has[1]) | (n("surf") < 5), "low").otherwise("medium")


def random_score(key: Column, seed: int) -> Column:
    """Noise in [0, 1) that depends on key and seed alone, not on partitions."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1_000_000


def as_udf(function: Callable) -> Callable[..., Column]:
    """A caller's Python scorer as an Arrow-batched column, unknown as 0 and clamped to [0, 1]."""
    from pyspark.sql.functions import pandas_udf

    wrapped = pandas_udf(function, "double")
    return lambda *columns: clip(zero(wrapped(*columns)), 0.0, 1.0)


def synthetic_labels(df: DataFrame, p: str = "p", market: str = "m", won: str = "won") -> DataFrame:
    """Lock and lean hits of the likelier side, and the value labels of that side at the synthetic price."""
    side, right = F.greatest(c(p), 1 - c(p)), (c(p) >= 0.5) == (c(won) == 1)
    pp, mm = side, F.when(c(p) >= 0.5, c(market)).otherwise(1 - c(market))
    return df.withColumns({
        "is_lock": (side >= 0.75) & right, "is_lock_or_lean": (side >= 0.60) & right, "ev": ev_per_dollar(pp, mm), "realized": realized_return(mm, right), "ev_grade": F.when(ev_per_dollar(pp, mm).isNotNull(), classify_ev(pp, mm)),
    })


def top_k_per_slate(scored: DataFrame, k: int, score: str = "score", slate: tuple[str, ...] = ("day", "tour"), tie: str = "id") -> DataFrame:
    """The k best of each slate of more than k candidates; equals by id.

    The k + 1 best say which slates have more than k. Ranks that are only limited are cut before the shuffle, so a task
    holds k + 1 rows of a slate for each part of the input, however large slates are.
    """
    w = Window.partitionBy(*slate)
    best = scored.withColumn("_i", F.row_number().over(w.orderBy(F.desc(score), tie))).filter(c("_i") <= k + 1)
    return best.withColumn("_n", F.max("_i").over(w)).filter((c("_n") > k) & (c("_i") <= k)).drop("_n", "_i")


def slate_metrics(picks: DataFrame, pool: DataFrame, by: list[str]) -> DataFrame:
    """Precision of picks (an unlabelled pick is a miss), value of those with value labels, and base rates of the pool."""
    hit = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    got = picks.groupBy(*by).agg(
        F.count("*").alias("n_picks"), F.count("is_lock").alias("n_labelable"), F.avg(hit(c("is_lock"))).alias("precision_lock"), F.avg(hit(c("is_lock_or_lean"))).alias("precision_lean"),
        F.avg("ev").alias("mean_ev"), F.try_divide(F.sum(F.when(c("ev").isNotNull(), c("realized"))), F.count("ev")).alias("mean_realized"), F.avg(c("ev_grade").isin("Prime", "Edge").cast("double")).alias("precision_edge"),
    )
    base = pool.groupBy(*by).agg(F.avg(c("is_lock").cast("double")).alias("base_lock"), F.avg(c("is_lock_or_lean").cast("double")).alias("base_lean"), F.avg("realized").alias("base_realized"))
    return got.join(base, by)


def selection_backtest(candidates: DataFrame, scorers: dict[str, Column], k: int, cutoff: str) -> DataFrame:
    """Every scorer over the same labelled candidates, in long form: top k per slate, metrics per scorer and fold."""
    labelled = synthetic_labels(candidates).withColumn("fold", F.when(c("day") <= F.lit(cutoff).cast("date"), "train").otherwise("holdout"))
    keep = ["id", "day", "tour", "fold", "is_lock", "is_lock_or_lean", "ev", "realized", "ev_grade"]
    long = labelled.select(*keep, F.inline(F.array(*[F.struct(F.lit(n).alias("scorer"), s.cast("double").alias("score")) for n, s in scorers.items()])))
    return slate_metrics(top_k_per_slate(long, k, slate=("scorer", "day", "tour")), long, ["scorer", "fold"])


def select_top(events: DataFrame, k: int, score: str = "score", start: str = "start") -> DataFrame:
    """The k best by score, then earliest start (unknown last), then id; all of them where k is not positive."""
    return events if k <= 0 else events.orderBy(F.desc(score), F.asc_nulls_last(start), "event_id").limit(k)


def top_contributions(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Each row's k columns of largest absolute value, as (place, feature, value)."""
    cells = F.filter(F.array(*[F.struct((-F.abs(c(x))).alias("o"), F.lit(x).alias("feature"), c(x).alias("value")) for x in columns]), lambda s: s["value"].isNotNull())
    return df.select("event_id", F.posexplode(F.slice(F.array_sort(cells), 1, k)).alias("place", "s")).select("event_id", "place", "s.feature", "s.value")


def rich_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs whose both sides have a rank, a record, recent form, serve, return and break-point rates, a hand, contests on the
    event's surface and a record in deciders or tiebreaks, and whose meetings are known."""
    tests = [c("surface").isNotNull(), c("meetings").isNotNull()]
    for s in ("a", "b"):
        tests += [c(f"{s}_{k}").isNotNull() for k in ("rank", "serve", "ret", "bp", "plays")] + [c(f"{s}_{k}_n") > 0 for k in ("all", "form", "surf")]
        tests.append(c(f"{s}_decider").isNotNull() | c(f"{s}_tiebreak").isNotNull())
    return pairs.filter(reduce(Column.__and__, tests))


def walk_forward_split(df: DataFrame, cutoff: str, validation_days: int = 90) -> DataFrame:
    """fold: train, validation (the last days up to the cutoff) or holdout (after it)."""
    end = F.lit(cutoff).cast("date")
    return df.withColumn("fold", F.when(c("day") > end, "holdout").when(c("day") > F.date_sub(end, validation_days), "validation").otherwise("train"))


def subset_both_sides(matches: DataFrame, allowed: DataFrame) -> DataFrame:
    ids = allowed.select("player_id").distinct()
    return matches.join(ids.withColumnRenamed("player_id", "p1"), "p1", "left_semi").join(ids.withColumnRenamed("player_id", "p2"), "p2", "left_semi")
