"""Probability columns: point and game models, paired comparison, intervals, ages."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decision import clip


def service_point_win(first_in: Column, first_won: Column, second_won: Column) -> Column:
    return first_in * first_won + (1 - first_in) * second_won


def game_prob(p: Column) -> Column:
    """The probability to win a game from that to win a point; 0 and 1 stay."""
    q = 1 - p
    p4 = p * p * p * p
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).when(p.isNotNull(), p4 * (1 + 4 * q + 10 * q * q) + 20 * p4 * p * q * q * q / (p * p + q * q))


def matchup_point_win(serve: Column, opponent_return: Column) -> Column:
    """A server's point probability between its own rate and what the returner leaves."""
    return (serve + (1 - opponent_return)) / 2


def wilson_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    d = 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = lambda x: F.when(n > 0, clip(x, 0.0, 1.0))
    return ok(centre - half), ok(centre + half)


def log5(a: Column, b: Column) -> Column:
    side = lambda x: clip(F.coalesce(x, F.lit(0.5)), 0.001, 0.999)
    x, y = side(a), side(b)
    return x * (1 - y) / (x * (1 - y) + y * (1 - x))


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def bradley_terry(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), a / (a + b))


def season_encoding(date: Column) -> tuple[Column, Column]:
    turn = 2 * pi * F.dayofyear(date) / 366
    return F.sin(turn), F.cos(turn)


def age_years(date: Column, birth: Column) -> Column:
    return F.datediff(date, birth) / 365.25


def age_whole_years(date: Column, birth: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.months_between(date, birth) / 12)).cast("int")


def prime_distance(age: Column) -> Column:
    return F.when(age.isNotNull(), F.greatest(F.lit(0.0), F.abs(age - 26.5) - 2.5))


def peak_decay(current: Column, best: Column) -> Column:
    one = lambda x: F.greatest(x, F.lit(1))
    return F.when(current.isNotNull() & best.isNotNull(), F.log10(one(current) / one(best)))
