"""Contest scores as text: sets, games, and what they say of the winner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a contest as not played to its end (fixed values).
ABORTED = ["ret", "w/o", "walkover", "def\\."]
_SET = r"^(\d+)-(\d+)(\(\d+\))?$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use has it: a lambda's variable is not inlined."""
    return F.transform(F.array(value), use)[0]


def _tokens(score: Column) -> Column:
    """The set tokens; null for a missing or aborted score or one without sets."""
    found = F.filter(F.split(F.trim(score), r"\s+"), lambda t: t.rlike(_SET))
    return bound(found, lambda f: F.when(~F.lower(score).rlike("|".join(ABORTED)) & (F.size(f) > 0), f))


def sets_of(score: Column) -> Column:
    """Array of (a, b, tiebreak) for each set."""
    part = lambda t, k: F.regexp_extract(t, _SET, k)
    return F.transform(_tokens(score), lambda t: F.struct(part(t, 1).cast("int").alias("a"), part(t, 2).cast("int").alias("b"), (part(t, 3) != "").alias("tiebreak")))


def set_games(score: Column) -> Column:
    """struct(g1, g2): games of each side over all sets."""
    total = lambda sets, k: F.aggregate(sets, F.lit(0), lambda x, s: x + s[k])
    return bound(sets_of(score), lambda sets: F.when(sets.isNotNull(), F.struct(total(sets, "a").alias("g1"), total(sets, "b").alias("g2"))))


def match_completeness(g1: Column, g2: Column) -> Column:
    return F.when(g1 + g2 > 0, F.greatest(g1, g2) / (g1 + g2))


def parse_score(score: Column, best_of: Column | Callable[[Column], Column], winner_side: Column) -> Column:
    """struct(n_sets, went_to_decider, n_tiebreaks, winner_tiebreaks, winner_won_set1, final_margin, is_close); null where unknown.

    best_of may be a function of the number of sets. The text is parsed once.
    """

    def facts(sets: Column) -> Column:
        wins1, last = winner_side == 1, F.element_at(sets, -1)
        margin = F.abs(last["a"] - last["b"])
        breaks = F.filter(sets, lambda s: s["tiebreak"])
        own = F.filter(breaks, lambda s: F.when(wins1, s["a"] > s["b"]).otherwise(s["b"] > s["a"]))
        first = F.when(sets[0]["a"] > sets[0]["b"], 1).otherwise(2)
        format_ = best_of(F.size(sets)) if callable(best_of) else best_of
        return F.when(
            sets.isNotNull() & winner_side.isin(1, 2),
            F.struct(
                F.size(sets).alias("n_sets"), F.coalesce(F.size(sets) == format_, F.lit(False)).alias("went_to_decider"), F.size(breaks).alias("n_tiebreaks"), F.size(own).alias("winner_tiebreaks"),
                (first == winner_side).alias("winner_won_set1"), margin.alias("final_margin"), ((margin <= 2) | (F.greatest(last["a"], last["b"]) == 7) & (F.least(last["a"], last["b"]) == 6)).alias("is_close"),
            ),
        )

    return bound(sets_of(score), facts)


def infer_best_of(n_sets: Column, tier: Column) -> Column:
    return F.when(n_sets >= 4, 5).when((n_sets == 3) & (tier == "grand_slam"), 5).otherwise(3)


def set_diff(n_sets: Column, best_of: Column, won: Column) -> Column:
    """Sets won less sets lost, from their number and the format."""
    winner = F.floor(best_of / 2).cast("int") + 1
    size = winner - F.greatest(n_sets - winner, F.lit(0))
    return F.when(n_sets.isNotNull() & won.isNotNull(), F.when(won, size).otherwise(-size))


#: Surfaces by court, tiers by rank.
SURFACES = {1: "hard", 2: "clay", 3: "hard", 4: "carpet", 5: "grass"}
TIERS = {0: "futures", 1: "challenger", 2: "main_tour", 3: "masters", 4: "grand_slam", 5: "team_cup", 7: "tour_finals"}


def keyed(code: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)
