"""Decision columns: expected value, stakes, grades and buckets. Nulls mean unknown and stay null unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the grading rules.
RISK_WEIGHTS = {"magnitude": 0.40, "defensibility": 0.25, "market": 0.15, "model": 0.20}
GAP_SCALES = (0.40, 0.20, 0.20)
RISK_BUCKETS = ["Lock", "Lean", "Coin-flip", "Avoid", "Unrated"]
EV_BUCKETS = ["Prime", "Edge", "Thin", "Negative", "Unrated"]


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ladder(x: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """The value of the first step that x reaches; null for null."""
    out = F.lit(otherwise)
    for least, value in reversed(steps):
        out = F.when(x >= least, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out)


def _price(m: Column) -> Column:
    return (m > 0) & (m < 1)


def ev_per_dollar(p: Column, m: Column) -> Column:
    """Expected profit of a dollar on a side of probability p at price m; null outside p in [0, 1] and m in (0, 1)."""
    return F.when(_price(m) & p.between(0, 1), p * (1 - m) / m - (1 - p))


def realized_return(m: Column, won: Column) -> Column:
    return F.when(_price(m) & won.isNotNull(), F.when(won, (1 - m) / m).otherwise(-1.0))


def kelly_bet_size(p: Column, m: Column, bankroll: Column, multiplier: float, max_fraction: float) -> Column:
    """Whole units to stake: a fraction of Kelly, capped; 0 without an edge, a bankroll or valid prices."""
    b = (1 - m) / m
    full = (b * p - (1 - p)) / b
    ok = _price(m) & p.between(0, 1) & (bankroll > 0) & (full > 0)
    return F.coalesce(F.when(ok, F.floor(bankroll * F.least(full * multiplier, F.lit(max_fraction)))), F.lit(0)).cast("long")


def apply_temperature(p: Column, t: float) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return 1 / (1 + F.exp(-(F.log(q / (1 - q)) / t)))


def edge_flags(p: Column, m: Column) -> tuple[Column, Column]:
    return p < m, F.when(p.isNotNull() | m.isNotNull(), m >= 0.5)


def probability_bucket(p: Column) -> Column:
    """Five-point bins, the last closed."""
    low = (F.floor(p * 20) * 5).cast("int")
    return F.when(p >= 0.95, F.lit("0.95-1.00")).when(p.isNotNull(), F.format_string("0.%02d-0.%02d", low, low + 5))


def case_bucket(score: Column) -> Column:
    return ladder(score, [(0.85, 5), (0.65, 4), (0.45, 3), (0.25, 2)], 1)


def ev_bar_level(ev: Column) -> Column:
    return ladder(ev, [(0.50, 5), (0.30, 4), (0.15, 3), (0.05, 2), (0.0, 1)], 0)


def divergence_label(gap: Column) -> Column:
    size = F.abs(gap)
    return F.when(gap.isNull(), "no GBT prior").when(size <= 0.05, "aligned").when(size <= 0.10, "moderate").otherwise("divergent")


def classify_ev(p: Column, m: Column) -> Column:
    return ev_grade(ev_per_dollar(p, m))


def ev_grade(ev: Column) -> Column:
    return F.coalesce(ladder(ev, [(0.30, "Prime"), (0.15, "Edge"), (0.0, "Thin")], "Negative"), F.lit("Unrated"))


def gap_decay(gap: Column, p: Column, scales: tuple[float, float, float] = GAP_SCALES) -> Column:
    pos, neg, apart = scales
    off = lambda x, scale: F.greatest(F.lit(0.0), x) / scale
    return F.when(gap.isNotNull() & p.isNotNull(), clip(1 - off(-gap, neg) - off(gap, pos) - off(0.5 - (p - gap), apart), 0.0, 1.0))


def turned(gap: Column, is_a: Column) -> Column:
    return F.when(is_a, gap).otherwise(-gap)


def risk_score(p: Column, defens: Column, gap_market: Column, is_a: Column, temperature: float, gap_model: Column) -> Column:
    """The weighted mean of the terms that are known; null without a defensibility score. For tables see with_risk."""
    return risk_mean(defens, {
        "magnitude": clip(apply_temperature(p, temperature), 0.0, 1.0), "defensibility": clip(defens, 0.0, 1.0),
        "market": gap_decay(turned(gap_market, is_a), p), "model": gap_decay(turned(gap_model, is_a), p),
    })


def risk_mean(defens: Column, terms: dict[str, Column]) -> Column:
    weight = {k: F.when(v.isNotNull(), RISK_WEIGHTS[k]).otherwise(0.0) for k, v in terms.items()}
    add = lambda xs: reduce(Column.__add__, xs)
    return F.when(defens.isNotNull(), add([F.coalesce(v * RISK_WEIGHTS[k], F.lit(0.0)) for k, v in terms.items()]) / add(list(weight.values())))


def with_risk(df: DataFrame, temperature: float, score: str = "score", bucket: str = "risk_bucket") -> DataFrame:
    """df (p, defens, gap_market, gap_model, is_a) with risk_score and its bucket.

    Every step is a column that the next one names, for a term that is written out wherever it is used, once for being
    known and once for its value, doubles with every step, to code too long to be compiled.
    """
    c = F.col
    steps = [
        {"_heat": apply_temperature(c("p"), temperature), "_market": turned(c("gap_market"), c("is_a")), "_model": turned(c("gap_model"), c("is_a"))},
        {"_heat": clip(c("_heat"), 0.0, 1.0), "_defens": clip(c("defens"), 0.0, 1.0), "_market": gap_decay(c("_market"), c("p")), "_model": gap_decay(c("_model"), c("p"))},
        {score: risk_mean(c("defens"), {"magnitude": c("_heat"), "defensibility": c("_defens"), "market": c("_market"), "model": c("_model")})},
        {bucket: risk_bucket(c(score))},
    ]
    return reduce(DataFrame.withColumns, steps, df).drop("_heat", "_defens", "_market", "_model")


def risk_bucket(score: Column) -> Column:
    return F.coalesce(ladder(score, [(0.75, "Lock"), (0.60, "Lean"), (0.45, "Coin-flip")], "Avoid"), F.lit("Unrated"))


def bucket_rank(bucket: Column, order: list[str]) -> Column:
    """The bucket's place in order; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, order)), bucket)
    return F.coalesce((at + F.lit(len(order))) % (len(order) + 1), F.lit(len(order))).cast("int")  # 0, for none, becomes the last


def ev_retro_bucket(ev: Column) -> Column:
    return F.coalesce(ladder(ev, [(0.50, "50%+"), (0.30, "30-50%"), (0.15, "15-30%"), (0.0, "0-15%")], "negative"), F.lit("no_ev"))


def flow_tier(notable: Column, smart: Column) -> Column:
    return F.when(notable.isNull() & smart.isNull(), "no_snapshot").when(smart >= 1, "smart_present").when(notable >= 1, "notable_only").otherwise("no_insiders")


def reorient_probability(p: Column, picked: Column, team_a: Column) -> Column:
    norm = lambda c: F.lower(F.trim(c))
    return F.when(team_a.isNotNull(), F.when(norm(picked) == norm(team_a), p).otherwise(1 - p))


def stack_probability(model: Column, lens: Column, shifts: list[Column]) -> Column:
    """The model's prior, else the form lens, plus the shifts that are known, in [0, 1]."""
    return clip(F.coalesce(model, lens) + reduce(Column.__add__, [F.coalesce(s, F.lit(0.0)) for s in shifts]), 0.0, 1.0)


def override_without_retract(delta: Column, retractions: Column) -> Column:
    return (F.abs(delta) > 0.01) & (F.coalesce(F.size(retractions), F.lit(0)) <= 0)


def should_be_low(shifts: list[Column], toward: Column, confidence: Column) -> Column:
    """Whether the shifts are large and at least two push toward the pick, yet the confidence is not low. toward: 1 or -1."""
    known = [F.coalesce(s, F.lit(0.0)) for s in shifts]
    pushing = reduce(Column.__add__, [F.when(s * toward >= 0.04, 1).otherwise(0) for s in known])
    return (F.abs(reduce(Column.__add__, known)) >= 0.10) & (pushing >= 2) & (confidence != "low")


def split_unjustified(model: Column, sim: Column, reasoning: Column, names: list[str]) -> Column:
    return (model < 0.5) & (sim >= 0.5) & ~reduce(Column.__or__, [F.contains(F.lower(reasoning), F.lit(n)) for n in names])


def gaps(team_a_p: Column, market: Column, picked_is_a: Column, sim: Column, model: Column) -> tuple[Column, Column, Column]:
    return team_a_p - F.when(picked_is_a, market).otherwise(1 - market), team_a_p - sim, team_a_p - model


def grade_form(rate: Column, n: Column, least: int = 5) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) < least, "average").otherwise(F.coalesce(ladder(rate, [(0.80, "elite"), (0.65, "strong"), (0.50, "average"), (0.35, "below_avg")], "poor"), F.lit("average")))


def token_cost(tokens: list[Column], rates: list[Column]) -> Column:
    """Dollars at rates a million tokens; null for a model without rates. Unknown token counts are 0."""
    return F.round(reduce(Column.__add__, [F.coalesce(t, F.lit(0)) * r for t, r in zip(tokens, rates)]) / 1e6, 6)


def safe_ratio(n: Column, d: Column, eps: float = 1e-9) -> Column:
    return F.when(d > eps, n / d)


def is_notable(z: Column) -> Column:
    return z >= 2.0


def has_actionable_signal(trades: Column, insiders: Column, delta: Column) -> Column:
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    return some(trades) | some(insiders) | F.coalesce(F.abs(delta) >= 5, F.lit(False))


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def market_state(accepting: Column, closed: Column) -> Column:
    return F.when(closed, "CLOSED").when(~accepting, "HALTED").otherwise("OPEN")
