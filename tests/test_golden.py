"""Hand-computed values of single functions."""

import math

import pytest
from pyspark.sql import functions as F

from forecastlab.functions import decision as D
from forecastlab.functions import probability as P
from forecastlab.functions import score as S
from forecastlab.functions import text as X

L = F.lit


def null():
    return F.lit(None).cast("double")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("p,m,want", [(0.60, 0.55, 0.0909 + 0.0), (0.30, 0.20, 0.50), (0.5, 0.5, 0.0), (0.5, 0.0, None), (0.5, 1.0, None), (1.1, 0.5, None)])
def test_ev(spark, p, m, want):
    got = value(spark, D.ev_per_dollar(L(p), L(m)))
    assert got is None if want is None else got == pytest.approx(p * (1 - m) / m - (1 - p)) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("p,m,bankroll,mult,cap,want", [(0.6, 0.5, 10_000.0, 1.0, 1.0, 2000), (0.6, 0.5, 10_000.0, 0.5, 0.05, 500), (0.4, 0.5, 10_000.0, 1.0, 1.0, 0), (0.6, 0.5, 0.0, 1.0, 1.0, 0), (0.6, 1.0, 100.0, 1.0, 1.0, 0)])
def test_kelly(spark, p, m, bankroll, mult, cap, want):
    assert value(spark, D.kelly_bet_size(L(p), L(m), L(bankroll), mult, cap)) in (want, want - 1)


def test_temperature(spark):
    assert value(spark, D.apply_temperature(L(0.5), 3.0)) == pytest.approx(0.5)
    assert value(spark, D.apply_temperature(L(0.7), 1.0)) == pytest.approx(0.7)
    assert 0 < value(spark, D.apply_temperature(L(0.0), 2.0)) < 0.01 and value(spark, D.apply_temperature(L(1.0), 2.0)) > 0.99


def test_grades(spark):
    assert value(spark, D.classify_ev(L(0.6), L(0.4))) == "Prime" and value(spark, D.classify_ev(null(), L(0.4))) == "Unrated" and value(spark, D.classify_ev(L(0.1), L(0.5))) == "Negative"
    assert value(spark, D.risk_bucket(D.risk_score(L(0.9), L(0.9), null(), L(True), 1.0, null()))) == "Lock"
    assert value(spark, D.risk_bucket(D.risk_score(L(0.9), null(), L(0.1), L(True), 1.0, null()))) == "Unrated"
    assert value(spark, D.risk_score(L(0.8), L(0.5), null(), L(True), 1.0, null())) == pytest.approx((0.4 * 0.8 + 0.25 * 0.5) / 0.65)
    assert value(spark, D.bucket_rank(L("nonsense"), D.RISK_BUCKETS)) == 5
    assert value(spark, D.probability_bucket(L(1.0))) == "0.95-1.00" and value(spark, D.probability_bucket(L(0.07))) == "0.05-0.10"
    assert [value(spark, D.flow_tier(*x)) for x in ((null(), null()), (L(1), L(0)), (L(0), L(2)), (L(0), null()))] == ["no_snapshot", "notable_only", "smart_present", "no_insiders"]


def test_scores(spark):
    got = value(spark, S.parse_score(L("6-4 3-6 7-6(5)"), L(3), L(1)))
    assert got.asDict() == {"n_sets": 3, "went_to_decider": True, "n_tiebreaks": 1, "winner_tiebreaks": 1, "winner_won_set1": True, "final_margin": 1, "is_close": True}
    for bad in ("6-2 3-1 ret.", "W/O", "", "abc"):
        assert value(spark, S.parse_score(L(bad), L(3), L(1))) is None
    assert value(spark, S.parse_score(L("6-4 6-3"), L(3), L(3))) is None
    assert value(spark, S.set_games(L("7-6(3) x 6-4"))).asDict() == {"g1": 13, "g2": 10}
    assert value(spark, S.match_completeness(L(12), L(0))) == 1.0 and value(spark, S.match_completeness(L(0), L(0))) is None
    assert [value(spark, S.infer_best_of(L(n), L(t))) for n, t in ((4, None), (3, "grand_slam"), (3, "masters"), (2, "grand_slam"), (None, None))] == [5, 5, 3, 3, 3]


def test_probabilities(spark):
    assert value(spark, P.game_prob(L(0.5))) == pytest.approx(0.5) and value(spark, P.game_prob(L(0.0))) == 0 and value(spark, P.game_prob(L(1.0))) == 1
    assert value(spark, P.log5(L(0.5), null())) == pytest.approx(0.5) and value(spark, P.elo_expected(L(1700.0), L(1300.0))) == pytest.approx(1 / 1.1, abs=1e-3)
    low, high = (value(spark, x) for x in P.wilson_interval(L(0.5), L(100)))
    assert low == pytest.approx(0.4038, abs=1e-3) and high == pytest.approx(0.5962, abs=1e-3)
    assert value(spark, P.bradley_terry(L(0), L(5))) is None and value(spark, P.prime_distance(L(26.0))) == 0 and value(spark, P.prime_distance(L(35.0))) == 6.0
    assert value(spark, P.peak_decay(L(10), L(1))) == pytest.approx(1.0) and value(spark, P.season_encoding(L("2024-12-31").cast("date"))[1]) == pytest.approx(1.0)


def test_text(spark):
    assert value(spark, X.normalize_name(L("  Élan-Ñu   MÜLLER "))) == "elan nu muller"
    assert value(spark, X.surname_candidates(L("Juan Martín del Potro"))) == ["potro", "del"] and value(spark, X.surname_candidates(L(""))) == []
    assert sorted(map(tuple, value(spark, X.pair_keys(L("Ana B"), L("Cy De F"))))) == [("b", "de"), ("b", "f")]
    assert value(spark, X.win_pct_from_record(L("3-1"))) == 0.75 and value(spark, X.win_pct_from_record(L("1-1-2"))) == 0.5 and value(spark, X.win_pct_from_record(L("0-0"))) is None and value(spark, X.win_pct_from_record(L("x"))) is None
    title = spark.createDataFrame([("Cup: A vs. B",), ("A vs B",), ("A",), (" vs B",), (None,)], "title string")
    assert [tuple(r["h"]) if r["h"] else None for r in title.select(X.parse_h2h_title(F.col("title")).alias("h")).collect()] == [("A", "B"), ("A", "B"), None, None, None]
    assert [value(spark, X.settled_yes(X.parse_json_list(L(x)))) for x in ('["1"]', '["0.0005"]', '["0.5"]', "{")] == [1, 0, None, None]
    assert value(spark, X.coerce_time(L("junk"))) is None and value(spark, X.coerce_float(L(" 2 "))) == 2.0


def test_nulls_are_unknown(spark):
    assert value(spark, D.edge_flags(null(), L(0.5))[0]) is None and value(spark, D.market_state(L(True), L(True))) == "CLOSED" and value(spark, D.realized_return(L(0.5), L(None).cast("boolean"))) is None
    assert math.isclose(value(spark, D.stack_probability(null(), L(0.4), [L(0.1), null()])), 0.5)
