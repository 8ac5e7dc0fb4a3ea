"""Edge branches of the decision operators, by hand."""

import pytest
from pyspark.sql import functions as F

from orbisight.operators import decisions as D


def test_claims_go_once_by_quality_then_id(spark):
    claims = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (1, 9, 0.4), (2, 9, 0.1)], "cell int, segment int, quality double")
    assert sorted(map(tuple, D.exclusive_claims(claims, ["cell"], "segment", "quality").collect())) == [(1, 3), (2, 9)]


def test_confidence_counts_a_group_once_and_falls_back(spark):
    rows = [("a", "g", 0.8, True, 0.1), ("a", "g", 0.4, True, 0.1), ("a", "h", 0.6, True, 0.1), ("a", "g", 0.5, False, 0.1), ("b", "g", 0.9, False, 0.6), ("c", "g", 0.9, True, 0.2), ("c", "h", 1.5, False, 0.2)]
    edges = spark.createDataFrame(rows, "component string, g string, c double, p boolean, s double")
    got = {r.component: r.confidence for r in D.component_confidence(edges, "component", "g", "c", F.col("p"), "s").collect()}
    assert got == pytest.approx({"a": 0.7 * 0.5, "b": 0.3, "c": 0.0})


def test_prior_mixes_caps_and_falls_back(spark):
    rows = [(1, 1.0, True), (1, 0.0, True), (1, 0.5, True), (1, 9.0, False), (2, 0.0, True), (2, 0.0, True), (3, 1.0, False)]
    got = {r.pair: tuple(r)[1:] for r in D.match_prior(spark.createDataFrame(rows, "pair int, s double, ok boolean"), "pair", "s", F.col("ok"), 0.2, 1.0, 4.0).collect()}
    w = [0.8, 0.2, 0.6]  # the largest is capped at four times the smallest
    assert got[1] == pytest.approx((3, 2, sum(w) ** 2 / sum(x * x for x in w), 4.0))
    assert got[2] == (2, 0, 2.0, 1.0) and got[3] == (0, 0, 0.0, 0.0)


def test_reasons_keep_the_order_of_rules(spark):
    got = D.judged(spark.createDataFrame([(1,), (5,), (None,)], "n int"), [("few", F.col("n") < 3), ("odd", F.col("n") % 2 == 1)]).collect()
    assert [(r.n, r.reasons, r.accepted) for r in got] == [(1, ["few", "odd"], False), (5, ["odd"], False), (None, [], True)]


def test_priors_without_tracks_are_counted(spark):
    priors = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, panorama string")
    tracks = spark.createDataFrame([(1,), (1,)], "k int")
    assert sorted(map(tuple, D.unmatched_priors(priors, tracks, ["k"], "panorama").collect())) == [("a", 1, 1), ("b", 0, 1)]


def test_origins_follow_long_chains_and_refuse_cycles(spark):
    chain = [(k, k - 1, "frontier") for k in range(1, 41)] + [(0, None, "semantic"), (50, None, "frontier"), (51, 99, "frontier"), (60, 7, "exhaustive"), (61, 60, "frontier")]
    got = {r.id: r.origin for r in D.proposal_origins(spark.createDataFrame(chain, "id long, parent long, source string")).collect()}
    assert got == {**dict.fromkeys(range(41), "cam"), 50: "unresolved", 51: "unresolved", 60: "coverage", 61: "coverage"}
    with pytest.raises(ValueError, match="cycle"):
        D.proposal_origins(spark.createDataFrame([(1, 2, "frontier"), (2, 1, "frontier")], "id long, parent long, source string"), most_rounds=4)
