"""Precision and recall of points against all pairs, on points in heaps, near limits and without coordinates."""

import math

import numpy as np
import pytest

from orbisight.operators import aggregate


def brute(a, b, distance):
    near = lambda p: any(None not in p and None not in q and sum((x - y) ** 2 for x, y in zip(p, q)) <= distance * distance for q in b)
    return sum(map(near, a)) / len(a)


@pytest.mark.parametrize("distance", [0.4, 1.0, 2.5])
def test_scores_match_all_pairs(spark, distance):
    draw = np.random.default_rng(3)
    spread = lambda n: [tuple(map(float, p)) for p in draw.uniform(-4, 4, (n, 3)).round(1)]
    odd = [(None, 0.0, 0.0), (math.nan, 0.0, 0.0), (math.inf, 1.0, 1.0), (1e20, 0.0, 0.0), (0.0, -1e100, 0.0)]
    found, truth = spread(150) + odd + [(9.0, 9.0, 9.0), (-0.0, 0.0, 0.0)], spread(60) + odd + [(9.0 + distance, 9.0, 9.0), (0.0, 0.0, 0.0)]
    frame = lambda rows: spark.createDataFrame([(k, *p) for k, p in enumerate(rows)], "id long, x double, y double, z double")
    got = aggregate.surface_metrics(frame(found), frame(truth), distance).first()
    precision, recall = brute(found, truth, distance), brute(truth, found, distance)
    assert 0 < recall and math.isclose(got.precision, precision) and math.isclose(got.recall, recall)
    assert math.isclose(got.f_score, 2 * precision * recall / (precision + recall))
    none = aggregate.surface_metrics(frame(found), frame([]), distance).first()
    assert none.precision == 0 and none.recall is None and none.f_score == 0


def test_heaps_of_equal_points_need_no_pairs(spark):
    """Heaps just out of reach of one another: by pairs of points it would be 4 * 10**10 of them for either share."""
    heap = spark.range(200_000).selectExpr("id", "0D as x", "id % 3 * 0.01D as y", "0D as z")
    far = heap.selectExpr("id", "x + 1.2D as x", "y", "z")
    got = aggregate.surface_metrics(far, heap, 1.0).first()
    assert (got.precision, got.recall, got.f_score) == (0.0, 0.0, 0.0)
