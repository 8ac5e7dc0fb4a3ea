"""Operators without SQL against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from orbisight import catalogue
from orbisight.operators import match, robust, stencil, stereo, views
from orbisight.streaming import keyframes

SF = "/root/testdata/sf0.001"


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 3)):
        cost = rng.random((n, m))
        pairs = match.hungarian(cost)
        small, large = min(n, m), max(n, m)
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and math.isclose(sum(cost[i, j] for i, j in pairs), best)


def test_suppression_is_greedy(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), rng.choice((0.2, 0.5, 0.9)), rng.uniform(-3.1, 3.1), rng.uniform(-1.5, 1.5)) for k in range(150)]
    got = {r.id for r in match.angular_suppression(spark.createDataFrame(rows, "id long, label string, score double, lon double, lat double"), "label", 0.4).collect()}
    ray = lambda r: np.array([math.sin(r[3]) * math.cos(r[4]), math.sin(r[4]), math.cos(r[3]) * math.cos(r[4])])
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(k[1] != r[1] or math.atan2(np.linalg.norm(np.cross(ray(k), ray(r))), ray(k) @ ray(r)) > 0.4 for k in kept):
            kept.append(r)
    assert got == {k[0] for k in kept}


def test_rotation_survives_outliers():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn = robust.kabsch(np.eye(3), np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1.0]]))
    b = a @ turn.T
    b[:15] = rng.permutation(a[:15])
    found, good = robust.ransac_rotation(a, b, 0.01)
    assert np.allclose(found, turn, atol=1e-6) and good.sum() >= 35


def test_semi_global_smooths_an_outlier(spark):
    rows = [(0, x, d, float(abs(d - 2)) + (5.0 if x == 4 and d == 2 else 0.0)) for x in range(9) for d in range(5)]
    flat = spark.createDataFrame([(0, x, 0.0) for x in range(9)], "y int, x int, value double")
    summed = stereo.semi_global(spark.createDataFrame(rows, "y int, x int, d int, cost double"), flat, 1, 1.0, 8.0)
    chosen = stereo.select_disparity(summed).toPandas().set_index("x")["disparity"]
    assert (chosen.drop(4) == 2).all()


def test_opening_is_idempotent(spark):
    values = [(y, x, float(random.Random(y * 31 + x).randrange(9)), True) for y in range(12) for x in range(24)]
    cells = spark.createDataFrame(values, "y int, x int, value double, valid boolean")
    lut = stencil.row_table(spark, 12, 24, stencil.disk_taps(0.3, 2 * math.pi / 24, math.pi / 12))
    one = lambda c, kind: stencil.morphology(c, lut, 12, 24, kind).selectExpr("y", "x", "value", "true AS valid")
    opened = one(one(cells, "erode"), "dilate")
    assert sorted(opened.collect()) == sorted(one(one(opened, "erode"), "dilate").collect())
    low = {(r.y, r.x): r.value for r in opened.collect()}
    assert all(low[y, x] <= v for y, x, v, _ in values)


def test_layouts(spark):
    assert views.cube(spark).count() == 6 and views.icosahedron(spark).count() == 12 and views.icosahedron(spark, 2).count() == 162


def test_tracker_states():
    frame = pd.DataFrame({"session": [1] * 5, "event_id": [1, 2, 3, 4, 5], "at": [0.0, 5.0, 5.0, 20.0, 200.0], "value": [0.0, 9.0, 9.0, 9.0, 9.0]})

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    class Frames:
        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, step, *_):
            self.step = step
            return self

    step = keyframes.track(Frames(), 10.0, 100.0, 5.0).step
    assert next(step((1,), iter([frame]), State()))["state"].tolist() == ["keyframe", "tracking", "late", "keyframe", "keyframe"]


def test_rows_only_queries_run(spark):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        df = catalogue.queries()[name](spark, SF)
        assert df.count() >= 0 and df.columns


def test_semi_global_paths_match_plain_recursion(spark):
    rng = random.Random(4)
    h, w, n = 5, 6, 4
    cost = {(y, x, d): rng.random() for y in range(h) for x in range(w) for d in range(n)}
    guide = {(y, x): rng.random() for y in range(h) for x in range(w)}
    for paths, edge in ((4, 0.3), (8, 0.3)):
        steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if paths == 8 else [])
        want = dict.fromkeys(cost, 0.0)
        for dy, dx in steps:
            known: dict = {}

            def message(y, x, dy=dy, dx=dx, known=known):
                if (y, x) not in known:
                    own = [cost[y, x, d] for d in range(n)]
                    if 0 <= y - dy < h and 0 <= x - dx < w:
                        prior = message(y - dy, x - dx)
                        far = 0.5 if abs(guide[y, x] - guide[y - dy, x - dx]) < edge else max(0.1, 0.125)
                        own = [own[d] + min(min(prior) + far, *[prior[e] + (0.1 if e != d else 0) for e in range(n) if abs(e - d) <= 1]) - min(prior) for d in range(n)]
                    known[y, x] = own
                return known[y, x]

            for y, x, d in cost:
                want[y, x, d] += message(y, x)[d] / paths
        two = [(y + h * k, x, d, c) for (y, x, d), c in cost.items() for k in range(2)]
        light = [(y + h * k, x, v) for (y, x), v in guide.items() for k in range(2)]
        got = stereo.semi_global(spark.createDataFrame(two, "y int, x int, d int, cost double"), spark.createDataFrame(light, "y int, x int, value double"), h, 0.1, 0.5, paths, edge).collect()
        assert len(got) == 2 * len(cost) and all(abs(r.cost - want[r.y % h, r.x, r.d]) < 1e-9 for r in got)


@pytest.mark.parametrize("passes,most", [(1, 3), (2, 2)])
def test_cross_aggregation(spark, passes, most):
    """Against loops over every cell's cross, with gaps in the guide and in the costs, and two panoramas."""
    from orbisight.operators import stereo

    rng = np.random.default_rng(passes)
    h, w, n = 5, 7, 3
    guide = np.where(rng.random((2 * h, w)) < 0.1, np.nan, rng.random((2 * h, w)))
    cost = np.where(rng.random((2 * h, w, n)) < 0.2, np.nan, rng.random((2 * h, w, n)))
    cost[np.isnan(guide)] = np.nan
    told = lambda a, names: spark.createDataFrame([(*map(int, k), float(a[tuple(k)])) for k in np.argwhere(~np.isnan(a))], names)
    got = {(r.y, r.x, r.d): r.cost for r in stereo.cross_aggregate(told(cost, "y int, x int, d int, cost double"), told(guide, "y int, x int, value double"), h, w, n, most, 0.4, passes).collect()}

    def arm(y, x, dy, dx):
        for k in range(1, most + 1):
            a, b = y + k * dy, x + k * dx
            if not (y // h == a // h and 0 <= a and 0 <= b < w) or not abs(guide[a, b] - guide[y, x]) <= 0.4:
                return k - 1
        return most

    for _ in range(passes):
        new = np.full_like(cost, np.nan)
        for y, x in np.argwhere(~np.isnan(guide)):
            window = []
            for a in range(y - arm(y, x, -1, 0), y + arm(y, x, 1, 0) + 1):
                window.append(cost[a, x - min(arm(y, x, 0, -1), arm(a, x, 0, -1)) : x + min(arm(y, x, 0, 1), arm(a, x, 0, 1)) + 1])
            window = np.concatenate(window)
            for d in range(n):
                if (~np.isnan(window[:, d])).any():
                    new[y, x, d] = np.nanmean(window[:, d])
        cost = new
    want = {tuple(map(int, k)): cost[tuple(k)] for k in np.argwhere(~np.isnan(cost))}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
