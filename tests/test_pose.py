"""The five-point solver and relative poses on planted scenes."""

import math

import numpy as np
import pytest

from orbisight.operators import pose

MATCHES = "pair string, id long, ax double, ay double, az double, bx double, by double, bz double"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(rng, n, depth=3.0):
    r, t = pose._turned(rng.normal(size=3) * 0.7), unit(rng.normal(size=3))
    x = rng.normal(size=(n, 3)) * depth
    return r, t, unit(x), unit(x @ r.T + t)


def test_five_point_recovers_planted():
    rng = np.random.default_rng(1)
    scenes = [planted(rng, 5) for _ in range(300)]
    sample, found = pose.five_point(np.array([s[2] for s in scenes]), np.array([s[3] for s in scenes]))
    near = np.full(300, np.inf)
    for k, e in zip(sample, found, strict=True):
        want = pose._skew(scenes[k][1]) @ scenes[k][0]
        want /= np.linalg.norm(want)
        near[k] = min(near[k], np.abs(e - want).max(), np.abs(e + want).max())
        assert np.linalg.norm(e) == pytest.approx(1) and abs(np.linalg.det(e)) < 1e-4
    assert (near < 1e-5).mean() > 0.99
    assert np.bincount(sample).max() <= 10
    same = np.repeat(unit(rng.normal(size=(1, 1, 3))), 5, axis=1)
    assert len(pose.five_point(same, same)[0]) == 0
    assert pose.five_point(np.zeros((0, 5, 3)), np.zeros((0, 5, 3)))[1].shape == (0, 3, 3)


def test_decomposition_holds_the_pose():
    rng = np.random.default_rng(2)
    for _ in range(20):
        r, t, a, b = planted(rng, 40)
        four = pose.candidates(pose._skew(t) @ r)
        front = [pose.in_front(*c, a, b).mean() for c in four]
        best = int(np.argmax(front))
        assert front[best] == 1 and np.allclose(four[best][0], r, atol=1e-9) and np.allclose(four[best][1], t, atol=1e-9)


def rows_of(pair, a, b, start=0):
    return [(pair, start + k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(a, b, strict=True))]


def test_relative_poses(spark):
    """Six pairs with a third of outliers and noise, one of them large; and pairs without an answer."""
    rng = np.random.default_rng(3)
    want, rows = {}, []
    for k in range(6):
        n = 6000 if k == 0 else 150
        r, t, a, b = planted(rng, n)
        b = unit(b + rng.normal(size=b.shape) * 2e-4)
        bad = n // 3
        b[:bad] = unit(rng.normal(size=(bad, 3)))
        want[f"p{k}"] = r, t, n
        rows += rows_of(f"p{k}", a * rng.uniform(0.5, 2, (n, 1)), b)
    noise = unit(rng.normal(size=(2, 60, 3)))
    rows += rows_of("random", *noise) + rows_of("few", *noise[:, :4]) + rows_of("same", noise[:1, :1].repeat(9, 1)[0], noise[:1, :1].repeat(9, 1)[0])
    rows += [("p1", 10**6, None, 0.0, 1.0, 0.0, 0.0, 1.0), ("p1", 10**6 + 1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), ("p1", 10**6 + 2, math.nan, 0.0, 0.0, 0.0, 0.0, 1.0)]
    found = {x.pair: x for x in pose.relative_poses(spark.createDataFrame(rows, MATCHES), math.radians(0.3)).collect()}
    assert set(found) == {*want, "random", "few", "same"}
    for name, (r, t, n) in want.items():
        x = found[name]
        got = np.array([x[c] for c in pose._R]).reshape(3, 3), np.array([x[c] for c in pose._T])
        turn = math.acos(min(1.0, (np.trace(got[0] @ r.T) - 1) / 2))
        assert x.accepted and x.n == n and turn < 2e-3 and math.acos(min(1.0, got[1] @ t)) < 5e-3, name
        assert 0.66 * n <= x.inliers + 0.03 * n and x.inliers < 0.72 * n and x.rms < 1e-3
    assert found["few"].r00 is None and not found["few"].accepted and found["few"].inliers == 0
    assert not found["same"].accepted or found["same"].inliers == 9
    assert found["random"].inliers < 20
    assert pose.relative_poses(spark.createDataFrame([], MATCHES)).count() == 0


def test_sums_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(4)
    r, t, a, b = planted(rng, 300)
    matches = spark.createDataFrame(rows_of("x", a, b), MATCHES)
    start = spark.createDataFrame([("x", *map(float, (pose._turned(np.array([0.002, 0.001, -0.002])) @ r).ravel()), *map(float, t))], "pair string, " + ", ".join(f"{n} double" for n in [*pose._R, *pose._T]))
    both = [pose.refined(pose.chunks(matches, rows), start, "string", 0.01, 3).first() for rows in (7, 1000)]
    assert pose.chunks(matches, 7).count() > 20
    for x in both:
        assert np.allclose([x[n] for n in pose._R], r.ravel(), atol=1e-8) and np.allclose([x[n] for n in pose._T], t, atol=1e-8) and x.inliers == 300


def test_pairs_of_one_chunk_take_one_pass(spark):
    """Such pairs have no rounds of jobs, and come to the poses that sums over chunks come to."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(3):
        _, _, a, b = planted(rng, 90)
        b[:30] = unit(rng.normal(size=(30, 3)))
        rows += rows_of(f"p{k}", a, b)
    matches = spark.createDataFrame(rows, MATCHES)
    spark.sparkContext.setJobGroup("one chunk", "")
    try:
        whole = sorted(pose.relative_poses(matches, math.radians(0.3)).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one chunk"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    parts = sorted(pose.relative_poses(matches, math.radians(0.3), rows=20).collect())
    assert len(whole) == len(parts) == 3
    for x, y in zip(whole, parts, strict=True):
        assert x.pair == y.pair and x.n == y.n == 90 and x.inliers == y.inliers and x.accepted
        assert np.allclose([x[n] for n in [*pose._R, *pose._T]], [y[n] for n in [*pose._R, *pose._T]], atol=1e-8)
