"""Bundle adjustment: derivatives, steps against a dense solution, and planted scenes."""

import math

import numpy as np
import pytest

from orbisight.operators import bundle

OBS = "scene string, camera long, landmark long, bx double, by double, bz double, w double"
CAM = "scene string, camera long, " + ", ".join(f"{n} double" for n in [*bundle.CENTRE, *bundle.MATRIX]) + ", fixed boolean"
MARK = "scene string, landmark long, x double, y double, z double"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_derivatives():
    rng = np.random.default_rng(0)
    n, h = 30, 1e-6
    matrix, centre, spot = bundle.turned(rng.normal(size=(n, 3))), rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) * 4
    bearing = unit(np.einsum("nij,nj->ni", matrix, spot - centre) + rng.normal(size=(n, 3)) * 0.05)
    e, jc, jl = bundle.residuals(bearing, centre, matrix, spot)
    for k in range(6):
        step = np.zeros((n, 6))
        step[:, k] = h
        moved = bundle.residuals(bearing, centre + step[:, 3:], bundle.turned(step[:, :3]) @ matrix, spot)[0]
        assert np.allclose((moved - e) / h, jc[:, :, k], atol=1e-4)
    for k in range(3):
        step = np.zeros((n, 3))
        step[:, k] = h
        assert np.allclose((bundle.residuals(bearing, centre, matrix, spot + step)[0] - e) / h, jl[:, :, k], atol=1e-4)
    exact = unit(np.einsum("nij,nj->ni", matrix, spot - centre))
    assert np.abs(bundle.residuals(exact, centre, matrix, spot)[0]).max() < 1e-12
    assert np.allclose(np.linalg.norm(bundle.residuals(-exact, centre, matrix, spot)[0], axis=1), [0] * n, atol=2)


def planted(rng, name, cameras, marks, noise=0.0, share=0.8):
    matrix, centre = bundle.turned(rng.normal(size=(cameras, 3)) * 0.4), rng.normal(size=(cameras, 3))
    spot = unit(rng.normal(size=(marks, 3))) * rng.uniform(3, 6, (marks, 1))
    seen = [(c, m) for c in range(cameras) for m in range(marks) if rng.random() < share]
    obs = [(name, c, m, *map(float, unit(unit(matrix[c] @ (spot[m] - centre[c])) + rng.normal(size=3) * noise)), 1.0) for c, m in seen]
    guess = bundle.turned(rng.normal(size=(cameras, 3)) * 0.02) @ matrix
    cams = [(name, c, *map(float, centre[c] if c < 2 else centre[c] + rng.normal(size=3) * 0.05), *map(float, (matrix if c < 2 else guess)[c].ravel()), c < 2) for c in range(cameras)]
    lands = [(name, m, *map(float, spot[m] + rng.normal(size=3) * 0.1)) for m in range(marks)]
    return (matrix, centre, spot), obs, cams, lands


def test_one_step_matches_dense_solution(spark):
    """Enough rounds of conjugate gradients give the step that the whole damped system has."""
    rng = np.random.default_rng(1)
    _, obs, cams, lands = planted(rng, "a", 4, 12, 1e-3)
    frames = spark.createDataFrame(obs, OBS), spark.createDataFrame(cams, CAM), spark.createDataFrame(lands, MARK)
    lin = bundle.linearised(*frames, 0.1).cache()
    damping = spark.createDataFrame([("a", 0.01)], "scene string, damping double")
    steps, _ = bundle.camera_steps(lin, damping, 20)
    got = {r.camera: np.array(r.x) for r in steps.collect()}
    rows = lin.collect()
    j, e = np.zeros((2 * len(rows), 4 * 6 + 12 * 3)), np.zeros(2 * len(rows))
    for k, r in enumerate(rows):
        j[2 * k : 2 * k + 2, r.camera * 6 : r.camera * 6 + 6] = np.array(r.jc).reshape(2, 6)
        j[2 * k : 2 * k + 2, 24 + r.landmark * 3 : 27 + r.landmark * 3] = np.array(r.jl).reshape(2, 3)
        e[2 * k : 2 * k + 2] = r.e
    h = j.T @ j
    h += 0.01 * np.diag(h.diagonal())
    want = -np.linalg.lstsq(h, j.T @ e, rcond=None)[0]
    for c in range(4):
        assert np.allclose(got[c], want[c * 6 : c * 6 + 6], atol=1e-6), c
    assert np.allclose(got[0], 0) and np.allclose(got[1], 0)


def test_planted_scenes(spark):
    """Two scenes at once, one without noise; costs fall to what the noise leaves, and outliers don't pull."""
    rng = np.random.default_rng(2)
    truth, obs, cams, lands = planted(rng, "clean", 5, 25)
    _, noisy, more, marks = planted(rng, "noisy", 4, 30, 1e-3)
    alone = [("alone", 0, 0.0, 0.0, 0.0, *np.eye(3).ravel().tolist(), False)]
    extra = [("noisy", 0, 999, 0.0, 0.0, 1.0, 1.0)]  # its landmark isn't known
    frames = spark.createDataFrame(obs + noisy + extra, OBS), spark.createDataFrame(cams + more + alone, CAM), spark.createDataFrame(lands + marks, MARK)
    cameras, landmarks, scenes = bundle.adjust(*frames)
    told = {r.scene: r for r in scenes.collect()}
    assert set(told) == {"clean", "noisy"} and told["clean"].after < 1e-6 * told["clean"].before
    assert 0.3 < told["noisy"].after / (2e-6 * len(noisy)) < 1.2
    found = {(r.scene, r.camera): r for r in cameras.collect()}
    assert len(found) == 10 and found["alone", 0].cx == 0
    for c in range(5):
        r = found["clean", c]
        assert np.allclose([r[n] for n in bundle.CENTRE], truth[1][c], atol=1e-3) and np.allclose([r[n] for n in bundle.MATRIX], truth[0][c].ravel(), atol=1e-3)
    spots = {r.landmark: (r.x, r.y, r.z) for r in landmarks.where("scene = 'clean'").collect()}
    assert all(np.allclose(spots[m], truth[2][m], atol=5e-3) for m in range(25))


def test_small_and_large_scenes_agree(spark):
    """A scene of few rows is solved in one pass, a larger one by rounds over tables: the same steps."""
    rng = np.random.default_rng(3)
    _, obs, cams, lands = planted(rng, "a", 4, 12, 1e-3)
    twin = lambda rows: [("b", *r[1:]) for r in rows]
    odd = [("a", 9, 0, 1.0, 0.0, 0.0, 1.0), ("a", None, 0, 1.0, 0.0, 0.0, 1.0), (None, 2, 0, 1.0, 0.0, 0.0, 1.0)]  # no such camera
    unseen = [(None, 2, 0.0, 0.0, 0.0, *np.eye(3).ravel().tolist(), False)]
    more = [("b", k, 7, 1.0, 0.0, 0.0, 1.0) for k in range(100, 120)]  # makes b the larger one
    frames = spark.createDataFrame(obs + twin(obs) + odd + more, OBS), spark.createDataFrame(cams + twin(cams) + unseen, CAM), spark.createDataFrame(lands + twin(lands), MARK)
    cameras, landmarks, scenes = bundle.adjust(*frames, outer=1, inner=2, rows=len(obs) + len(cams) + len(lands) + len(odd))
    told = {r.scene: r for r in scenes.collect()}
    assert set(told) == {"a", "b"} and told["a"].after < 0.5 * told["a"].before
    assert np.allclose([told["a"].before, told["a"].after], [told["b"].before, told["b"].after], rtol=1e-9)
    for df, key, cols in ((cameras, "camera", [*bundle.CENTRE, *bundle.MATRIX]), (landmarks, "landmark", ["x", "y", "z"])):
        got = {(r.scene, r[key]): [r[c] for c in cols] for r in df.collect()}
        known = [k for s, k in got if s == "a"]
        assert len(known) == (4 if key == "camera" else 12) and len(got) == 2 * len(known) + (key == "camera")
        assert all(np.allclose(got["a", k], got["b", k], atol=1e-9) for k in known)
        assert key != "camera" or got[None, 2] == [0.0, 0.0, 0.0, *np.eye(3).ravel()]


def test_small_scenes_take_few_jobs(spark):
    """Rounds over tables write some twenty tables for a single step."""
    rng = np.random.default_rng(4)
    _, obs, cams, lands = planted(rng, "a", 3, 8)
    frames = spark.createDataFrame(obs, OBS), spark.createDataFrame(cams, CAM), spark.createDataFrame(lands, MARK)
    spark.sparkContext.setJobGroup("bundle", "bundle")
    cameras, _, _ = bundle.adjust(*frames)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bundle"))
    spark.sparkContext._jsc.clearJobGroup()
    assert cameras.count() == 3 and jobs <= 12, jobs
