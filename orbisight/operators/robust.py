"""Robust model fitting in groups, deterministic by seed and by order of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def kabsch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that turns a into b at least squared error."""
    u, _, vt = np.linalg.svd(b.T @ a)
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt


def ransac_rotation(a: np.ndarray, b: np.ndarray, threshold: float, trials: int = 64, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, inliers): best by number of inliers, then by their error, then refitted to them."""
    rng, best, best_key = np.random.default_rng(seed), np.eye(3), None
    for _ in range(trials):
        k = rng.choice(len(a), 2, replace=False) if len(a) >= 2 else np.arange(len(a))
        r = kabsch(a[k], b[k])
        e = np.arccos(np.clip((a @ r.T * b).sum(1), -1, 1))
        good = e <= threshold
        key = (-int(good.sum()), float(e[good].sum()))
        if best_key is None or key < best_key:
            best, best_key = r, key
    good = np.arccos(np.clip((a @ best.T * b).sum(1), -1, 1)) <= threshold
    if good.sum() >= 2:
        best = kabsch(a[good], b[good])
        good = np.arccos(np.clip((a @ best.T * b).sum(1), -1, 1)) <= threshold
    return best, good


def fit_rotations(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, n, inliers and the rotation's angle for rows of (group, order, ax, ay, az, bx, by, bz)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        a, b = rows[["ax", "ay", "az"]].to_numpy(), rows[["bx", "by", "bz"]].to_numpy()
        r, good = ransac_rotation(a, b, threshold)
        return pd.DataFrame({group: [rows[group].iloc[0]], "n": [len(rows)], "inliers": [int(good.sum())], "angle": [float(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1)))]})

    return pairs.groupBy(group).applyInPandas(run, f"{group} long, n long, inliers long, angle double")


def triangulate(rows: DataFrame) -> DataFrame:
    """Weighted least-squares meeting point of rays by track, from rows of (track, origin ox oy oz, bearing bx by bz, w).

    The normal equations are sums, so they are aggregated in SQL and solved in closed form.
    """
    from pyspark.sql import functions as F

    w = F.col("w")
    p = lambda i, j: (F.lit(1.0 if i == j else 0.0) - F.col(f"b{i}") * F.col(f"b{j}")) * w
    axes = "xyz"
    sums = {f"a{i}{j}": F.sum(p(i, j)) for i in axes for j in axes if i <= j} | {f"v{i}": F.sum(sum((p(i, j) * F.col(f"o{j}") for j in axes), F.lit(0.0))) for i in axes}
    s = rows.groupBy("track").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    a = lambda i, j: F.col(f"a{min(i, j)}{max(i, j)}")
    minor = lambda r, c: (lambda rr, cc: a(rr[0], cc[0]) * a(rr[1], cc[1]) - a(rr[0], cc[1]) * a(rr[1], cc[0]))([k for k in axes if k != r], [k for k in axes if k != c])
    sign = lambda r, c: 1.0 if (axes.index(r) + axes.index(c)) % 2 == 0 else -1.0
    det = sum((sign("x", c) * a("x", c) * minor("x", c) for c in axes), F.lit(0.0))
    solved = lambda r: sum((sign(r, c) * minor(r, c) * F.col(f"v{c}") for c in axes), F.lit(0.0)) / F.col("det")
    return s.withColumn("det", det).where("n >= 2 AND abs(det) > 1e-9").select("track", "n", *[solved(k).alias(k) for k in axes])


def homographies(points: DataFrame, group: str) -> DataFrame:
    """(group, n, h00 .. h22): the plane map of each group's pairs (x, y) to (u, v) by least squares, h22 = 1 (null below four pairs).

    Coordinates are centred and scaled by group, so that the normal equations keep their digits; these are 45 sums a group,
    added up before the shuffle, and only their small matrix is solved in Python.
    """
    names, axes = [f"h{i}{j}" for i in range(3) for j in range(3)], "xyuv"
    spread = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in axes for n, f in (("m", F.avg), ("d", F.stddev_pop))]
    stats = points.groupBy(group).agg(*spread)
    one, zero = F.lit(1.0), F.lit(0.0)
    scaled = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).otherwise(1.0)).alias(f"_{c}") for c in axes]
    x, y, u, v = (F.col(f"_{c}") for c in axes)
    lines = ([x, y, one, zero, zero, zero, -u * x, -u * y, -u], [zero, zero, zero, x, y, one, -v * x, -v * y, -v])
    sums = [F.sum(sum((line[i] * line[j] for line in lines), F.lit(0.0))).alias(f"s{i}{j}") for i in range(9) for j in range(i, 9)]
    kept = [F.min(f"{n}_{c}").alias(f"{n}_{c}") for c in axes for n in "md"]
    added = points.join(stats, group).select(group, *[f"{n}_{c}" for c in axes for n in "md"], *scaled).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *kept, *sums)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                m = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(9)] for i in range(9)])
                size = {c: r[f"d_{c}"] or 1.0 for c in axes}
                before = np.array([[1 / size["x"], 0, -r["m_x"] / size["x"]], [0, 1 / size["y"], -r["m_y"] / size["y"]], [0, 0, 1]])
                after = np.array([[size["u"], 0, r["m_u"]], [0, size["v"], r["m_v"]], [0, 0, 1]])
                h = (after @ np.linalg.eigh(m)[1][:, 0].reshape(3, 3) @ before).ravel()
                fine = r["n"] >= 4 and abs(h[8]) > 1e-12
                rows.append((r[group], r["n"], *(h / h[8] if fine else [None] * 9)))
            yield pd.DataFrame(rows, columns=[group, "n", *names])

    kind = dict(points.dtypes)[group]
    return added.mapInPandas(solve, f"`{group}` {kind}, n long, {', '.join(f'{c} double' for c in names)}")
