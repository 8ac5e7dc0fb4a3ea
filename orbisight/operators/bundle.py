"""Bundle adjustment of bearings: landmarks eliminated a row each, the reduced camera system solved by conjugate gradients.

Observations are (scene, camera, landmark, bx, by, bz, w), cameras (scene, camera, cx, cy, cz, r00 .. r22, fixed) with the
matrix turning world into camera directions, landmarks (scene, landmark, x, y, z).  The reduced system is never formed: a
product with it is one sum by landmark and one by camera over the observations, so neither the cameras of a landmark nor
those of a scene meet in pairs or in one task.  All scenes are solved in the same jobs, each with its own damping and step.
A scene of few rows has its sums in one task, without rounds: the same steps over arrays of many such scenes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.lineage import written

CENTRE, MATRIX = ["cx", "cy", "cz"], [f"r{i}{j}" for i in range(3) for j in range(3)]
_CAMERA, _LANDMARK = ["scene", "camera"], ["scene", "landmark"]


def _skews(v: np.ndarray) -> np.ndarray:
    z = np.zeros(len(v))
    return np.stack([z, -v[:, 2], v[:, 1], v[:, 2], z, -v[:, 0], -v[:, 1], v[:, 0], z], axis=1).reshape(-1, 3, 3)


def turned(v: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = _skews(v / np.maximum(angle[:, 0], 1e-300))
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def residuals(bearing: np.ndarray, centre: np.ndarray, matrix: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(e, by camera, by landmark): where landmarks appear in the tangent planes of their bearings, and how that moves.

    A camera moves by a rotation vector and a shift of its centre, a landmark by a shift: arrays (n, 2), (n, 2, 6), (n, 2, 3).
    """
    beside = np.cross(bearing, np.eye(3)[np.abs(bearing).argmin(1)])
    beside /= np.linalg.norm(beside, axis=1, keepdims=True)
    plane = np.stack([beside, np.cross(bearing, beside)], axis=1)
    seen = np.einsum("nij,nj->ni", matrix, spot - centre)
    far = np.maximum(np.linalg.norm(seen, axis=1), 1e-12)[:, None]
    d = seen / far
    slope = (plane - np.einsum("nki,ni,nj->nkj", plane, d, d)) / far[:, :, None]
    e = np.einsum("nki,ni->nk", plane, d)
    behind = np.einsum("ni,ni->n", d, bearing) < 0
    e = np.where(behind[:, None], e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-12) * math.pi / 2, e)
    by_spot = slope @ matrix
    return e, np.concatenate([-slope @ _skews(seen), -by_spot], axis=2), by_spot


def weighted(e: np.ndarray, jc: np.ndarray, jl: np.ndarray, w: np.ndarray, fixed: np.ndarray, huber: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(jc, jl, e, cost): residuals and derivatives by the roots of their weights; a fixed camera doesn't move."""
    size = np.linalg.norm(e, axis=1)
    root = np.sqrt(w * np.minimum(1.0, huber / np.maximum(size, 1e-300)))[:, None]
    cost = w * np.where(size <= huber, size**2, 2 * huber * size - huber**2)
    return np.where(fixed[:, None, None], 0.0, jc) * root[:, :, None], jl * root[:, :, None], e * root, cost


def linearised(observations: DataFrame, cameras: DataFrame, landmarks: DataFrame, huber: float) -> DataFrame:
    """(scene, camera, landmark, jc, jl, e, cost) of every observation, weighted; a fixed camera doesn't move."""
    kinds = dict(observations.dtypes)
    names = ["scene", "camera", "landmark"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            take = lambda cols: b[cols].to_numpy(float)  # noqa: B023, E731
            e, jc, jl = residuals(take(["bx", "by", "bz"]), take(CENTRE), take(MATRIX).reshape(-1, 3, 3), take(["x", "y", "z"]))
            jc, jl, e, cost = weighted(e, jc, jl, take(["w"])[:, 0], b["fixed"].to_numpy(bool), huber)
            out = b[names].copy()
            out["jc"], out["jl"], out["e"] = list(jc.reshape(-1, 12)), list(jl.reshape(-1, 6)), list(e)
            yield out.assign(cost=cost)

    met = observations.join(cameras, _CAMERA).join(landmarks, _LANDMARK)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", jc array<double>, jl array<double>, e array<double>, cost double"
    return met.select(*names, "bx", "by", "bz", "w", *CENTRE, *MATRIX, "fixed", "x", "y", "z").mapInPandas(run, schema)


def _times(rows: Column, v: Column, wide: int) -> list[Column]:
    """A 2 x ``wide`` matrix times a vector."""
    return [sum((rows[k * wide + c] * v[c] for c in range(wide)), F.lit(0.0)) for k in range(2)]


def _across(rows: Column, v: list[Column], wide: int) -> list[Column]:
    """Its transpose times a vector of two."""
    return [rows[c] * v[0] + rows[wide + c] * v[1] for c in range(wide)]


def _sums(made: list[Column]) -> Column:
    return F.array(*[F.sum(m) for m in made])


def _symmetric(m: Column) -> list[list[Column]]:
    place = {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4, (2, 2): 5}
    return [[m[place[min(i, j), max(i, j)]] for j in range(3)] for i in range(3)]


def _inverse(m: list[list[Column]]) -> Column:
    """The upper triangle of the inverse of a symmetric 3 x 3 matrix; zero where there is none."""
    minor = lambda r, c: (lambda rr, cc: m[rr[0]][cc[0]] * m[rr[1]][cc[1]] - m[rr[0]][cc[1]] * m[rr[1]][cc[0]])([k for k in range(3) if k != r], [k for k in range(3) if k != c])
    det = sum(((-1) ** c * m[0][c] * minor(0, c) for c in range(3)), F.lit(0.0))
    return F.array(*[F.when(F.abs(det) > 1e-30, (-1) ** (r + c) * minor(r, c) / det).otherwise(0.0) for r in range(3) for c in range(r, 3)])


def _apply(m: Column, v: Column) -> Column:
    full = _symmetric(m)
    return F.array(*[sum((full[i][j] * v[j] for j in range(3)), F.lit(0.0)) for i in range(3)])


def camera_steps(lin: DataFrame, damping: DataFrame, inner: int) -> tuple[DataFrame, DataFrame]:
    """(scene, camera, x): the step of every camera after ``inner`` rounds of conjugate gradients, and the landmarks' part.

    The landmarks' part is (scene, landmark, inverse): the inverse of each landmark's own damped 3 x 3 block.
    """
    jl, jc, e = F.col("jl"), F.col("jc"), F.col("e")
    blocks = [jl[i] * jl[j] + jl[3 + i] * jl[3 + j] for i in range(3) for j in range(i, 3)]
    own = lin.groupBy(*_LANDMARK).agg(_sums(blocks).alias("v"), _sums(_across(jl, [e[0], e[1]], 3)).alias("g")).join(damping, "scene")
    damped = [[_symmetric(F.col("v"))[i][j] * (1 + F.col("damping") if i == j else F.lit(1.0)) for j in range(3)] for i in range(3)]
    marks = written(own.select(*_LANDMARK, _inverse(damped).alias("inverse"), "g"))
    settled = lin.join(marks.select(*_LANDMARK, _apply(F.col("inverse"), F.col("g")).alias("z")), _LANDMARK)
    left = lambda u: [u[k] - _times(jl, F.col("z"), 3)[k] for k in range(2)]
    start = settled.groupBy(*_CAMERA).agg(_sums([-v for v in _across(jc, left([e[0], e[1]]), 6)]).alias("r"), _sums([jc[c] * jc[c] + jc[6 + c] * jc[6 + c] for c in range(6)]).alias("own")).join(damping, "scene")
    scaled = lambda r: F.transform(F.arrays_zip(r.alias("r"), F.col("own").alias("own")), lambda x: F.when(x["own"] > 0, x["r"] / x["own"]).otherwise(0.0))
    dot = lambda a, b: sum((F.col(a)[c] * F.col(b)[c] for c in range(6)), F.lit(0.0))
    now = start.withColumn("z", scaled(F.col("r"))).select(*_CAMERA, "damping", "own", F.array_repeat(F.lit(0.0), 6).alias("x"), "r", "z", F.col("z").alias("p"))
    now = written(now)
    for _ in range(inner):
        moved = lin.join(now.select(*_CAMERA, "p"), _CAMERA).withColumn("u", F.array(*_times(jc, F.col("p"), 6)))
        y = moved.groupBy(*_LANDMARK).agg(_sums(_across(jl, [F.col("u")[0], F.col("u")[1]], 3)).alias("y"))
        z = y.join(marks, _LANDMARK).select(*_LANDMARK, _apply(F.col("inverse"), F.col("y")).alias("z"))
        q = moved.join(z, _LANDMARK).groupBy(*_CAMERA).agg(_sums(_across(jc, left([F.col("u")[0], F.col("u")[1]]), 6)).alias("q"))
        plus = lambda a, k, b: F.array(*[F.col(a)[c] + F.col(k) * F.col(b)[c] for c in range(6)])
        full = now.join(q, _CAMERA).withColumn("q", F.array(*[F.col("q")[c] + F.col("damping") * F.col("own")[c] * F.col("p")[c] for c in range(6)]))
        full = written(full)
        rate = full.groupBy("scene").agg(F.sum(dot("r", "z")).alias("rz"), F.sum(dot("p", "q")).alias("pq")).select("scene", "rz", F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(0.0).alias("rate"), F.when(F.col("pq") > 0, -F.col("rz") / F.col("pq")).otherwise(0.0).alias("back"))
        step = full.join(rate, "scene").withColumn("x", plus("x", "rate", "p")).withColumn("r", plus("r", "back", "q")).withColumn("z", scaled(F.col("r")))
        after = step.groupBy("scene").agg(F.sum(dot("r", "z")).alias("after"))
        turn = step.join(after, "scene").withColumn("turn", F.when(F.col("rz") > 0, F.col("after") / F.col("rz")).otherwise(0.0))
        now = written(turn.select(*_CAMERA, "damping", "own", "x", "r", "z", plus("z", "turn", "p").alias("p")))
    return now.select(*_CAMERA, "x"), marks


def _moved(cameras: DataFrame, steps: DataFrame) -> DataFrame:
    kinds = dict(cameras.dtypes)
    names = [*_CAMERA, *CENTRE, *MATRIX, "fixed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), float).reshape(-1, 6)
            out = b[names].copy()
            out[MATRIX] = (turned(x[:, :3]) @ b[MATRIX].to_numpy(float).reshape(-1, 3, 3)).reshape(-1, 9)
            out[CENTRE] = b[CENTRE].to_numpy(float) + x[:, 3:]
            yield out

    stepped = cameras.join(steps, _CAMERA, "left").withColumn("x", F.when(F.col("fixed") | F.col("x").isNull(), F.array_repeat(F.lit(0.0), 6)).otherwise(F.col("x")))
    return stepped.select(*names, "x").mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names))


class _Scenes:
    """Some scenes at once: observations with the places of their scene, camera and landmark, and sums over them as arrays."""

    def __init__(self, scene: np.ndarray, camera: np.ndarray, landmark: np.ndarray, bearing: np.ndarray, w: np.ndarray, of_camera: np.ndarray, of_landmark: np.ndarray, fixed: np.ndarray, many: int) -> None:
        self.scene, self.camera, self.landmark, self.bearing, self.w = scene, camera, landmark, bearing, w
        self.of_camera, self.of_landmark, self.fixed, self.many = of_camera, of_landmark, fixed, many

    def linear(self, centre: np.ndarray, matrix: np.ndarray, spot: np.ndarray, huber: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """jc (2, 6, n), jl (2, 3, n), e (2, n) and costs of all observations."""
        e, jc, jl = residuals(self.bearing, centre[self.camera], matrix[self.camera], spot[self.landmark])
        jc, jl, e, cost = weighted(e, jc, jl, self.w, self.fixed[self.camera], huber)
        return np.ascontiguousarray(jc.transpose(1, 2, 0)), np.ascontiguousarray(jl.transpose(1, 2, 0)), np.ascontiguousarray(e.T), cost

    def steps(self, jc: np.ndarray, jl: np.ndarray, e: np.ndarray, damping: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``camera_steps`` does: (x, shift), the steps of the cameras and of the landmarks, as columns."""
        by_camera = lambda u: _added(self.camera, [jc[0, k] * u[0] + jc[1, k] * u[1] for k in range(6)], len(self.of_camera))
        by_landmark = lambda u: _added(self.landmark, [jl[0, k] * u[0] + jl[1, k] * u[1] for k in range(3)], len(self.of_landmark))
        left = lambda u, z: [u[r] - sum(jl[r, k] * z[k][self.landmark] for k in range(3)) for r in range(2)]
        along = lambda p: [sum(jc[r, k] * p[k][self.camera] for k in range(6)) for r in range(2)]
        of_scene = lambda a, b: np.bincount(self.of_camera, (a * b).sum(0), self.many)[self.of_camera]
        block = _added(self.landmark, [jl[0, i] * jl[0, j] + jl[1, i] * jl[1, j] for i in range(3) for j in range(i, 3)], len(self.of_landmark))
        block[[0, 3, 5]] *= 1 + damping[self.of_landmark]
        inverse = _inverses(block)
        own = _added(self.camera, [jc[0, k] ** 2 + jc[1, k] ** 2 for k in range(6)], len(self.of_camera))
        scaled = lambda r: np.divide(r, own, out=np.zeros_like(r), where=own > 0)
        rate_of = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        r = -by_camera(left(e, _applied(inverse, by_landmark(e))))
        z, x = scaled(r), np.zeros_like(r)
        p = z
        for _ in range(inner):
            u = along(p)
            q = by_camera(left(u, _applied(inverse, by_landmark(u)))) + damping[self.of_camera] * own * p
            rz = of_scene(r, z)
            rate = rate_of(rz, of_scene(p, q))
            x, r = x + rate * p, r - rate * q
            z = scaled(r)
            p = z + rate_of(of_scene(r, z), rz) * p
        after = along(x)
        return x, _applied(inverse, by_landmark([e[k] + after[k] for k in range(2)]))

    def adjusted(self, centre: np.ndarray, matrix: np.ndarray, spot: np.ndarray, outer: int, inner: int, huber: float, damping: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centre, matrix, spot, before, after) as ``adjust`` has them."""
        *lin, cost = self.linear(centre, matrix, spot, huber)
        before = now = np.bincount(self.scene, cost, self.many)
        held = np.full(self.many, damping)
        for _ in range(outer):
            x, shift = self.steps(*lin, held, inner)
            x = np.where(self.fixed, 0.0, x).T
            tried = centre + x[:, 3:], turned(x[:, :3]) @ matrix, spot - shift.T
            *new, cost = self.linear(*tried, huber)
            then = np.bincount(self.scene, cost, self.many)
            better = then < now
            now, held = np.where(better, then, now), np.where(better, held / 10, held * 10)
            c, m, o = better[self.of_camera], better[self.of_landmark], better[self.scene]
            centre, matrix, spot = np.where(c[:, None], tried[0], centre), np.where(c[:, None, None], tried[1], matrix), np.where(m[:, None], tried[2], spot)
            lin = new if o.all() else [np.where(o, a, b) for a, b in zip(new, lin, strict=True)]
        return centre, matrix, spot, before, now


def _added(place: np.ndarray, columns: list[np.ndarray], many: int) -> np.ndarray:
    return np.stack([np.bincount(place, c, many) for c in columns])


def _inverses(m: np.ndarray) -> np.ndarray:
    """``_inverse`` of columns of upper triangles."""
    a, b, c, d, e, f = m
    minors = np.stack([d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b])
    det = a * minors[0] + b * minors[1] + c * minors[2]
    return np.divide(minors, det, out=np.zeros_like(minors), where=np.abs(det) > 1e-30)


def _applied(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    a, b, c, d, e, f = m
    return np.stack([a * v[0] + b * v[1] + c * v[2], b * v[0] + d * v[1] + e * v[2], c * v[0] + e * v[1] + f * v[2]])


def _places(scene: np.ndarray, name: pa.Array, of: np.ndarray, known: pa.Array) -> np.ndarray:
    """Where the known things of a scene have a name; -1 where it isn't known."""
    codes = pa.concat_arrays([known, name]).dictionary_encode().indices
    codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    span = int(codes.max(initial=0)) + 1
    key, want = of * span + codes[: len(known)], scene * span + codes[len(known) :]
    key[codes[: len(known)] < 0], want[codes[len(known) :] < 0] = -2, -1
    order = np.argsort(key, kind="stable")
    at = np.searchsorted(key[order], want)
    found = np.append(order, -1)[at]
    return np.where(np.append(key[order], -2)[at] == want, found, -1)


_CAM, _SPOT = [*CENTRE, *MATRIX], ["x", "y", "z"]


def _solved(batch: pa.RecordBatch, outer: int, inner: int, huber: float, damping: float) -> pa.RecordBatch:
    """The scenes of a batch, a row each, after adjustment."""
    many = {k: pc.list_value_length(batch.column(k)).to_numpy(zero_copy_only=False) for k in "ocm"}
    of = {k: np.repeat(np.arange(len(batch)), n) for k, n in many.items()}
    flat = {k: batch.column(k).flatten() for k in "ocm"}
    take = lambda k, names: np.stack([flat[k].field(n).to_numpy(zero_copy_only=False) for n in names], axis=1).astype(float)
    camera, landmark = (_places(of["o"], flat["o"].field(n), of[k], flat[k].field(n)) for k, n in (("c", "camera"), ("m", "landmark")))
    known = (camera >= 0) & (landmark >= 0) & batch.column("scene").is_valid().to_numpy(zero_copy_only=False)[of["o"]]
    seen, fixed = take("o", ["bx", "by", "bz", "w"])[known], pc.fill_null(flat["c"].field("fixed"), False).to_numpy(zero_copy_only=False)
    some = _Scenes(of["o"][known], camera[known], landmark[known], seen[:, :3], seen[:, 3], of["c"], of["m"], fixed, len(batch))
    cams = take("c", _CAM)
    centre, matrix, spot, before, after = some.adjusted(cams[:, :3], cams[:, 3:].reshape(-1, 3, 3), take("m", _SPOT), outer, inner, huber, damping)
    told = {"c": dict(zip(_CAM, np.hstack([centre, matrix.reshape(-1, 9)]).T, strict=True)), "m": dict(zip(_SPOT, spot.T, strict=True))}
    lists = []
    for k in "cm":
        names = [f.name for f in flat[k].type]
        made = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(told[k][n])) if n in told[k] else flat[k].field(n) for n in names], names)
        lists.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(many[k])).astype(np.int32), made))
    none = np.bincount(of["o"][known], minlength=len(batch)) == 0
    return pa.RecordBatch.from_arrays([batch.column("scene"), *lists, *[pa.array(v, mask=none) for v in (before, after)]], ["scene", "c", "m", "before", "after"])


def _adjusted_small(observations: DataFrame, cameras: DataFrame, landmarks: DataFrame, outer: int, inner: int, huber: float, damping: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``adjust`` gives for scenes that a task can hold: each is gathered once, and a task solves many side by side."""
    cols = {"o": ["camera", "landmark", "bx", "by", "bz", "w"], "c": ["camera", *_CAM, "fixed"], "m": ["landmark", *_SPOT]}
    tables = {"o": observations, "c": cameras, "m": landmarks}
    tagged = [df.select("scene", F.struct(*cols[k]).alias(k)) for k, df in tables.items()]
    met = tagged[0].unionByName(tagged[1], True).unionByName(tagged[2], True).groupBy("scene").agg(*[F.collect_list(k).alias(k) for k in "ocm"])
    kind = lambda k: f"array<struct<{', '.join(f'{n}: {t}' for n, t in tables[k].select(*cols[k]).dtypes)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.list_value_length(batch.column("o")).to_numpy(zero_copy_only=False)) // 16384
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(batch)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i < j:
                    yield _solved(batch.slice(i, j - i), outer, inner, huber, damping)

    done = written(met.mapInArrow(run, f"scene {dict(observations.dtypes)['scene']}, c {kind('c')}, m {kind('m')}, before double, after double"))
    return done.select("scene", F.inline("c")), done.select("scene", F.inline("m")), done.where("before IS NOT NULL").select("scene", "before", "after")


def adjust(observations: DataFrame, cameras: DataFrame, landmarks: DataFrame, outer: int = 4, inner: int = 6, huber: float = math.radians(1.0), damping: float = 1e-4, rows: int = 8192) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, landmarks, scenes) after ``outer`` damped steps; scenes are (scene, before, after), the robust costs.

    A scene takes a step only if its cost falls, and is damped less then and more otherwise.  Observations without their
    camera or landmark take no part; what none of them sees stays where it is.  Scenes of up to ``rows`` observations, cameras
    and landmarks are solved in one pass, larger ones by rounds over tables.
    """
    given = [written(df) for df in (observations, cameras, landmarks)]
    told = [df.select("scene") for df in given]
    large = written(told[0].unionByName(told[1]).unionByName(told[2]).groupBy("scene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select("scene"))
    if large.isEmpty():
        return _adjusted_small(*given, outer, inner, huber, damping)
    apart = lambda how: [df.join(large, df["scene"].eqNullSafe(large["scene"]), how) for df in given]
    both = zip(_adjusted_small(*apart("left_anti"), outer, inner, huber, damping), _adjusted_large(*apart("left_semi"), outer, inner, huber, damping), strict=True)
    return tuple(a.unionByName(b) for a, b in both)


def _adjusted_large(observations: DataFrame, cameras: DataFrame, landmarks: DataFrame, outer: int, inner: int, huber: float, damping: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``adjust`` gives for scenes of any size, by sums over tables."""
    observations, cameras, landmarks = (written(df) for df in (observations, cameras, landmarks))
    of = lambda lin, name: lin.groupBy("scene").agg(F.sum("cost").alias(name))
    lin = written(linearised(observations, cameras, landmarks, huber))
    scenes = written(of(lin, "cost").select("scene", F.col("cost").alias("before"), "cost", F.lit(damping).alias("damping")))
    for _ in range(outer):
        steps, marks = camera_steps(lin, scenes.select("scene", "damping"), inner)
        jl, jc, e = F.col("jl"), F.col("jc"), F.col("e")
        after = [e[k] + _times(jc, F.col("x"), 6)[k] for k in range(2)]
        shift = lin.join(steps, _CAMERA).groupBy(*_LANDMARK).agg(_sums(_across(jl, after, 3)).alias("g")).join(marks.drop("g"), _LANDMARK).select(*_LANDMARK, _apply(F.col("inverse"), F.col("g")).alias("s"))
        tried = written(_moved(cameras, steps))
        spots = written(landmarks.join(shift, _LANDMARK, "left").select(*_LANDMARK, *[(F.col(c) - F.coalesce(F.col("s")[k], F.lit(0.0))).alias(c) for k, c in enumerate("xyz")]))
        new = written(linearised(observations, tried, spots, huber))
        better = F.col("new") < F.col("cost")
        judged = written(scenes.join(of(new, "new"), "scene").select("scene", "before", F.when(better, F.col("new")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("damping") / 10).otherwise(F.col("damping") * 10).alias("damping"), better.alias("better")))
        taken, kept_ = judged.where("better").select("scene"), judged.where("NOT better").select("scene")
        choose = lambda a, b: written(a.join(kept_, "scene", "left_semi").unionByName(b.join(taken, "scene", "left_semi")).unionByName(a.join(judged, "scene", "left_anti")))  # noqa: B023, E731
        cameras, landmarks = choose(cameras, tried), choose(landmarks, spots)
        lin, scenes = choose(lin, new), judged.drop("better")
    return cameras, landmarks, scenes.select("scene", "before", F.col("cost").alias("after"))
