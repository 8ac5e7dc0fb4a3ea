"""Relative poses of panorama pairs from matched bearings, with a third and more of them wrong.

Matches are rows (pair, id, ax, ay, az, bx, by, bz); all pairs of a table are solved in the same jobs.  Trials draw five
matches by hashes of their ids; a polynomial solver turns batches of samples into essential matrices; every chunk of
matches scores all hypotheses of its pair, and the scores, the counts in front of both views and the normal equations of the
refinement are sums over chunks.  A pair of one chunk has its sums in one pass over it, without rounds; of a larger one no
task holds more than a chunk, and nothing is collected.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.lineage import checkpointed

#: Exponents of x, y, z (the fourth coefficient is one): the ten that are eliminated, then x, y and one by falling powers of z.
_POWERS = [(3, 0, 0), (0, 3, 0), (2, 1, 0), (1, 2, 0), (2, 0, 1), (2, 0, 0), (0, 2, 1), (0, 2, 0), (1, 1, 1), (1, 1, 0)]
_POWERS += [(1, 0, 2), (1, 0, 1), (1, 0, 0), (0, 1, 2), (0, 1, 1), (0, 1, 0), (0, 0, 3), (0, 0, 2), (0, 0, 1), (0, 0, 0)]
_PLACE = {p: n for n, p in enumerate(_POWERS)}
#: Adds up products of three of the coefficients x, y, z, 1 by their exponents.
_GATHER = np.zeros((64, 20))
for _n, _m in enumerate(itertools.product(range(4), repeat=3)):
    _GATHER[_n, _PLACE[tuple(sum(c == a for c in _m) for a in range(3))]] = 1.0
_MIXED = np.linalg.qr(np.random.default_rng(5).normal(size=(4, 4)))[0]
MATCH = ["ax", "ay", "az", "bx", "by", "bz"]
_E, _R, _T = [f"e{i}{j}" for i in range(3) for j in range(3)], [f"r{i}{j}" for i in range(3) for j in range(3)], ["tx", "ty", "tz"]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def _times(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products of polynomials, coefficients along the last axis."""
    out = np.zeros((len(p), p.shape[1] + q.shape[1] - 1))
    for k in range(q.shape[1]):
        out[:, k : k + p.shape[1]] += p * q[:, k : k + 1]
    return out


def _minor(p: list[np.ndarray], q: list[np.ndarray], i: int, j: int) -> np.ndarray:
    return _times(p[i], q[j]) - _times(p[j], q[i])


def five_point(a: np.ndarray, b: np.ndarray, worst: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(sample, essential) of all real solutions for samples of five bearings: arrays of shape (n, 5, 3) each.

    Essential matrices have norm one and hold the five matches.  Solutions that miss the constraints by over ``worst``, and
    samples that don't fix a finite number of solutions, are left out.  The ten constraints leave a polynomial of degree ten
    in one of the coefficients.
    """
    n = len(a)
    if not n:
        return np.zeros(0, int), np.zeros((0, 3, 3))
    rows = (b[..., :, None] * a[..., None, :]).reshape(n, 5, 9)
    q, size = np.linalg.qr(rows.transpose(0, 2, 1), mode="complete")
    fine = np.abs(np.diagonal(size, axis1=1, axis2=2)).min(axis=1) > 1e-9
    basis = (_MIXED @ q[:, :, 5:].transpose(0, 2, 1)).reshape(n, 4, 3, 3)  # no coordinate is special
    flat = basis.reshape(n, 12, 3)
    square = (flat @ flat.transpose(0, 2, 1)).reshape(n, 4, 3, 4, 3).transpose(0, 2, 1, 3, 4)  # i, m, p, l
    cubic = 2 * (square.reshape(n, 48, 3) @ basis.transpose(0, 2, 1, 3).reshape(n, 3, 12)).reshape(n, 3, 4, 4, 4, 3).transpose(0, 1, 5, 2, 3, 4)  # i, j, m, p, q
    trace = sum(square[:, i, :, :, i] for i in range(3)).reshape(n, 1, 16, 1)
    cubic = cubic.reshape(n, 9, 64) - (trace * basis.reshape(n, 4, 9).transpose(0, 2, 1)[:, :, None, :]).reshape(n, 9, 64)
    r0, r1, r2 = (basis[:, :, i] for i in range(3))
    normal = np.stack([r1[:, :, None, i] * r2[:, None, :, j] - r1[:, :, None, j] * r2[:, None, :, i] for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)
    det = (r0 @ normal.reshape(n, 3, 16)).reshape(n, 1, 64)
    system = (np.concatenate([cubic, det], axis=1).reshape(-1, 64) @ _GATHER).reshape(n, 10, 20)
    fine &= np.linalg.slogdet(system[:, :, :10])[1] > -200
    left = np.where(fine[:, None, None], system[:, :, :10], np.eye(10))
    rest = np.linalg.solve(left, system[:, :, 10:])
    lines = []
    for high, low in ((4, 5), (6, 7), (8, 9)):  # the one without z, times z, is taken from the one with z
        e, f = rest[:, high], rest[:, low]
        own = []
        for at, many in ((0, 3), (3, 3), (6, 4)):
            p = np.zeros((n, many + 1))
            p[:, 1:] += e[:, at : at + many]
            p[:, :-1] -= f[:, at : at + many]
            own.append(p)
        lines.append(own)
    whole = sum(_times(_minor(lines[0], lines[1], i, j), lines[2][k]) for i, j, k in ((1, 2, 0), (2, 0, 1), (0, 1, 2)))
    fine &= np.isfinite(whole).all(axis=1) & (np.abs(whole[:, 0]) > 1e-14 * np.abs(whole).max(axis=1))
    whole = np.where(fine[:, None], whole, np.eye(1, 11))
    companion = np.zeros((n, 10, 10))
    companion[:, 0] = -whole[:, 1:] / whole[:, :1]
    companion[:, np.arange(1, 10), np.arange(9)] = 1
    values = np.linalg.eigvals(companion)
    sample, k = np.nonzero(fine[:, None] & (np.abs(values.imag) < 1e-6 * (1 + np.abs(values))))
    z, p = values[sample, k].real, whole[sample]
    with np.errstate(all="ignore"):
        for _ in range(2):
            value, slope = p[:, 0], 0.0
            for c in range(1, 11):
                value, slope = value * z + p[:, c], slope * z + value
            step = value / slope
            z = np.where(np.abs(step) < 1e-3 * (1 + np.abs(z)), z - step, z)
        powers = np.stack([z**4, z**3, z**2, z, np.ones_like(z)], axis=1)
        line = np.stack([np.stack([(c[sample] * powers[:, -c.shape[1] :]).sum(1) for c in own], axis=1) for own in lines], axis=1)
        line /= np.linalg.norm(line, axis=2, keepdims=True)
        null = np.stack([np.cross(line[:, i], line[:, j]) for i, j in ((0, 1), (1, 2), (2, 0))], axis=1)
        null = null[np.arange(len(z)), np.linalg.norm(null, axis=2).argmax(axis=1)]
        weights = np.concatenate([null[:, :2], z[:, None] * null[:, 2:], null[:, 2:]], axis=1)
        found = (weights[:, None, :] @ basis.reshape(n, 4, 9)[sample]).reshape(-1, 3, 3)
        found /= np.linalg.norm(found, axis=(1, 2), keepdims=True)
        both = found @ found.transpose(0, 2, 1)
        off = np.linalg.norm(2 * both @ found - np.trace(both, axis1=1, axis2=2)[:, None, None] * found, axis=(1, 2))
        good = off <= worst
    return sample[good], found[good]


def sampson(essential: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Errors (hypotheses, matches) on the tangent planes of both bearings."""
    ea, eb = a @ essential.transpose(0, 2, 1), b @ essential
    value = np.einsum("kni,ni->kn", ea, b)
    slope = (ea**2).sum(-1) + (eb**2).sum(-1) - 2 * value**2
    return np.abs(value) / np.sqrt(np.maximum(slope, 1e-30))


def _six(a: np.ndarray) -> list[np.ndarray]:
    return [a[..., i, j] * (1 if i == j else 2) for i in range(3) for j in range(i, 3)]


def costs(essential: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Sums of squared errors, each at most the square of ``threshold``, of every hypothesis; errors are forms in products of bearings."""
    pairs = (b[:, :, None] * a[:, None, :]).reshape(-1, 9).T
    own = np.stack([c[:, i] * c[:, j] for c in (a, b) for i in range(3) for j in range(i, 3)])
    turned = essential.transpose(0, 2, 1)
    forms = np.stack([*_six(turned @ essential), *_six(essential @ turned)], axis=1)
    flat, out, step = essential.reshape(-1, 9), np.empty(len(essential)), max(1, 32768 // max(1, len(a)))
    for k in range(0, len(essential), step):
        squared = flat[k : k + step] @ pairs
        squared *= squared
        slope = forms[k : k + step] @ own
        slope -= 2 * squared
        squared /= np.maximum(slope, 1e-30, out=slope)
        out[k : k + step] = np.minimum(squared, threshold * threshold, out=squared).sum(1)
    return out


def candidates(essential: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (rotation, direction) of an essential matrix; b = rotation a + direction."""
    u, _, vt = np.linalg.svd(essential)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    turn = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    return [(u @ w @ vt, s * u[:, 2]) for w in (turn, turn.T) for s in (1, -1)]


def in_front(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether both depths of each match are positive: depth_b b = depth_a (r a) + t at least squares."""
    ra = a @ r.T
    c = (ra * b).sum(1)
    flat = np.maximum(1 - c * c, 1e-15)
    at, bt = ra @ t, b @ t
    return ((bt * c - at) / flat > 0) & ((bt - at * c) / flat > 0)


def chunks(matches: DataFrame, rows: int = 2048) -> DataFrame:
    """(pair, chunk, m): about ``rows`` matches of a pair in each, dealt by their id."""
    return _dealt(matches.withColumn("ok", F.lit(True)), matches.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts")))


def _dealt(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    name = F.xxhash64("id")
    dealt = matches.join(sizes.hint("shuffle_hash"), "pair").select("pair", F.pmod(name, F.col("parts")).alias("chunk"), F.when(F.col("ok"), F.struct(name.alias("h"), *MATCH)).alias("m"))
    return dealt.groupBy("pair", "chunk").agg(F.collect_list("m").alias("m"))


def _lists(column: pa.ListArray, names: list[str]) -> list[np.ndarray]:
    """The structs of each list as rows of an array."""
    at, held = column.offsets.to_numpy(), column.values
    made = np.stack([held.field(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
    return [made[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _draws(name: np.ndarray, trials: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash), arrays (trials, 5 or fewer): the matches with the least hashes in each trial, those first."""
    with np.errstate(over="ignore"):
        h = name.astype(np.uint64) ^ ((np.arange(trials, dtype=np.uint64)[:, None] + np.uint64(trials * seed + 1)) * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        h = (h ^ (h >> np.uint64(31))) >> np.uint64(1)
    least = np.argpartition(h, 4, axis=1)[:, :5] if h.shape[1] > 5 else np.broadcast_to(np.arange(h.shape[1]), h.shape)
    least = np.take_along_axis(least, np.lexsort((name[least], np.take_along_axis(h, least, 1))), 1)
    return least, np.take_along_axis(h, least, 1).astype(np.int64)


def _named(column: pa.ListArray) -> list[np.ndarray]:
    at, names = column.offsets.to_numpy(), column.values.field("h").to_numpy(zero_copy_only=False)
    return [names[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def samples(chunked: DataFrame, kind: str, trials: int, seed: int) -> DataFrame:
    """(pair, trial, m): five matches for each trial of each pair, those with the least hashes; a chunk tells its own five."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (name, m) in enumerate(zip(_named(batch.column("m")), _lists(batch.column("m"), MATCH), strict=True)):
                place, h = _draws(name, trials, seed)
                trial, each = np.repeat(np.arange(trials, dtype=np.int32), place.shape[1]), place.ravel()
                told = [batch.column("pair").take(pa.array(np.full(len(each), k))), pa.array(trial), pa.array(h.ravel()), pa.array(name[each]), *[pa.array(m[each, c]) for c in range(6)]]
                yield pa.RecordBatch.from_arrays(told, ["pair", "trial", "h", "id", *MATCH])

    drawn = chunked.mapInArrow(run, f"pair {kind}, trial int, h long, id long, {_doubles(MATCH)}")
    least = drawn.withColumn("k", F.row_number().over(Window.partitionBy("pair", "trial").orderBy("h", "id"))).where("k <= 5")
    five = F.sort_array(F.collect_list(F.struct("h", "id", *MATCH))).alias("m")
    return least.groupBy("pair", "trial").agg(five).where("size(m) = 5")


def hypotheses(drawn: DataFrame, kind: str) -> DataFrame:
    """(pair, trial, solution, e00 .. e22) of all samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                both = np.array(_lists(part.column("m"), MATCH))
                sample, found = five_point(both[..., :3], both[..., 3:])
                solution = np.array([k for _, g in itertools.groupby(sample) for k, _ in enumerate(g)], dtype=np.int32)
                own = [part.column(n).take(pa.array(sample)) for n in ("pair", "trial")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(solution), *[pa.array(c) for c in found.reshape(-1, 9).T.copy()]], ["pair", "trial", "solution", *_E])

    return drawn.mapInArrow(run, f"pair {kind}, trial int, solution int, {_doubles(_E)}")


def _rows_of(batch: pa.RecordBatch, pairs: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of doubles under the names of their pairs."""
    made = np.array(rows, dtype=float).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([batch.column("pair").take(pa.array(pairs, pa.int64())), *[pa.array(c) for c in made.T.copy()]], ["pair", *names])


def _by_chunk(met: DataFrame, kind: str, names: list[str], work: Callable[[dict, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """What ``work(row, a, b)`` makes of every chunk, as rows of (pair, names..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = batch.drop_columns([n for n in ("pair", "m", "h") if n in batch.schema.names]).to_pylist()
            if "h" in batch.schema.names:
                told = [row | {"h": h} for row, h in zip(told, _lists(batch.column("h"), _E), strict=True)]
            made = [(k, x) for k, (row, m) in enumerate(zip(told, _lists(batch.column("m"), MATCH), strict=True)) for x in work(row, m[:, :3], m[:, 3:])]
            yield _rows_of(batch, [k for k, _ in made], [x for _, x in made], names)

    return met.mapInArrow(run, f"pair {kind}, {_doubles(names)}")


def score(chunked: DataFrame, found: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(pair, e00 .. e22): the hypothesis with the least truncated squared error over all matches, then the first."""
    told = F.sort_array(F.collect_list(F.struct("trial", "solution", *_E))).alias("h")
    held = found.groupBy("pair").agg(told)  # at most ten a trial

    def work(row: dict, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        return list(enumerate(costs(row["h"].reshape(-1, 3, 3), a, b, threshold).tolist()))

    sums = _by_chunk(chunked.join(held, "pair"), kind, ["k", "cost"], work).groupBy("pair", "k").agg(F.sum("cost").alias("cost"))
    best = sums.groupBy("pair").agg(F.min_by(F.col("k"), F.struct(F.round("cost", 12), F.col("k"))).cast("int").alias("k"))
    return best.join(held, "pair").select("pair", F.get("h", F.col("k")).alias("h")).select("pair", *[F.col(f"h.{n}").alias(n) for n in _E])


def _turns(e: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> list[tuple]:
    """(k, matches in front, r, t) of the four poses of an essential matrix."""
    good = sampson(e[None], a, b)[0] <= threshold
    return [(k, float(in_front(r, t, a[good], b[good]).sum()), r, t) for k, (r, t) in enumerate(candidates(e))]


def oriented(chunked: DataFrame, best: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(pair, r00 .. r22, tx, ty, tz): of the four poses of each essential matrix the one with most inliers in front."""

    def work(row: dict, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        e = np.array([row[n] for n in _E]).reshape(3, 3)
        return [(k, front, *r.ravel(), *t) for k, front, r, t in _turns(e, a, b, threshold)]

    counted = _by_chunk(chunked.join(best, "pair"), kind, ["k", "front", *_R, *_T], work)
    each = counted.groupBy("pair", "k").agg(F.sum("front").alias("front"), *[F.min(n).alias(n) for n in [*_R, *_T]])
    top = F.max_by(F.struct(*_R, *_T), F.struct("front", -F.col("k"))).alias("p")
    return each.groupBy("pair").agg(top).select("pair", "p.*")


def _skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def _turned(v: np.ndarray) -> np.ndarray:
    """The rotation of a rotation vector."""
    angle = np.linalg.norm(v)
    k = _skew(v / angle) if angle > 0 else np.zeros((3, 3))
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def _beside(t: np.ndarray) -> np.ndarray:
    """Two directions at right angles to a third, as rows."""
    first = np.cross(t, np.eye(3)[np.abs(t).argmin()])
    first /= np.linalg.norm(first)
    return np.array([first, np.cross(t, first)])


_UPPER = np.triu_indices(5)
_SUMS = [f"h{i}{j}" for i in range(5) for j in range(i, 5)] + [f"g{i}" for i in range(5)] + ["inliers", "squared"]


def _normal_equations(r: np.ndarray, t: np.ndarray, gate: float, a: np.ndarray, b: np.ndarray) -> tuple:
    """Sums of a chunk for a step of the rotation vector and of the direction in its tangent plane."""
    e = _skew(t) @ r
    error = sampson(e[None], a, b)[0]
    good = error <= gate
    a, b = a[good], b[good]
    ra = a @ r.T
    ea, eb = a @ e.T, b @ e
    value = (ea * b).sum(1)
    size = np.sqrt(np.maximum((ea**2).sum(1) + (eb**2).sum(1) - 2 * value**2, 1e-30))
    # b . (t x (exp(v) r a)): in v it moves by (r a) x (b x t), in t by (r a) x b
    by_turn = np.cross(ra, np.cross(b, t))
    by_step = np.cross(ra, b) @ _beside(t).T
    j = np.hstack([by_turn, by_step]) / size[:, None]
    h, g = j.T @ j, j.T @ (value / size)
    return (*h[_UPPER], *g, float(good.sum()), float((error[good] ** 2).sum()))


def _stepped(r: np.ndarray, t: np.ndarray, gate: float, sums: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The pose after a Gauss-Newton step by its sums, and how far off the next step's matches may be."""
    inliers, squared = sums[20:]
    if inliers < 6:
        return r, t, gate
    h = np.zeros((5, 5))
    h[_UPPER] = sums[:15]
    h = h + h.T - np.diag(h.diagonal())
    move = np.clip(-np.linalg.lstsq(h, np.array(sums[15:20]), rcond=1e-12)[0], -0.2, 0.2)
    r, t = _turned(move[:3]) @ r, t + move[3:] @ _beside(t)
    return r, t / np.linalg.norm(t), min(threshold, max(3 * math.sqrt(squared / inliers), 1e-6))


def refined(chunked: DataFrame, poses: DataFrame, kind: str, threshold: float, rounds: int) -> DataFrame:
    """The poses after Gauss-Newton steps on their inliers, with ``inliers`` and ``rms``; normal equations are sums over chunks.

    A step counts matches up to three times the last error that its pair had, and never beyond ``threshold``.
    """
    pose = [*_R, *_T, "gate"]

    def at(row: dict) -> tuple[np.ndarray, np.ndarray, float]:
        return np.array([row[n] for n in _R]).reshape(3, 3), np.array([row[n] for n in _T]), row["gate"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = [_stepped(*at(row), tuple(row[n] for n in _SUMS), threshold) for row in batch.drop_columns(["pair"]).to_pylist()]
            yield _rows_of(batch, list(range(len(batch))), [(*r.ravel(), *t, gate) for r, t, gate in moved], pose)

    def added(now: DataFrame) -> DataFrame:
        each = _by_chunk(chunked.join(now, "pair"), kind, _SUMS, lambda row, a, b: [_normal_equations(*at(row), a, b)])
        return now.join(each.groupBy("pair").agg(*[F.sum(n).alias(n) for n in _SUMS]), "pair")

    now = poses.select("pair", *_R, *_T, F.lit(threshold).alias("gate"))
    for _ in range(rounds):
        now = checkpointed(added(now).mapInArrow(step, f"pair {kind}, {_doubles(pose)}"))
    rms = F.when(F.col("inliers") > 0, F.sqrt(F.col("squared") / F.col("inliers")))
    return added(now.withColumn("gate", F.lit(threshold))).select("pair", *_R, *_T, F.col("inliers").cast("long").alias("inliers"), rms.alias("rms"))


def fitted(chunked: DataFrame, kind: str, threshold: float, trials: int, rounds: int, seed: int) -> DataFrame:
    """(pair, r00 .. r22, tx, ty, tz, inliers, rms) of pairs that have one chunk each: the same steps over the chunk at hand."""

    def fit(e: np.ndarray, m: np.ndarray) -> tuple:
        a, b = m[:, :3], m[:, 3:]
        turns = _turns(e[costs(e, a, b, threshold).round(12).argmin()], a, b, threshold)
        _, _, r, t = max(turns, key=lambda x: (x[1], -x[0]))
        gate = threshold
        for _ in range(rounds):
            r, t, gate = _stepped(r, t, gate, _normal_equations(r, t, gate, a, b), threshold)
        inliers, squared = _normal_equations(r, t, threshold, a, b)[20:]
        return (*r.ravel(), *t, inliers, squared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, held, made = _named(batch.column("m")), _lists(batch.column("m"), MATCH), []
            large = [k for k, name in enumerate(names) if len(name) >= 5]
            for some in itertools.batched(large, max(1, 512 // trials)):
                drawn = np.concatenate([held[k][_draws(names[k], trials, seed)[0]] for k in some])
                sample, e = five_point(drawn[..., :3], drawn[..., 3:])
                own = np.split(e, np.searchsorted(sample, trials * np.arange(1, len(some))))
                made += [(k, fit(x, held[k])) for k, x in zip(some, own, strict=True) if len(x)]
            yield _rows_of(batch, [k for k, _ in made], [x for _, x in made], [*_R, *_T, "inliers", "squared"])

    found = chunked.mapInArrow(run, f"pair {kind}, {_doubles([*_R, *_T, 'inliers', 'squared'])}")
    return found.select("pair", *_R, *_T, F.col("inliers").cast("long").alias("inliers"), F.when(F.col("inliers") > 0, F.sqrt(F.col("squared") / F.col("inliers"))).alias("rms"))


def relative_poses(matches: DataFrame, threshold: float = math.radians(1.0), trials: int = 128, rounds: int = 5, seed: int = 0, rows: int = 2048) -> DataFrame:
    """(pair, n, inliers, rms, accepted, r00 .. r22, tx, ty, tz) of every pair: b ~ r a + t / depth, t of length one.

    Bearings are made unit; matches with a null, zero or non-finite bearing take no part.  A pair of under five usable
    matches, or without a solution, has a null pose and is not accepted; nor is one of under eight inliers or a tenth of n.
    """
    kind = dict(matches.dtypes)["pair"]
    size = lambda s: F.sqrt(sum((F.col(f"{s}{k}") * F.col(f"{s}{k}") for k in "xyz"), F.lit(0.0))).alias(f"s{s}")
    sized = matches.select("pair", "id", *MATCH, size("a"), size("b"))
    usable = (F.col("sa") > 0) & (F.col("sb") > 0) & (F.col("sa") < math.inf) & (F.col("sb") < math.inf)
    # a column, as a filter would be pushed down and spell out what the bearings are made of
    unit = sized.select("pair", "id", *[F.try_divide(f"{s}{k}", f"s{s}").alias(f"{s}{k}") for s in "ab" for k in "xyz"], usable.alias("ok"))
    counted = checkpointed(sized.groupBy("pair").agg(F.count_if(usable).alias("n")))
    sizes = counted.select("pair", F.ceil(F.col("n") / rows).alias("parts"))
    done = fitted(_dealt(unit, sizes.where("parts = 1")), kind, threshold, trials, rounds, seed)
    if not sizes.where("parts > 1").isEmpty():
        chunked = checkpointed(_dealt(unit, sizes.where("parts > 1")))
        found = checkpointed(hypotheses(samples(chunked, kind, trials, seed), kind))
        posed = checkpointed(oriented(chunked, score(chunked, found, kind, threshold), kind, threshold))
        done = done.unionByName(refined(chunked, posed, kind, threshold, rounds))
    met = counted.join(done, "pair", "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)))
    return met.select("pair", "n", "inliers", "rms", ((F.col("inliers") >= 8) & (F.col("inliers") >= 0.1 * F.col("n"))).alias("accepted"), *_R, *_T)
