"""Incremental tracking of panorama frames against a map of keyframes, as a stream with bounded state and as a batch.

A frame is (session, frame, ts, features): ids with their bearings, already matched by id.  It is tracked against the last
keyframes of its session's map; if none of them fits, all others are asked (relocalisation); if none fits, it is lost.  A
frame that has moved on far enough becomes a keyframe.  The map is state: at most ``most_keyframes`` of them, the oldest go;
a timer in event time forgets a session that has been idle.  The batch runs the same steps with the map in memory, of many
sessions at once: a step asks for its pairs of frames, and what all sessions of a task ask for is answered together.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Generator, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import pose as P
from ..operators.robust import kabsch

OUT = "session long, frame long, state string, keyframe boolean, reference long, matches int, inliers int, parallax double, yaw double, keyframes int, reason string"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_KEYFRAME = "ids array<bigint>, bearings array<double>, pose array<double>"


class Options(NamedTuple):
    least_features: int = 12
    least_matches: int = 10
    least_inliers: int = 8
    threshold: float = math.radians(0.5)
    trials: int = 64
    window: int = 3
    least_parallax: float = math.radians(3.0)
    most_seconds: float = 600.0
    least_overlap: float = 0.5
    most_keyframes: int = 20
    idle_seconds: float = 3600.0
    late: str = "10 minutes"


def relative(a: np.ndarray, b: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(rotation, direction, inliers, parallax) between two frames' matched bearings; without parallax the direction is zero."""
    turn = kabsch(a, b)
    for _ in range(3):
        off = np.arccos(np.clip(((a @ turn.T) * b).sum(1), -1, 1))
        good = off <= max(o.threshold, float(np.median(off)))
        if good.sum() < 3:
            break
        turn = kabsch(a[good], b[good])
    off = np.arccos(np.clip(((a @ turn.T) * b).sum(1), -1, 1))
    best = (turn, np.zeros(3), int((off <= o.threshold).sum()), float(np.median(off[off <= o.threshold])) if (off <= o.threshold).any() else 0.0)
    if best[2] >= 0.9 * len(a) or len(a) < 8:
        return best
    rng = np.random.default_rng(len(a))
    drawn = np.array([rng.choice(len(a), 5, replace=False) for _ in range(o.trials)])
    _, found = P.five_point(a[drawn], b[drawn])
    if not len(found):
        return best
    errors = P.sampson(found, a, b)
    e = found[np.minimum(errors, o.threshold).__pow__(2).sum(1).argmin()]
    good = P.sampson(e[None], a, b)[0] <= o.threshold
    if good.sum() <= best[2] or good.sum() < 6:
        return best
    r, t = max(P.candidates(e), key=lambda c: P.in_front(*c, a[good], b[good]).sum())
    moved = np.arccos(np.clip(((a[good] @ r.T) * b[good]).sum(1), -1, 1))
    return r, t, int(good.sum()), float(np.median(moved))


class Seen(NamedTuple):
    """The features of a frame: ids in order, each once, and their bearings."""

    ids: np.ndarray
    bearings: np.ndarray


class Keyframe(NamedTuple):
    seen: Seen
    pose: np.ndarray


Pairs = list[tuple[Keyframe, Seen]]
Steps = Generator[Pairs, list[tuple | None], Any]


def _matched(pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, size): bearings of the features that both frames of a pair have, pair by pair, and how many each has."""
    sides = [k.seen for k, _ in pairs], [seen for _, seen in pairs]
    ids = [np.concatenate([s.ids for s in side]) for side in sides]
    low, high = min((int(i.min()) for i in ids if len(i)), default=0), max((int(i.max()) for i in ids if len(i)), default=0)
    span = high - low + 1
    if span * len(pairs) < 2**62:
        ids = [i - low for i in ids]
    else:
        named, place = np.unique(np.concatenate(ids), return_inverse=True)
        ids, span = np.split(place, [len(ids[0])]), len(named)
    keys = [np.repeat(np.arange(len(pairs)), [len(s.ids) for s in side]) * span + i for side, i in zip(sides, ids, strict=True)]
    at = np.searchsorted(keys[1], keys[0])
    both = np.flatnonzero(np.append(keys[1], -1)[at] == keys[0])
    a, b = (np.concatenate([s.bearings for s in side]) for side in sides)
    return a[both], b[at[both]], np.bincount(keys[0][both] // span, minlength=len(pairs))


def relatives(pairs: Pairs, o: Options) -> list[tuple | None]:
    """(inliers, matches, parallax, pose, yaw) of the frame of each pair by its keyframe, or None if the pair isn't admitted.

    It is what ``relative`` tells of each pair.  Where the first rotation fits every match, further rounds would not change
    it: those pairs are done together, in rows of like numbers of matches.  The others go one by one.
    """
    out: list[tuple | None] = [None] * len(pairs)
    if not pairs:
        return out
    a, b, size = _matched(pairs)
    start, wide = np.cumsum(size) - size, np.where(size >= o.least_matches, -(-size // 8) * 8, 0)
    for width in np.unique(wide[wide > 0]):
        own = np.flatnonzero(wide == width)
        n, place, each = size[own], np.arange(width), np.arange(len(own))
        held = place < n[:, None]
        rows = np.where(held, start[own, None] + place, 0)
        x, y = (m[rows] * held[:, :, None] for m in (a, b))
        u, _, vt = np.linalg.svd(y.transpose(0, 2, 1) @ x)
        u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
        turn = u @ vt
        near = np.sort(np.where(held, ((x @ turn.transpose(0, 2, 1)) * y).sum(2), 2.0), axis=1)
        far, one, other = (np.arccos(np.clip(near[each, k], -1, 1)) for k in (0, (n - 1) // 2, n // 2))
        inliers, parallax = n.copy(), (one + other) / 2
        for k in np.flatnonzero(~(far <= o.threshold)):
            turn[k], _, inliers[k], parallax[k] = relative(x[k, : n[k]], y[k, : n[k]], o)
        pose = turn @ np.array([pairs[k][0].pose for k in own])
        yaw = np.arctan2(pose[:, 2, 0], pose[:, 2, 2])
        told = zip(inliers.tolist(), n.tolist(), parallax.tolist(), pose, yaw.tolist(), strict=True)
        for k, found in zip(own.tolist(), told, strict=True):
            out[k] = found if found[0] >= o.least_inliers else None
    return out


class Map:
    """Keyframes by number, with what has been seen last; loads and stores plain values."""

    def __init__(self, keyframes: dict[int, tuple], last: tuple | None) -> None:
        self.keyframes, self.gone, self.new = {k: Keyframe(Seen(np.array(ids, np.int64), np.array(b, float).reshape(-1, 3)), np.array(pose, float).reshape(3, 3)) for k, (ids, b, pose) in keyframes.items()}, set(), set()
        self.last_at, self.last_key, self.key_at = last or (-math.inf, None, -math.inf)

    def stored(self, number: int) -> tuple:
        k = self.keyframes[number]
        return k.seen.ids.tolist(), k.seen.bearings.ravel().tolist(), k.pose.ravel().tolist()

    def step(self, session: int, frame: int, at: float, seen: Seen, o: Options) -> Steps:
        """The output row of one frame, which may change the map; asks for pairs of a keyframe and the frame."""
        said = lambda state, key=False, ref=None, m=0, n=0, far=None, yaw=None, why="": (session, frame, state, key, ref, m, n, far, yaw, len(self.keyframes), why)
        if at <= self.last_at:
            return said("late", why="not after the last frame")
        if at - self.last_at > o.idle_seconds:  # what the timer does to a stream's state, whenever it fires
            self.gone |= set(self.keyframes)
            self.keyframes, self.last_key, self.key_at = {}, None, -math.inf
        self.last_at = at
        if len(seen.ids) < o.least_features:
            return said("lost", why="insufficient-features")
        if not self.keyframes:
            self._keep(at, seen, np.eye(3), o)
            return said("initializing", True, yaw=0.0, why="world-anchor-created")
        order = sorted(self.keyframes, reverse=True)
        for state, some in (("tracking", order[: o.window]), ("relocalized", order[o.window :])):
            found = (yield [(self.keyframes[k], seen) for k in some]) if some else []
            made = [(x[0], k, x) for k, x in zip(some, found, strict=True) if x]
            if made:
                inliers, key, (_, matches, far, world, yaw) = max(made)
                fresh = far >= o.least_parallax or at - self.key_at >= o.most_seconds or matches < o.least_overlap * len(seen.ids) or state == "relocalized"
                if fresh:
                    self._keep(at, seen, world, o)
                return said(state, fresh, key, matches, inliers, round(far, 6), round(yaw, 6))
        return said("lost", why="no-admitted-reference")

    def _keep(self, at: float, seen: Seen, world: np.ndarray, o: Options) -> None:
        number = 0 if self.last_key is None else self.last_key + 1
        self.keyframes[number] = Keyframe(seen, world)
        self.new.add(number)
        self.last_key, self.key_at = number, at
        while len(self.keyframes) > o.most_keyframes:
            old = min(self.keyframes)
            del self.keyframes[old]
            self.gone.add(old)


def _sent(lane: Steps, answer: list[tuple | None] | None) -> Pairs | None:
    """What a lane asks for next; None at its end."""
    try:
        return lane.send(answer)
    except StopIteration:
        return None


def _together(lanes: list[Steps], o: Options) -> None:
    """Runs steps of many sessions side by side; each waits only for what it has asked for."""
    asked = [(lane, pairs) for lane in lanes if (pairs := _sent(lane, None)) is not None]
    while asked:
        answers = iter(relatives([pair for _, pairs in asked for pair in pairs], o))
        asked = [(lane, more) for lane, pairs in asked if (more := _sent(lane, list(itertools.islice(answers, len(pairs))))) is not None]


def _lane(session: int, frames: list[tuple[int, float, Seen]], held: Map, o: Options, out: list[tuple]) -> Steps:
    for frame, at, seen in frames:
        out.append((yield from held.step(session, frame, at, seen, o)))


def listed(frames: pa.RecordBatch) -> list[Seen]:
    """What each frame's features hold: those without id take no part; of several with one id the last stands."""
    rows = frames.column("features")
    count = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(rows)
    of, ids = np.repeat(np.arange(len(count)), count), pc.struct_field(flat, "id")
    named = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bearings = np.stack([pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in "xyz"], axis=1)
    if not named.all():
        of, ids, bearings = of[named], ids[named], bearings[named]
    if not ((of[1:] > of[:-1]) | (ids[1:] > ids[:-1])).all():
        order = np.lexsort((ids, of))
        order = order[np.append((np.diff(of[order]) != 0) | (np.diff(ids[order]) != 0), True)]
        of, ids, bearings = of[order], ids[order], bearings[order]
    ends = np.searchsorted(of, np.arange(len(count) + 1)).tolist()
    return [Seen(ids[i:j], bearings[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _times(ts: pa.Array) -> np.ndarray:
    """Seconds; null is before all others."""
    return pc.fill_null(ts.cast(pa.timestamp("us", ts.type.tz)).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) / 1e6


def _rows(session: int, frames: pd.DataFrame, held: Map, o: Options) -> pd.DataFrame:
    frames = frames.assign(at=frames["ts"].astype("datetime64[us]").astype("int64") / 1e6).sort_values(["at", "frame"])
    feature = [{f["id"]: (f["x"], f["y"], f["z"]) for f in some if f["id"] is not None} for some in frames["features"]]
    seen = [Seen(np.array(ids := sorted(f), np.int64), np.array([f[i] for i in ids], float).reshape(-1, 3)) for f in feature]
    out: list[tuple] = []
    _together([_lane(session, list(zip(frames["frame"], frames["at"], seen, strict=True)), held, o, out)], o)
    return pd.DataFrame(out, columns=_NAMES).astype({"reference": "Int64", "parallax": "Float64", "yaw": "Float64"})


class Tracker(StatefulProcessor):
    """The map of each session as map state, its clock as value state, and a timer that forgets idle sessions."""

    def __init__(self, options: Options) -> None:
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keyframes = handle.getMapState("keyframes", "number int", _KEYFRAME)
        self.last = handle.getValueState("last", "at double, number int, key_at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored: dict[int, tuple] = {int(k[0]): (list(v[0]), list(v[1]), list(v[2])) for k, v in self.keyframes.iterator()}
        held = Map(dict(stored), tuple(self.last.get()) if self.last.exists() else None)
        out = _rows(key[0], pd.concat(list(rows)), held, self.options)
        for number in held.new & set(held.keyframes):
            self.keyframes.updateValue((number,), held.stored(number))
        for number in (held.gone & set(stored)) - set(held.keyframes):
            self.keyframes.removeKey((number,))
        if held.last_key is not None:
            self.last.update((held.last_at, held.last_key, held.key_at))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((held.last_at + self.options.idle_seconds) * 1000))
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.keyframes.clear()
        self.last.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def track(frames: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """A row for each frame of a stream (session, frame, ts, features); the session needs the RocksDB state store."""
    watched = frames.withWatermark("ts", options.late)
    return watched.groupBy("session").transformWithStateInPandas(Tracker(options), OUT, "Append", "EventTime")


#: Frames whose sessions run side by side in a task.
TOGETHER = 32768
_SCHEMA = pa.schema([("session", pa.int64()), ("frame", pa.int64()), ("state", pa.string()), ("keyframe", pa.bool_()), ("reference", pa.int64()), ("matches", pa.int32()), ("inliers", pa.int32()), ("parallax", pa.float64()), ("yaw", pa.float64()), ("keyframes", pa.int32()), ("reason", pa.string())])


def replay(frames: DataFrame, options: Options = Options(), features: Callable[[pa.RecordBatch], list[Seen]] = listed, together: int = TOGETHER) -> DataFrame:  # noqa: B008
    """The same rows from a batch; the frames of a session follow one another, so a task has a session's frames in order.

    A task holds ``together`` frames, a batch more, and the map of the session that goes on beyond them.  ``features`` tells
    what the frames of a batch have seen; where it makes that of other columns, only those are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[Any, Map] = None, Map({}, None)
        for part in _gathered(batches, together):
            sessions, lanes, outs = part.column("session").to_pylist(), [], []
            steps = list(zip(part.column("frame").to_pylist(), _times(part.column("ts")).tolist(), features(part), strict=True))
            starts = [k for k, s in enumerate(sessions) if k == 0 or s != sessions[k - 1]]
            for i, j in zip(starts, [*starts[1:], len(sessions)], strict=True):
                held = last[1] if i == 0 and last[0] == (sessions[0],) else Map({}, None)
                outs.append([])
                lanes.append(_lane(sessions[i], steps[i:j], held, options, outs[-1]))
                last = (sessions[i],), held
            _together(lanes, options)
            columns = zip(*[row for out in outs for row in out], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frames.repartition(tasks, "session").sortWithinPartitions("session", "ts", F.asc_nulls_last("frame"))
    return dealt.mapInArrow(run, OUT)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.concat_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.concat_batches(held)
