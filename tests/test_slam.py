"""Incremental tracking: the stream gives what the batch gives, its map stays bounded, lost sessions come back."""

import math
import tempfile

import numpy as np

from orbisight.operators import pose
from orbisight.streaming import slam

FRAMES = "session long, frame long, ts timestamp, features array<struct<id:bigint,x:double,y:double,z:double>>"


def landmarks(rng, n):
    return rng.normal(size=(n, 3)) * 4


def frame(spots, session, number, seconds, ids, yaw, centre=(0, 0, 0)):
    import datetime as dt

    r = pose._turned(np.array([0.0, -yaw, 0.0]))
    seen = (spots[ids] - np.array(centre)) @ r.T
    seen /= np.linalg.norm(seen, axis=1, keepdims=True)
    return session, number, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds), [(int(i), *map(float, b)) for i, b in zip(ids, seen)]


def world(session=1):
    """Turns over landmarks 0-130, a jump to unknown ones, few features, a return, and a step aside."""
    rng = np.random.default_rng(session)
    spots = landmarks(rng, 300)
    far = list(range(200, 240))
    plan = [(list(range(k * 10, k * 10 + 40)), 0.05 * k) for k in range(10)] + [(far, 0.0), (list(range(5)), 0.0), (list(range(0, 40)), 0.1)]
    rows = [frame(spots, session, k, 10 * k, ids, yaw) for k, (ids, yaw) in enumerate(plan)]
    rows.append(frame(spots, session, 13, 130, list(range(0, 40)), 0.15, (0.5, 0.1, 0.2)))
    return [*rows, (session, 14, rows[2][2], rows[2][3])]


def told(df):
    return {(r.session, r.frame): r for r in df.collect()}


def test_replay(spark):
    got = told(slam.replay(spark.createDataFrame(world()[::-1], FRAMES), slam.Options(window=2)))
    states = [got[1, k].state for k in range(14)]
    assert states[0] == "initializing" and set(states[1:10]) == {"tracking"} and states[10] == "lost" and states[11] == "lost"
    assert got[1, 10].reason == "no-admitted-reference" and got[1, 11].reason == "insufficient-features"
    assert states[12] == "relocalized" and got[1, 12].keyframe and states[13] == "tracking" and got[1, 13].parallax > 0
    assert all(abs(got[1, k].yaw - 0.05 * k) < 1e-4 for k in range(1, 10)) and abs(got[1, 12].yaw - 0.1) < 1e-4
    assert abs(got[1, 13].yaw - 0.15) < 0.03 and got[1, 13].keyframe
    late = told(slam.replay(spark.createDataFrame([*world(), (1, 15, world()[13][2], world()[13][3])], FRAMES)))
    assert late[1, 15].state == "late" or late[1, 13].state == "late"


def test_stream_equals_replay(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    options = slam.Options(window=2, most_keyframes=4)
    rows = [r for s in (1, 2) for r in world(s)[:-1]]
    spots = landmarks(np.random.default_rng(1), 300)
    rows += [frame(spots, s, 20 + k, 3 * 3600 + 60 * k, list(range(40)), 0.1 * k) for s in (1, 3) for k in range(2)]
    folder = tempfile.mkdtemp(prefix="orbisight-")
    for part in range(3):  # frames in order over three batches, one session a batch longer than the other
        some = [r for r in rows if (r[1] - r[0]) // 5 == part or (part == 0 and r[1] < r[0]) or (part == 2 and (r[1] - r[0]) // 5 > 2)]
        spark.createDataFrame(some, FRAMES).coalesce(1).write.parquet(f"{folder}/in/{part}")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = slam.track(stream, options).writeStream.format("memory").queryName("slam_rows").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got, want = told(spark.table("slam_rows")), told(slam.replay(spark.createDataFrame(rows, FRAMES), options))
    assert got.keys() == want.keys() and len(got) == 32
    assert all(got[k] == want[k] for k in got), [(got[k], want[k]) for k in got if got[k] != want[k]][:2]
    assert (got[1, 20].state, got[1, 20].keyframes, got[1, 21].state) == ("initializing", 1, "tracking")  # idle sessions are forgotten
    assert max(r.keyframes for r in got.values()) == 4
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3


def test_pairs_of_frames():
    rng = np.random.default_rng(5)
    spots = landmarks(rng, 40)
    a = spots / np.linalg.norm(spots, axis=1, keepdims=True)
    r = pose._turned(np.array([0.1, 0.4, -0.2]))
    b = (spots - [0.4, 0.1, -0.3]) @ r.T
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b[:8] = rng.normal(size=(8, 3))
    b[:8] /= np.linalg.norm(b[:8], axis=1, keepdims=True)
    turn, t, inliers, far = slam.relative(a, b, slam.Options())
    assert inliers >= 31 and math.acos(min(1.0, (np.trace(turn @ r.T) - 1) / 2)) < 0.02 and far > 0.02 and np.linalg.norm(t) > 0.9
    turn, t, inliers, _ = slam.relative(a, a @ r.T, slam.Options())
    assert inliers == 40 and np.allclose(turn, r) and not t.any()


def test_sessions_run_side_by_side(spark, monkeypatch):
    """Frames of all sessions are answered in as many rounds as one session needs; cut anywhere, sessions give the same rows."""
    rows = [r for s in range(1, 25) for r in world(s)]
    frames = spark.createDataFrame(rows, FRAMES)
    whole = told(slam.replay(frames, slam.Options(window=2)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    cut = told(slam.replay(frames, slam.Options(window=2), together=4))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == cut and len(whole) == len(rows)
    rounds, answer = [], slam.relatives
    monkeypatch.setattr(slam, "relatives", lambda pairs, o: rounds.append(len(pairs)) or answer(pairs, o))
    lanes, out = [], []
    for s in range(1, 25):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[2])
        seen = [slam.Seen(np.array([f[0] for f in r[3]]), np.array([f[1:] for f in r[3]])) for r in own]
        lanes.append(slam._lane(s, [(r[1], r[2].timestamp(), x) for r, x in zip(own, seen, strict=True)], slam.Map({}, None), slam.Options(window=2), out))
    slam._together(lanes, slam.Options(window=2))
    assert len(out) == len(rows) and len([n for n in rounds if n]) <= 2 * 15 and max(rounds) >= 2 * 24


def test_pairs_answered_together():
    """Pairs of any sizes, some with wrong matches, some with ids far apart, give what each gives alone."""
    rng, o = np.random.default_rng(7), slam.Options()
    pairs = []
    for k in range(40):
        n = int(rng.integers(0, 60))
        ids = np.sort(rng.choice(100, n, replace=False)).astype(np.int64) * (2**55 if k == 3 else 1)
        a = rng.normal(size=(n, 3))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = a @ pose._turned(rng.normal(size=3)).T
        b[: n // 4 if k % 3 == 0 else 0] *= -1
        keep = rng.random(n) < 0.9
        pairs.append((slam.Keyframe(slam.Seen(ids, a), pose._turned(rng.normal(size=3))), slam.Seen(ids[keep], b[keep])))
    for (key, seen), got in zip(pairs, slam.relatives(pairs, o), strict=True):
        both = np.isin(key.seen.ids, seen.ids)
        if both.sum() < o.least_matches:
            assert got is None
            continue
        turn, _, inliers, far = slam.relative(key.seen.bearings[both], seen.bearings, o)
        assert (got is None) == (inliers < o.least_inliers)
        if got:
            assert got[:2] == (inliers, both.sum()) and abs(got[2] - far) < 1e-7 and np.allclose(got[3], turn @ key.pose)
    assert slam.relatives([], o) == []


def test_odd_frames(spark):
    """Features without id, ids seen twice and frames without features."""
    _, _, at, features = world()[0]
    import datetime as dt

    twice = [(None, 0.0, 0.0, 1.0), *features[::-1], *[(i, 0.0, 0.0, 1.0) for i, *_ in features[:3]]]
    rows = [(1, 0, at, features), (1, 1, at + dt.timedelta(seconds=1), twice), (1, 2, at + dt.timedelta(seconds=2), []), (None, 3, at, features), (None, 4, at + dt.timedelta(seconds=1), features)]
    got = told(slam.replay(spark.createDataFrame(rows, FRAMES)))
    assert (got[1, 1].state, got[1, 1].matches, got[1, 1].inliers) == ("tracking", 40, 37)
    assert got[1, 2].state == "lost" and (got[None, 3].state, got[None, 4].state) == ("initializing", "tracking")
