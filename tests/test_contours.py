"""Skeletons and contours against loops over cells."""

import math

import numpy as np
import pytest

from orbisight.operators import contours, distance

H, W = 8, 12


def ray(y, x):
    lon, lat = 2 * math.pi * x / W - math.pi, math.pi / 2 - math.pi * y / H
    return np.array([math.sin(lon) * math.cos(lat), math.sin(lat), math.cos(lon) * math.cos(lat)])


def brute_sides(label, known, open_borders):
    found = []
    for y, x in np.argwhere(label > 0):
        for way, (s, e, (oy, ox)) in enumerate(contours.SIDES):
            ny, nx = y + oy, (x + ox) % W
            if not 0 <= ny < H:
                continue
            if (known[ny, nx] and label[ny, nx] != label[y, x]) or (not known[ny, nx] and open_borders):
                found.append((int(label[y, x]), way, (y + s[0], (x + s[1]) % W), (y + e[0], (x + e[1]) % W)))
    return found


@pytest.mark.parametrize("share,holes,open_borders", [(0.3, 0.0, False), (0.6, 0.0, False), (0.9, 0.15, False), (0.6, 0.15, True)])
def test_contours(spark, share, holes, open_borders):
    rng = np.random.default_rng(int(share * 10))
    label = np.where(rng.random((H, W)) < share, rng.integers(1, 3, (H, W)), 0)
    known = rng.random((H, W)) >= holes
    label = np.where(known, label, 0)
    rows = [(p * H + int(y), int(x), int(label[y, x]) or None) for p in (0, 2) for y, x in np.argwhere(known)]
    found = contours.contours(spark.createDataFrame(rows, "y int, x int, label int"), H, W, open_borders).collect()
    want = brute_sides(label, known, open_borders)
    for pano in (0, 2):
        own = [r for r in found if r.pano == pano]
        assert sorted((r.label, (r.sy, r.sx), (r.ey, r.ex)) for r in own) == sorted((k, s, e) for k, _, s, e in want)
        spot = lambda y, x: (y, 0 if y in (0, H) else x)
        by = {}
        for r in own:
            by.setdefault(r.contour, []).append(r)
        for ring in by.values():
            ring.sort(key=lambda r: r.rank)
            assert [r.rank for r in ring] == list(range(len(ring))) and len({(r.label, r.closed) for r in ring}) == 1
            assert all(spot(a.ey, a.ex) == spot(b.sy, b.sx) for a, b in zip(ring, ring[1:]))
            assert (spot(ring[-1].ey, ring[-1].ex) == spot(ring[0].sy, ring[0].sx)) or not ring[0].closed
            # an open contour has nowhere to go on to
            if not ring[0].closed:
                assert not any(r.label == ring[0].label and spot(r.sy, r.sx) == spot(ring[-1].ey, ring[-1].ex) for r in own if r.contour != ring[0].contour and r.rank == 0 and r.closed)
        if not holes or open_borders:
            assert all(r.closed for r in own)
        assert sum(r.length for r in own) == pytest.approx(sum(math.acos(np.clip(ray(*s) @ ray(*e), -1, 1)) for _, _, s, e in want), abs=1e-9)


def test_contours_of_shapes(spark):
    """A block, a ring around the sphere, a cap on the pole, and two cells that meet in a corner."""
    shapes = {
        "block": ({(y, x) for y in (3, 4) for x in (2, 3, 4)}, [10]), "seam": ({(3, 11), (3, 0)}, [6]), "belt": ({(3, x) for x in range(W)}, [12, 12]), "cap": ({(0, x) for x in range(W)}, [12]),
        "slice": ({(0, 2), (0, 3), (1, 2), (1, 3)}, [6]), "corner": ({(3, 3), (4, 4)}, [4, 4]), "hole": ({(y, x) for y in (2, 3, 4) for x in (2, 3, 4)} - {(3, 3)}, [4, 12]), "wedges": ({(0, 1), (0, 6)}, [3, 3]), "south": ({(7, 2), (7, 3)}, [4]),
    }
    rows = [(p * H + y, x, 1 if (y, x) in on else None) for p, (on, _) in enumerate(shapes.values()) for y in range(H) for x in range(W)]
    found = contours.contours(spark.createDataFrame(rows, "y int, x int, label int"), H, W)
    sizes = {}
    for r in found.groupBy("pano", "contour", "closed").count().collect():
        assert r.closed
        sizes.setdefault(r.pano, []).append(r["count"])
    assert {name: sorted(sizes[p]) for p, name in enumerate(shapes)} == {name: want for name, (_, want) in shapes.items()}
    assert contours.contours(spark.createDataFrame([], "y int, x int, label int"), H, W).count() == 0


@pytest.mark.parametrize("connectivity", [4, 8])
def test_skeleton(spark, connectivity):
    rng = np.random.default_rng(6)
    mask, known = rng.random((H, W)) < 0.8, rng.random((H, W)) < 0.95
    rows = [(int(y), int(x), bool(mask[y, x])) for y, x in np.argwhere(known)] + [(3 * H + y, x, True) for y in range(H) for x in range(W)]
    df = spark.createDataFrame(rows, "y int, x int, inside boolean")
    got = {(r.y, r.x) for r in distance.skeleton(df, df.inside, H, W, connectivity).collect()}
    centre = lambda y, x: ray(y + 0.5, x + 0.5)
    out = [centre(y, x) for y, x in np.argwhere(known & ~mask)]
    far = {(y, x): math.degrees(min(2 * math.asin(np.linalg.norm(centre(y, x) - o) / 2) for o in out)) for y, x in np.argwhere(known & mask)}
    want = set()
    for (y, x), d in far.items():
        for dy, dx in [(0, 1), (1, 0), (1, 1), (1, -1)][: 2 if connectivity == 4 else 4]:
            a, b = (far.get((y + s * dy, (x + s * dx) % W), -1) for s in (1, -1))
            if d >= max(a, b) - 1e-9 and d > min(a, b) + 1e-9:
                want.add((y, x))
    assert got == want
    assert distance.skeleton(df, df.inside, H, W, connectivity, 40.0).count() == sum(far[k] >= 40 for k in want)
