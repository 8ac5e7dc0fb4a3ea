"""Distance fields, watersheds and fused volumes against brute force."""

import heapq
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from orbisight.operators import distance, flooding, volume

H, W = 8, 12


def ray(y, x, h=H, w=W):
    lon, lat = 2 * math.pi * (x + 0.5) / w - math.pi, math.pi / 2 - math.pi * (y + 0.5) / h
    return np.array([math.sin(lon) * math.cos(lat), math.sin(lat), math.cos(lon) * math.cos(lat)])


def lattice(spark, value, kind="double", pano=0):
    rows = [(pano * value.shape[0] + y, x, value[y, x].item()) for y, x in np.ndindex(*value.shape)]
    return spark.createDataFrame(rows, f"y int, x int, value {kind}")


@pytest.mark.parametrize("many,seed", [(1, 0), (3, 1), (20, 2)])
def test_geodesic_distance(spark, many, seed):
    rng = np.random.default_rng(seed)
    value = np.zeros((H, W))
    value.flat[rng.choice(H * W, many, replace=False)] = 1
    stack = lattice(spark, value).unionByName(lattice(spark, np.zeros((H, W)), pano=2))
    got = {(r.y, r.x): r.distance for r in distance.geodesic_distance(stack.where("y <> 3"), stack.value > 0, H, W, "radians").collect()}
    targets = [ray(y, x) for y, x in np.argwhere(value > 0) if y != 3]
    assert len(got) == 2 * H * W - W
    for (y, x), d in got.items():
        want = min((2 * math.asin(min(1.0, np.linalg.norm(ray(y, x) - t) / 2)) for t in targets), default=None) if y < H else None
        assert (d is None) == (want is None) and (d is None or abs(d - want) < 1e-9)
    with pytest.raises(ValueError):
        distance.geodesic_distance(stack, stack.value > 0, H, W, "miles")


def brute_depth(mask):
    out = np.argwhere(~mask)
    return {(y, x): math.sqrt(((out - (y, x)) ** 2).sum(1).min()) if len(out) else None for y, x in np.argwhere(mask)}


@pytest.mark.parametrize("share", [0.5, 0.8, 0.97, 1.0])
def test_mask_depth(spark, share):
    rng = np.random.default_rng(5)
    masks = {k: rng.random((9, 11)) < share for k in range(3)}
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in np.argwhere(m)]
    found = distance.mask_depth(spark.createDataFrame(rows + rows[:5], "view int, y int, x int"), ["view"], 9, 11).collect()
    assert len(found) == len(rows)
    want = {k: brute_depth(m) for k, m in masks.items()}
    for r in found:
        w = want[r.view][r.y, r.x]
        assert (r.depth is None and w is None) or abs(r.depth - w) < 1e-9


def test_depth_blends(spark):
    """Two masks in a row of seven: depths 1 2 3 of 0-2 (the lattice ends at 0) and 1 2 1 of 1-3."""
    seen = [(0, "a", 0, x, 10.0) for x in range(3)] + [(0, "b", 0, x, 20.0) for x in range(1, 4)]
    rows = spark.createDataFrame(seen, "pano int, view string, y int, x int, value double")
    got = {r.x: (r.value, r.support) for r in distance.blend_by_depth(rows, ["pano"], 1, 7, "closest").collect()}
    assert got == {0: (10.0, 1), 1: (10.0, 2), 2: (20.0, 2), 3: (20.0, 1)}
    got = {r.x: r.value for r in distance.blend_by_depth(rows, ["pano"], 1, 7, "feathering").collect()}
    assert got[0] == 10 and got[3] == 20 and abs(got[1] - (10 * 2 / 3 + 20 / 2) / (2 / 3 + 1 / 2)) < 1e-12 and abs(got[2] - (10 / 3 + 20) / (1 / 3 + 1)) < 1e-12
    assert distance.blend_by_depth(rows.limit(0), ["pano"], 1, 7, "feathering").count() == 0


def brute_watershed(value, marker, around):
    """A priority flood of barriers, steps and labels."""
    h, w = value.shape
    best, heap = {}, [(value[y, x], 0, marker[y, x], y, x) for y, x in np.argwhere(marker > 0)]
    heapq.heapify(heap)
    while heap:
        cost, steps, label, y, x = heapq.heappop(heap)
        if (y, x) in best or (marker[y, x] > 0 and (steps or marker[y, x] != label)):
            continue
        best[y, x] = (label, cost, steps)
        for dy, dx in around:
            oy, ox = y + dy, (x + dx) % w
            if 0 <= oy < h and (oy, ox) not in best and not np.isnan(value[oy, ox]):
                heapq.heappush(heap, (max(cost, value[oy, ox]), steps + 1, label, oy, ox))
    return best


@pytest.mark.parametrize("tile,connectivity,levels", [(4, 8, 3), (5, 4, 3), (64, 8, 1000), (3, 8, 1000), (12, 4, 1)])
def test_watershed(spark, tile, connectivity, levels):
    rng = np.random.default_rng(levels + tile)
    panos = {}
    for pano in (0, 3):
        value = rng.integers(0, levels, (H, W)).astype(float)
        value[rng.random((H, W)) < 0.15] = np.nan
        marker = np.where((rng.random((H, W)) < 0.08) & ~np.isnan(value), rng.integers(1, 5, (H, W)), 0)
        panos[pano] = value, marker
    rows = [(p * H + y, x, None if np.isnan(v[y, x]) else v[y, x].item(), int(m[y, x]) or None) for p, (v, m) in panos.items() for y, x in np.ndindex(H, W)]
    got = flooding.watershed(spark.createDataFrame(rows, "y int, x int, value double, seed int"), "value", "seed", H, W, connectivity, tile).collect()
    assert len(got) == len({(r.y, r.x) for r in got})
    want = {(p * H + y, x): s for p, (v, m) in panos.items() for (y, x), s in brute_watershed(v, m, flooding.AROUND[connectivity]).items()}
    assert {(r.y, r.x): (r.label, r.cost, r.steps) for r in got} == want


def test_watershed_needs_markers_inside(spark):
    rows = spark.createDataFrame([(0, 0, None, 1), (0, 1, 2.0, None)], "y int, x int, value double, seed int")
    with pytest.raises(Exception, match="outside of the domain"):
        flooding.watershed(rows, "value", "seed", H, W).collect()
    assert flooding.watershed(rows.where("x = 1"), "value", "seed", H, W).count() == 0


POSE = "scene long, view long, cx double, cy double, cz double, " + ", ".join(f"r{a}{b} double" for a in range(3) for b in range(3))


def scene(spark, h, w, ranges, poses):
    rows = [(0, v, int(y), int(x), float(r[y, x]), 0.5 + 0.5 * ((y + x) % 2), bool(r[y, x] > 0)) for v, r in ranges.items() for y, x in np.ndindex(h, w)]
    made = [(0, v, *map(float, c), *map(float, np.asarray(m).ravel())) for v, (c, m) in poses.items()]
    return spark.createDataFrame(rows, "scene long, view long, y int, x int, range double, confidence double, valid boolean"), spark.createDataFrame(made, POSE)


def brute_tsdf(h, w, ranges, poses, voxels, voxel, truncation, least, by_confidence):
    out = {}
    for ijk in voxels:
        s = weight = views = 0
        for v, r in ranges.items():
            c, m = poses[v]
            q = np.asarray(m) @ ((np.array(ijk) + 0.5) * voxel - c)
            dist = np.linalg.norm(q)
            px = ((math.atan2(q[0], q[2]) + math.pi) / (2 * math.pi) * w - 0.5) % w
            py = min(max((math.pi / 2 - math.asin(q[1] / dist)) / math.pi * h - 0.5, 0), h - 1)
            x0, y0 = math.floor(px), math.floor(py)
            got = [(wt, y, x % w) for y, wy in ((y0, 1 - py + y0), (min(y0 + 1, h - 1), py - y0)) for x, wx in ((x0, 1 - px + x0), (x0 + 1, px - x0)) if (wt := wy * wx) > 0 and r[y, x % w] > 0]
            total = sum(g[0] for g in got)
            if total <= 0 or total < least - 1e-6:
                continue
            sdf = sum(wt * r[y, x] for wt, y, x in got) / total - dist
            sure = sum(wt * (0.5 + 0.5 * ((y + x) % 2)) for wt, y, x in got) / total if by_confidence else 1.0
            if sdf >= -truncation:
                s, weight, views = s + max(-1, min(1, sdf / truncation)) * sure, weight + sure, views + 1
        if views:
            out[ijk] = (s / weight, weight, views)
    return out


@pytest.mark.parametrize("weighting,least", [("uniform", 1.0), ("confidence", 0.4)])
def test_tsdf_matches_dense_grid(spark, weighting, least):
    rng = np.random.default_rng(7)
    h, w = 20, 40
    turn = lambda t: [[math.cos(t), 0, -math.sin(t)], [0, 1, 0], [math.sin(t), 0, math.cos(t)]]
    ranges = {v: np.where(rng.random((h, w)) < 0.1, 0, 1.5 + 0.4 * rng.random((h, w))) for v in range(3)}
    poses = {0: ((0, 0, 0), turn(0)), 1: ((0.3, 0.1, -0.2), turn(0.7)), 2: ((-0.2, 0, 0.25), turn(-2.0))}
    got = volume.fuse_tsdf(*scene(spark, h, w, ranges, poses), h, w, 0.3, 0.45, 4, weighting, least).collect()
    rows = {(r.i, r.j, r.k): (r.tsdf, r.weight, r.views) for r in got}
    assert len(rows) == len(got) > 1500
    want = brute_tsdf(h, w, ranges, poses, itertools.product(range(-12, 12), repeat=3), 0.3, 0.45, least, weighting == "confidence")
    for at, (tsdf, weight, views) in rows.items():
        assert views == want[at][2] and abs(tsdf - want[at][0]) < 1e-6 and abs(weight - want[at][1]) < 1e-6
    # whatever lies in the band is there
    assert all(at in rows for at, told in want.items() if abs(told[0]) < 0.99)


def test_surface_of_a_sphere(spark):
    h, w = 48, 96
    ranges = {v: np.full((h, w), 2.0) for v in range(2)}
    poses = {v: ((0.01, -0.02, 0.03), np.eye(3)) for v in range(2)}
    voxels = volume.fuse_tsdf(*scene(spark, h, w, ranges, poses), h, w, 0.25, 0.75, 8)
    found, faces = (df.collect() for df in volume.extract_surface(voxels, 0.25, 0.75, min_views=2))
    spot = {(v.i, v.j, v.k, v.along): np.array([v.x, v.y, v.z]) for v in found}
    normal = {(v.i, v.j, v.k, v.along): np.array([v.nx, v.ny, v.nz]) for v in found}
    assert len(spot) == len(found)
    sides, area = Counter(), 0.0
    centre = np.array([0.01, -0.02, 0.03])
    for f in faces:
        a, b, c = (tuple(f[n]) for n in "abc")
        sides.update([(a, b), (b, c), (c, a)])
        across = np.cross(spot[b] - spot[a], spot[c] - spot[a])
        area += np.linalg.norm(across) / 2
        assert across @ (centre - spot[a]) > 0  # free space is inside
    assert set(sides.values()) == {1} and all((b, a) in sides for a, b in sides)  # closed, and turned alike
    assert len(spot) - len(sides) // 2 + len(faces) == 2
    assert abs(area - 16 * math.pi) < 0.3
    assert all(abs(np.linalg.norm(p - centre) - 2) < 0.02 and normal[at] @ (centre - p) > 1.9 for at, p in spot.items())
    assert all(v.views == 2 for v in found)
    assert volume.extract_surface(voxels, 0.25, 0.75, min_views=3)[1].count() == 0


def test_triangles_close_at_random_signs(spark):
    rng = random.Random(3)
    rows = [(0, i, j, k, rng.uniform(0.1, 1) * (1 if {0, 6} & {i, j, k} else rng.choice((1, -1))), 1.0, 1) for i, j, k in itertools.product(range(7), repeat=3)]
    faces = volume.triangles(volume.cubes(spark.createDataFrame(rows, "scene long, i long, j long, k long, tsdf double, weight double, views long"))).collect()
    sides = Counter()
    for f in faces:
        a, b, c = (tuple(f[n])[:4] for n in "abc")
        sides.update([(a, b), (b, c), (c, a)])
    assert faces and set(sides.values()) == {1} and all((b, a) in sides for a, b in sides)


def test_blocks_go_to_all_tasks(spark):
    """A few blocks make many voxels: they are dealt to as many tasks as the session names, however small their table is."""
    h, w = 16, 32
    ranges, poses = {v: np.full((h, w), 2.0) for v in range(2)}, {v: ((0.1 * v, 0.0, 0.0), np.eye(3)) for v in range(2)}
    blocks = volume.reached(volume.band_blocks(*scene(spark, h, w, ranges, poses), h, w, 0.25, 0.5, 4), *scene(spark, h, w, ranges, poses), 0.25, 0.5, 4)
    seen = volume.projected(blocks, h, w, 0.25, 4)
    assert seen.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert seen.count() == blocks.count() * 64
