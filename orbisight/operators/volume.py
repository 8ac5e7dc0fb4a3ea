"""Signed distances of range panoramas on a sparse grid of voxels, and the surface between them.

A scene's views are range panoramas with poses.  Only blocks of voxels near a measured point exist: each range marks the
blocks along its truncation band, and their neighbours.  Blocks meet the views that can reach them through coarse boxes of
space, so no scene is paired with all of its views; range panoramas come as small tiles with one more row and column, so a
voxel's four pixels are one look-up.  Running sums by voxel are all that is exchanged afterwards.

The grid is that of the world: voxel (i, j, k) is centred at (i + 1/2, j + 1/2, k + 1/2) voxels.  Voxels that no view
accepts aren't there: unknown is not free space.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..sources.lineage import checkpointed

_TILE, _COARSE = 4, 8
_AT = ("i", "j", "k")


def _matrix(turned: bool = False) -> list[list[Column]]:
    return [[F.col(f"r{b}{a}" if turned else f"r{a}{b}") for b in range(3)] for a in range(3)]


def _nine(c: Column) -> Column:
    """Nine digits; ``round`` goes by decimals, some ten times slower."""
    return F.floor(c * 1e9 + 0.5) / 1e9


def world_points(ranges: DataFrame, poses: DataFrame, height: int, width: int) -> DataFrame:
    """Valid ranges with their unit direction ``d`` in the world and the centre of their view."""
    ray = G.erp_pixel_to_ray(F.col("x"), F.col("y"), height, width)
    return ranges.where("valid AND range > 0").join(poses, ["scene", "view"]).withColumn("d", G.rotate(_matrix(True), ray))


def band_blocks(ranges: DataFrame, poses: DataFrame, height: int, width: int, voxel: float, truncation: float, block: int) -> DataFrame:
    """(scene, bi, bj, bk): blocks that a range's truncation band passes through, and those around them."""
    side = voxel * block
    steps = max(1, math.ceil(2 * truncation / (side / 2)))
    along = F.explode(F.array(*[F.lit(truncation * (2 * k / steps - 1)) for k in range(steps + 1)])).alias("s")
    points = world_points(ranges, poses, height, width).select("scene", "range", "d", "cx", "cy", "cz", along)
    home = lambda k: F.floor(_nine((F.col(f"c{k}") + F.col("d")[k] * (F.col("range") + F.col("s"))) / side))
    touched = points.select("scene", *[home(k).alias(f"b{n}") for k, n in zip("xyz", _AT, strict=True)]).distinct()
    for n in _AT:
        touched = touched.withColumn(f"b{n}", F.explode(F.array(*[F.col(f"b{n}") + s for s in (-1, 0, 1)])))
    return touched.distinct()


def _tiles(ranges: DataFrame, height: int, width: int) -> DataFrame:
    """(scene, view, ty, tx, ranges, sureness): tiles with one more row and column; the seam wraps, null where nothing is valid."""
    n = _TILE + 1
    own = lambda c: F.floor(F.col(c) / _TILE)
    homes = F.array(*[F.struct(a.alias("ty"), b.alias("tx")) for a in (own("y"), own("y") - 1) for b in (own("x"), own("x") - 1)])
    last = (width - 1) // _TILE
    spread = ranges.where("valid").select("scene", "view", "y", "x", "range", "confidence", F.explode(homes).alias("t"))
    tx = F.when(F.col("t.tx") < 0, F.lit(last)).otherwise(F.col("t.tx"))
    lx = F.when(F.col("t.tx") < 0, F.col("x") + width - last * _TILE).otherwise(F.col("x") - F.col("t.tx") * _TILE)
    placed = spread.select("scene", "view", F.col("t.ty").alias("ty"), tx.alias("tx"), (F.col("y") - F.col("t.ty") * _TILE).alias("ly"), lx.alias("lx"), "range", "confidence")
    placed = placed.where((F.col("ty") >= 0) & F.col("ly").between(0, _TILE) & F.col("lx").between(0, _TILE))
    held = placed.groupBy("scene", "view", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ly") * n + F.col("lx")).cast("int").alias("at"), F.struct("range", "confidence")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.try_element_at("m", k))
    return held.select("scene", "view", "ty", "tx", dense.alias("pixels"))


def reached(blocks: DataFrame, ranges: DataFrame, poses: DataFrame, voxel: float, truncation: float, block: int) -> DataFrame:
    """Blocks with each view of their scene that has some range as far as they lie; they meet in coarse boxes of space."""
    side = voxel * block
    wide = side * _COARSE
    far = ranges.where("valid").groupBy("scene", "view").agg(F.max("range").alias("far"))
    views = poses.join(far, ["scene", "view"]).withColumn("far", F.col("far") + truncation + side * math.sqrt(3))
    boxes = views
    for k, n in zip("xyz", _AT, strict=True):
        low, high = (F.floor((F.col(f"c{k}") + s * F.col("far")) / wide) for s in (-1, 1))
        boxes = boxes.withColumn(f"g{n}", F.explode(F.sequence(low, high)))
    homes = blocks.select("*", *[F.floor(F.col(f"b{n}") / _COARSE).alias(f"g{n}") for n in _AT])
    off = sum(((F.col(f"b{n}") + 0.5) * side - F.col(f"c{k}")) * ((F.col(f"b{n}") + 0.5) * side - F.col(f"c{k}")) for k, n in zip("xyz", _AT, strict=True))
    return homes.join(boxes, ["scene", *[f"g{n}" for n in _AT]]).where(F.sqrt(off) <= F.col("far")).drop("far", *[f"g{n}" for n in _AT])


def projected(reached_: DataFrame, height: int, width: int, voxel: float, block: int) -> DataFrame:
    """(scene, view, i, j, k, dist, px, py): every voxel of each block as its view sees it, pixels to nine digits.

    Few rows of blocks make many of voxels, so blocks are dealt to all tasks; the arithmetic is too long for a method that the
    JVM compiles, and so goes by arrays.
    """
    frame = [f"c{k}" for k in "xyz"] + [f"r{a}{b}" for a in range(3) for b in range(3)]
    kinds = dict(reached_.dtypes)
    inner = np.stack(np.unravel_index(np.arange(block**3), (block,) * 3), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                told = lambda names: np.stack([part.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)  # noqa: B023, E731
                place = told([f"b{n}" for n in _AT])[:, None, :] * block + inner
                pose = told(frame)[:, None, :]
                x, y, z = np.moveaxis((place + 0.5) * voxel - pose[:, :, :3], 2, 0)
                x, y, z = (pose[:, :, 3 + 3 * a] * x + pose[:, :, 4 + 3 * a] * y + pose[:, :, 5 + 3 * a] * z for a in range(3))
                dist = np.sqrt(x * x + y * y + z * z)
                keep = np.flatnonzero(dist > 0)
                x, y, z, dist = (c.ravel()[keep] for c in (x, y, z, dist))
                u = (np.arctan2(x, z) + math.pi) / (2 * math.pi) * width - 0.5
                u = np.floor((u - width * np.floor(u / width)) * 1e9 + 0.5) / 1e9
                v = (math.pi / 2 - np.arcsin(np.clip(y / dist, -1, 1))) / math.pi * height - 0.5
                v = np.clip(np.floor(v * 1e9 + 0.5) / 1e9, 0, height - 1)
                own = pa.array(keep // block**3)
                columns = [*place.reshape(-1, 3)[keep].T.copy(), dist, np.where(u >= width, u - width, u), v]
                yield pa.RecordBatch.from_arrays([*[part.column(n).take(own) for n in ("scene", "view")], *map(pa.array, columns)], ["scene", "view", *_AT, "dist", "px", "py"])

    tasks = int(reached_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = reached_.select("scene", "view", *[f"b{n}" for n in _AT], *frame).repartition(tasks, "scene", "view", *[f"b{n}" for n in _AT])
    return dealt.mapInArrow(run, f"scene {kinds['scene']}, view {kinds['view']}, i long, j long, k long, dist double, px double, py double")


def accepted(met: DataFrame, truncation: float, weighting: str, min_valid_weight: float) -> DataFrame:
    """(scene, i, j, k, s, sure) of the voxels of each tile that its view accepts: clipped distance by weight, and weight."""
    n, kind = _TILE + 1, dict(met.dtypes)["scene"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            voxels = batch.column("voxels")
            own, held = np.repeat(np.arange(len(batch)), np.diff(voxels.offsets.to_numpy())), voxels.flatten()
            i, j, k, dist, px, py = (held.field(c).to_numpy(zero_copy_only=False) for c in (*_AT, "dist", "px", "py"))
            far, sure = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.column("pixels").flatten().flatten())
            x, y = np.floor(px), np.floor(py)
            at = own * n * n + ((y % _TILE) * n + x % _TILE).astype(int)
            w, wr, wc = np.zeros((3, len(own)))
            for dy, dx, share in ((0, 0, (1 - py + y) * (1 - px + x)), (0, 1, (1 - py + y) * (px - x)), (1, 0, (py - y) * (1 - px + x)), (1, 1, (py - y) * (px - x))):
                known = (share > 0) & ~np.isnan(far[np.where(share > 0, at + dy * n + dx, at)])  # a corner without a share may lie outside
                spot = np.where(known, at + dy * n + dx, 0)
                w += np.where(known, share, 0.0)
                wr += np.where(known, share * far[spot], 0.0)
                wc += np.where(known, share * sure[spot], 0.0)
            known = np.flatnonzero((w > 0) & (w >= min_valid_weight - 1e-6))
            sdf = np.floor((wr[known] / w[known] - dist[known]) * 1e9 + 0.5) / 1e9
            trust = wc[known] / w[known] if weighting == "confidence" else np.ones(len(known))
            good = (sdf >= -truncation) & (trust > 0)
            known, sdf, trust = known[good], sdf[good], trust[good]
            made = [batch.column("scene").take(pa.array(own[known])), *[pa.array(c[known]) for c in (i, j, k)], pa.array(np.clip(sdf / truncation, -1, 1) * trust), pa.array(trust)]
            yield pa.RecordBatch.from_arrays(made, ["scene", *_AT, "s", "sure"])

    return met.select("scene", "voxels", "pixels").mapInArrow(run, f"scene {kind}, i long, j long, k long, s double, sure double")


def fuse_tsdf(ranges: DataFrame, poses: DataFrame, height: int, width: int, voxel: float, truncation: float, block: int = 8, weighting: str = "uniform", min_valid_weight: float = 1.0) -> DataFrame:
    """(scene, i, j, k, tsdf, weight, views) of every voxel near the measured surface that some view accepts.

    ``ranges`` is (scene, view, y, x, range, confidence, valid), ``poses`` (scene, view, cx, cy, cz, r00 .. r22), the matrix
    turning world into camera directions.  A view accepts a voxel if its four pixels are valid by ``min_valid_weight`` and
    the voxel lies in front of the measured surface or at most ``truncation`` behind it.
    """
    if weighting not in ("uniform", "confidence"):
        raise ValueError(f"no weighting {weighting}")
    blocks = band_blocks(ranges, poses, height, width, voxel, truncation, block)
    seen = projected(reached(blocks, ranges, poses, voxel, truncation, block), height, width, voxel, block)
    tile = lambda c: F.floor(F.floor(F.col(c)) / _TILE)
    dealt = seen.select("scene", "view", tile("py").alias("ty"), tile("px").alias("tx"), F.struct(*_AT, "dist", "px", "py").alias("s"))
    met = dealt.groupBy("scene", "view", "ty", "tx").agg(F.collect_list("s").alias("voxels")).join(_tiles(ranges, height, width), ["scene", "view", "ty", "tx"])
    told = accepted(met, truncation, weighting, min_valid_weight)
    sums = told.groupBy("scene", *_AT).agg(F.sum("s").alias("s"), F.sum("sure").alias("weight"), F.count(F.lit(1)).alias("views"))
    return sums.select("scene", *_AT, (F.col("s") / F.col("weight")).alias("tsdf"), "weight", "views")


def local_views(voxels: DataFrame, radius: int) -> DataFrame:
    """The voxels with the most views of any voxel at most ``radius`` off along each axis, by one axis after the other."""
    most = voxels.select("scene", *_AT, F.col("views").alias("local"))
    for n in _AT:
        spread = most.withColumn(n, F.explode(F.array(*[F.col(n) + s for s in range(-radius, radius + 1)])))
        most = spread.groupBy("scene", *_AT).agg(F.max("local").alias("local"))
    return voxels.join(most, ["scene", *_AT])


#: The corner k of a cube lies at the bits of k; a tetrahedron goes from corner 0 to corner 7 along the axes in some order.
TETRAHEDRA = [(0, 1 << a, (1 << a) | (1 << b), 7) for a, b, _ in itertools.permutations(range(3))]


def cubes(voxels: DataFrame) -> DataFrame:
    """(scene, i, j, k, value): the values at the eight corners of each whole cube whose sign changes."""
    homes = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[(F.col(n) - (c >> b & 1)).alias(n) for b, n in enumerate(_AT)]) for c in range(8)])).alias("h")
    each = voxels.select("scene", "tsdf", homes).select("scene", "h.*", "tsdf")
    slots = F.array(*[F.max(F.when(F.col("c") == c, F.col("tsdf"))) for c in range(8)])
    made = each.groupBy("scene", *_AT).agg(slots.alias("value"), F.count(F.lit(1)).alias("n"), F.min("tsdf").alias("low"), F.max("tsdf").alias("high"))
    return made.where("n = 8 AND low < 0 AND high >= 0").select("scene", *_AT, "value")


def _crossing(a: Column, b: Column) -> Column:
    """The vertex between two corners (c, v): where it lies in the cube and what names it, told from the lower corner."""
    low, high = F.least(a["c"], b["c"]), F.greatest(a["c"], b["c"])
    first = F.when(a["c"] < b["c"], a["v"]).otherwise(b["v"])
    second = F.when(a["c"] < b["c"], b["v"]).otherwise(a["v"])
    return F.struct(low.alias("low"), (high - low).alias("along"), (first / (first - second)).alias("t"))


def triangles(cubes_: DataFrame) -> DataFrame:
    """(scene, a, b, c): faces by the signs of the corners of six tetrahedra, turned so that their normals point to positive values.

    A vertex is (i, j, k, along, t): a voxel, the corner it goes towards as bits of axes, and how far; cubes that share an edge
    name its vertex alike.  Faces without any area are left out.
    """
    corner = lambda c: F.struct(F.lit(c).alias("c"), F.col("value")[c].alias("v"))
    tets = F.explode(F.array(*[F.array(*map(corner, t)) for t in TETRAHEDRA])).alias("tet")
    split = cubes_.select("scene", *_AT, tets).select("scene", *_AT, F.filter("tet", lambda x: x["v"] < 0).alias("in"), F.filter("tet", lambda x: x["v"] >= 0).alias("out"))
    split = split.where((F.size("in") > 0) & (F.size("out") > 0))
    one = lambda p, q: _crossing(F.col("in")[p], F.col("out")[q])
    face = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, "abc", strict=True)])
    made = F.when(F.size("in") == 1, F.array(face(one(0, 0), one(0, 1), one(0, 2)))).when(F.size("in") == 3, F.array(face(one(0, 0), one(1, 0), one(2, 0))))
    made = made.otherwise(F.array(face(one(0, 0), one(0, 1), one(1, 1)), face(one(0, 0), one(1, 1), one(1, 0))))
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1))
    share = lambda side, k: F.size(F.filter(side, lambda x: bit(x["c"], k) == 1)) / F.size(side)
    middle = lambda side: G.ray(*[share(side, k) for k in range(3)])
    each = split.withColumn("mi", middle("in")).withColumn("mo", middle("out")).select("scene", *_AT, "mi", "mo", F.explode(made).alias("f"))
    spot = lambda v: G.ray(*[bit(v["low"], k) + v["t"] * bit(v["along"], k) for k in range(3)])
    less = lambda p, q: G.ray(*[p[k] - q[k] for k in "xyz"])
    each = each.select("scene", *_AT, "mi", "mo", "f", *[spot(F.col(f"f.{n}")).alias(f"p{n}") for n in "abc"])
    each = each.withColumn("normal", G.cross(less(F.col("pb"), F.col("pa")), less(F.col("pc"), F.col("pa")))).where(G.norm(F.col("normal")) > 0)
    right = G.dot(F.col("normal"), less(F.col("mo"), F.col("mi"))) >= 0
    named = lambda v: F.struct(*[(F.col(n) + bit(F.col(v)["low"], b)).alias(n) for b, n in enumerate(_AT)], F.col(v)["along"].alias("along"), F.col(v)["t"].alias("t"))
    each = each.select("scene", right.alias("right"), *[named(f"f.{n}").alias(n) for n in "abc"])
    return each.select("scene", "a", F.when(F.col("right"), F.col("b")).otherwise(F.col("c")).alias("b"), F.when(F.col("right"), F.col("c")).otherwise(F.col("b")).alias("c"))


def spot(vertex: Column, voxel: float) -> Column:
    """Where a vertex of ``triangles`` lies in the world."""
    along = lambda b: F.shiftright(vertex["along"], b).bitwiseAND(F.lit(1))
    return G.ray(*[(vertex[n] + 0.5 + vertex["t"] * along(b)) * voxel for b, n in enumerate(_AT)])


def extract_surface(voxels: DataFrame, voxel: float, truncation: float, min_views: int = 1) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the zero level among voxels near which some voxel has ``min_views`` views.

    Vertices are (scene, i, j, k, along, x, y, z, nx, ny, nz, weight, views): the normal is the gradient at the nearest voxel, where
    unknown neighbours count as 1, and weight and views are that voxel's.  Faces are (scene, a, b, c) of (i, j, k, along).
    """
    voxels = checkpointed(voxels)
    known = checkpointed(local_views(voxels, max(1, math.ceil(truncation / voxel))).where(F.col("local") >= min_views))
    faces = checkpointed(triangles(cubes(known)))
    name = [*_AT, "along"]
    corners = faces.select("scene", F.explode(F.array("a", "b", "c")).alias("v")).groupBy("scene", *[F.col(f"v.{n}").alias(n) for n in name]).agg(F.min("v.t").alias("t"))
    half = lambda b: F.when(F.col("t") > 0.5, F.shiftright("along", b).bitwiseAND(F.lit(1))).otherwise(0)
    at = corners.select("*", *[(F.col(n) + half(b)).alias(f"n{n}") for b, n in enumerate(_AT)])
    steps = [(b, s) for b in range(3) for s in (-1, 1)]
    around = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), *[(F.col(f"n{n}") + (s if b == e else 0)).alias(f"o{n}") for e, n in enumerate(_AT)]) for m, (b, s) in enumerate([*steps, (0, 0)])])).alias("o")
    field = voxels.select("scene", *[F.col(n).alias(f"o{n}") for n in _AT], "tsdf")
    near = at.select("scene", *name, "t", *[f"n{n}" for n in _AT], around).select("scene", *name, "t", *[f"n{n}" for n in _AT], "o.*").join(field, ["scene", *[f"o{n}" for n in _AT]], "left")
    value = lambda m: F.max(F.when(F.col("m") == m, F.coalesce("tsdf", F.lit(1.0))))
    slope = near.groupBy("scene", *name, "t", *[f"n{n}" for n in _AT]).agg(*[((value(2 * b + 1) - value(2 * b)) / (2 * voxel)).alias(f"g{k}") for b, k in enumerate("xyz")])
    own = known.select("scene", *[F.col(n).alias(f"n{n}") for n in _AT], "weight", F.col("local").alias("views"))
    full = slope.join(own, ["scene", *[f"n{n}" for n in _AT]]).withColumn("p", spot(F.struct(*name, "t"), voxel))
    size = F.sqrt(sum(F.col(f"g{k}") * F.col(f"g{k}") for k in "xyz"))
    vertices = full.select("scene", *name, *[F.col("p")[k].alias(k) for k in "xyz"], *[(F.col(f"g{k}") / F.greatest(size, F.lit(1e-12))).alias(f"n{k}") for k in "xyz"], "weight", "views")
    plain = lambda v: F.struct(*[F.col(v)[n].alias(n) for n in name]).alias(v)
    return vertices, faces.select("scene", *map(plain, "abc"))
