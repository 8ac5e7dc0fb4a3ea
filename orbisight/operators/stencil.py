"""Gathers on the sphere: resampling and stencils as equi-joins on computed cells.

What a tap reads depends on the row alone up to a shift in longitude, so a stencil is a table of height x taps rows.
It is broadcast (its size is fixed by the lattice and the kernel) and the gather is one shuffle by target cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G


def row_table(spark: SparkSession, height: int, width: int, taps: list[tuple[float, float, float]]) -> DataFrame:
    """(y, dx, sy, w): target row, shift in columns, source row and weight for taps (east rad, north rad, weight)."""
    rows = []
    for y in range(height):
        lat = math.pi / 2 - math.pi * (y + 0.5) / height
        for east, north, w in taps:
            r = math.hypot(east, north)
            s = math.sin(r) / r if r else 1.0
            px = s * east
            py = math.cos(r) * math.sin(lat) + s * north * math.cos(lat)
            pz = math.cos(r) * math.cos(lat) - s * north * math.sin(lat)
            lon, plat = math.atan2(px, pz), math.asin(max(-1.0, min(1.0, py)))
            sy = min(height - 1, max(0, math.floor((math.pi / 2 - plat) / math.pi * height - 0.5 + 0.5)))
            rows.append((y, math.floor(lon / (2 * math.pi) * width + 0.5), sy, float(w)))
    return spark.createDataFrame(rows, "y int, dx int, sy int, w double")


def gather(cells: DataFrame, lut: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, w, value, valid): every tap of every observed cell, found by pushing each source to its targets."""
    row = G.row_in(F.col("y"), height)
    source = cells.select((F.col("y") - row).alias("top"), row.alias("sy"), F.col("x").alias("sx"), "value", "valid")
    return source.join(F.broadcast(lut), "sy").select((F.col("top") + F.col("y")).alias("y"), F.pmod(F.col("sx") - F.col("dx"), F.lit(width)).alias("x"), "w", "value", "valid")


def filtered(taps: DataFrame, kind: str = "sum") -> DataFrame:
    """One aggregate over the taps of each cell: sum (correlation), mean (renormalised over valid taps), median, max, min."""
    good = taps.where("valid")
    made = {
        "sum": F.sum(F.col("w") * F.col("value")), "mean": F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")), "median": F.median("value"), "max": F.max("value"), "min": F.min("value")
    }
    return good.groupBy("y", "x").agg(made[kind].alias("value"), F.count(F.lit(1)).alias("taps"))


def kernel_taps(kernel: list[list[float]], step_rad: float) -> list[tuple[float, float, float]]:
    """Taps of a kernel in the tangent plane, first row to the north."""
    h, w = len(kernel), len(kernel[0])
    return [((j - (w - 1) / 2) * step_rad, ((h - 1) / 2 - i) * step_rad, kernel[i][j]) for i in range(h) for j in range(w)]


def gaussian_kernel(size: int, sigma: float) -> list[list[float]]:
    g = [math.exp(-((k - size // 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    total = sum(g) ** 2
    return [[a * b / total for b in g] for a in g]


#: The derivative kernels, scaled so that a unit slope gives one.
SOBEL_EAST = [[-0.125, 0.0, 0.125], [-0.25, 0.0, 0.25], [-0.125, 0.0, 0.125]]
SOBEL_NORTH = [[0.125, 0.25, 0.125], [0.0, 0.0, 0.0], [-0.125, -0.25, -0.125]]
LAPLACE = [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]]


def disk_taps(radius_rad: float, east_step: float, north_step: float) -> list[tuple[float, float, float]]:
    """All lattice offsets within the radius; the centre always."""
    reach = lambda step: range(-int(radius_rad / step + 1e-9), int(radius_rad / step + 1e-9) + 1)
    return [(i * east_step, j * north_step, 1.0) for i in reach(east_step) for j in reach(north_step) if math.hypot(i * east_step, j * north_step) <= radius_rad + 1e-12 or i == j == 0]


def morphology(cells: DataFrame, lut: DataFrame, height: int, width: int, kind: str) -> DataFrame:
    """Dilation (max) or erosion (min) over the symmetric closure of the sampled neighbour relation."""
    row = G.row_in(F.col("y"), height)
    source = cells.where("valid").select((F.col("y") - row).alias("top"), row.alias("sy"), F.col("x").alias("sx"), "value")
    targets = cells.select("y", "x")
    pushed = source.join(F.broadcast(lut), "sy").select((F.col("top") + F.col("y")).alias("y"), F.pmod(F.col("sx") - F.col("dx"), F.lit(width)).cast("int").alias("x"), "value")
    pulled = source.select("top", F.col("sy").alias("y"), "sx", "value").join(F.broadcast(lut), "y").select((F.col("top") + F.col("sy")).alias("y"), F.pmod(F.col("sx") + F.col("dx"), F.lit(width)).cast("int").alias("x"), "value")
    best = F.max("value") if kind == "dilate" else F.min("value")
    return pushed.unionByName(pulled).groupBy("y", "x").agg(best.alias("value")).join(targets, ["y", "x"], "left_semi")


#: Tables that are the same for every panorama are broadcast up to so many rows, and sorted and merged beyond.
BROADCAST_ROWS = 1 << 18


def lattice(table: DataFrame, rows: int) -> DataFrame:
    """A table of about ``rows`` rows that is the same for every panorama, to be joined with the rows of a whole stack.

    Spark takes what was exploded for as small as what it came from and would send a copy for every panorama through the
    driver; so a join reads one table for all of them, whose size the lattice and not the data fixes.
    """
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def _met(cells: DataFrame, at: DataFrame, rows: int | None, height: int) -> DataFrame:
    """Targets (.., _y, _x) with the cells of their panorama, or with those of every panorama where they name none."""
    if "pano" in at.columns:
        source = cells.select(F.col("y").alias("_y"), F.col("x").alias("_x"), "value", "valid")
        return at.withColumn("_y", F.col("pano") * height + F.col("_y")).join(source, ["_y", "_x"]).drop("_y", "_x")
    source = cells.select(F.floor(F.col("y") / height).alias("pano"), G.row_in(F.col("y"), height).cast("int").alias("_y"), F.col("x").alias("_x"), "value", "valid")
    return source.join(at.hint("merge") if rows is None else lattice(at, rows), ["_y", "_x"]).drop("_y", "_x")


def resample_nearest(cells: DataFrame, targets: DataFrame, x: Column, y: Column, height: int, width: int, rows: int | None = None) -> DataFrame:
    """The cells that fractional source pixels of the targets (pano, ..) fall on; x wraps and y clamps.

    Targets without ``pano``, ``rows`` of them, are the same in every panorama.
    """
    at = targets.withColumn("_x", F.pmod(G.nearest(x), F.lit(width)).cast("int")).withColumn("_y", F.least(F.greatest(G.nearest(y), F.lit(0)), F.lit(height - 1)).cast("int"))
    return _met(cells, at, rows, height)


def resample_bilinear(cells: DataFrame, targets: DataFrame, keys: list[str], x: Column, y: Column, height: int, width: int, rows: int | None = None) -> DataFrame:
    """Four corners of each target (pano, ..) by one join, added up with their weights renormalised over valid corners.

    Targets without ``pano``, ``rows`` of them, are the same in every panorama; ``keys`` name it all the same.
    """
    fx, fy = x - F.floor(x), y - F.floor(y)
    corner = lambda i, j, w: F.struct((F.floor(x) + i).alias("cx"), (F.floor(y) + j).alias("cy"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    own = [k for k in keys if k in targets.columns]
    spread = targets.select(*own, F.explode(four).alias("c")).select(*own, F.pmod("c.cx", F.lit(width)).cast("int").alias("_x"), F.least(F.greatest("c.cy", F.lit(0)), F.lit(height - 1)).cast("int").alias("_y"), F.col("c.w").alias("w"))
    met = _met(cells.where("valid"), spread, rows and 4 * rows, height)
    return met.groupBy(*keys).agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"), F.sum("w").alias("weight"))


def bilateral(cells: DataFrame, lut: DataFrame, height: int, width: int, sigma_color: float) -> DataFrame:
    """Mean over the valid taps, weighted by the table's spatial weight and by nearness in value to the centre."""
    centre = cells.where("valid").select("y", "x", F.col("value").alias("c"))
    taps = gather(cells, lut, height, width).where("valid").join(centre, ["y", "x"])
    w = F.col("w") * F.exp(-((F.col("value") - F.col("c")) * (F.col("value") - F.col("c"))) / (2 * sigma_color * sigma_color))
    return taps.groupBy("y", "x").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.count(F.lit(1)).alias("taps"))


def halved(cells: DataFrame, lut: DataFrame, height: int, width: int) -> DataFrame:
    """(pano, oy, ox, value): the cells blurred by the table and resampled to half the lattice; the next level of a pyramid."""
    blurred = filtered(gather(cells, lut, height, width), "mean").select("y", "x", "value", F.lit(True).alias("valid"))
    panos = blurred.select(F.floor(F.col("y") / height).alias("pano")).distinct()
    each = panos.select("pano", F.explode(F.sequence(F.lit(0), F.lit(height * width // 4 - 1))).alias("id"))
    at = each.select("pano", F.floor(F.col("id") / (width // 2)).cast("int").alias("oy"), (F.col("id") % (width // 2)).cast("int").alias("ox"))
    return resample_bilinear(blurred, at, ["pano", "oy", "ox"], (F.col("ox") + 0.5) * 2 - 0.5, (F.col("oy") + 0.5) * 2 - 0.5, height, width).select("pano", "oy", "ox", "value")


def residual(cells: DataFrame, coarse: DataFrame, height: int, width: int, sign: int = -1) -> DataFrame:
    """Cells less (or plus) the coarse level brought back to their lattice: a band of the Laplacian pyramid and its inverse."""
    stack = coarse.select((F.col("pano") * (height // 2) + F.col("oy")).cast("int").alias("y"), F.col("ox").alias("x"), "value", F.lit(True).alias("valid"))
    at = cells.select(F.floor(F.col("y") / height).alias("pano"), F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("value").alias("own"))
    x, y = (F.col("fx") + 0.5) / 2 - 0.5, (G.row_in(F.col("fy"), height) + 0.5) / 2 - 0.5
    up = resample_bilinear(stack, at, ["pano", "fy", "fx", "own"], x, y, height // 2, width // 2)
    return up.select(F.col("fy").alias("y"), F.col("fx").alias("x"), (F.col("own") + sign * F.col("value")).alias("value"))


def steep(cells: DataFrame, height: int, threshold: float) -> DataFrame:
    """Cells whose gradient is under ``threshold``: differences to the cell before in row and column, 0 where there is none."""
    from pyspark.sql import Window

    row = Window.partitionBy("y").orderBy("x")
    column = Window.partitionBy(F.floor(F.col("y") / height), "x").orderBy("y")
    step = lambda w, k: F.coalesce(F.when(F.lag(k).over(w) == F.col(k) - 1, F.col("value") - F.lag("value").over(w)), F.lit(0.0))
    return cells.withColumn("_e", step(row, "x")).withColumn("_s", step(column, "y")).where(F.sqrt(F.col("_e") * F.col("_e") + F.col("_s") * F.col("_s")) < threshold).drop("_e", "_s")


def edges(cells: DataFrame, blur: DataFrame, east: DataFrame, north: DataFrame, height: int, width: int, low: float, high: float) -> DataFrame:
    """(y, x, magnitude): blur, gradient, ridge cells along the gradient, then the 8-connected ridges that somewhere reach ``high``.

    A ridge cell is at least as steep as both neighbours in the nearest of four directions of its gradient.
    """
    from ..sources.lineage import checkpointed
    from . import regions

    smooth = filtered(gather(cells, blur, height, width), "mean").select("y", "x", "value", F.lit(True).alias("valid"))
    slope = lambda lut, name: filtered(gather(smooth, lut, height, width), "sum").select("y", "x", F.col("value").alias(name))
    both = slope(east, "e").join(slope(north, "n"), ["y", "x"])
    sector = F.pmod(F.floor(F.round(F.atan2("n", "e") / (math.pi / 4), 6) + 0.5), F.lit(4))  # east, north-east, north, north-west
    steep = checkpointed(both.select("y", "x", F.round(F.hypot("e", "n"), 6).alias("m"), sector.alias("s")))  # read twice
    dx, dy = F.when(F.col("s") == 2, 0).when(F.col("s") == 3, -1).otherwise(1), F.when(F.col("s") == 0, 0).otherwise(-1)
    sides = steep.where(F.col("m") >= low).select("y", "x", "m", F.explode(F.array(F.lit(1), F.lit(-1))).alias("k"), dx.alias("dx"), dy.alias("dy"))
    sides = sides.select("y", "x", "m", (F.col("y") + F.col("k") * F.col("dy")).alias("ny"), F.pmod(F.col("x") + F.col("k") * F.col("dx"), F.lit(width)).alias("nx"))
    near = steep.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("m").alias("other"))
    same = F.floor(F.col("ny") / height) == F.floor(F.col("y") / height)
    met = sides.join(near, ["ny", "nx"], "left").groupBy("y", "x", "m").agg(F.max(F.when(same, F.col("other"))).alias("other"))
    ridge = checkpointed(met.where(F.coalesce("other", F.lit(0.0)) <= F.col("m")).select("y", "x", "m", F.lit(1).alias("label")))
    pieces = regions.label_components(ridge, height, width, connectivity=8).join(ridge.select("y", "x", "m"), ["y", "x"])
    strong = pieces.where(F.col("m") >= high).select("component").distinct()
    return pieces.join(strong, "component", "left_semi").select("y", "x", F.col("m").alias("magnitude"))
