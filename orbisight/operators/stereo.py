"""Cost volumes as relations (cell, disparity, cost), and what is chosen from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.lineage import checkpointed


def absolute_difference(left: DataFrame, right: DataFrame, disparities: int, truncate: float) -> DataFrame:
    """|L(x) - R(x - d)| for every d; an equi-join on the shifted column."""
    shifted = left.select("y", "x", F.col("value").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(disparities - 1))).alias("d")).withColumn("rx", F.col("x") - F.col("d"))
    other = right.select("y", F.col("x").alias("rx"), F.col("value").alias("r"))
    return shifted.join(other, ["y", "rx"]).select("y", "x", "d", F.least(F.abs(F.col("l") - F.col("r")), F.lit(truncate)).alias("cost"))


def census(cells: DataFrame, height: int, radius: int = 1) -> DataFrame:
    """One bit for each neighbour that is at least the centre, in raster order; cells without all neighbours go."""
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(offsets)])).alias("o")
    asked = cells.select("y", "x", F.col("value").alias("centre"), steps).select("y", "x", "centre", "o.bit", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    found = asked.join(cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"), "value"), ["ny", "nx"]).where(F.floor(F.col("ny") / height) == F.floor(F.col("y") / height))
    bit = F.when(F.col("value") >= F.col("centre"), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    return found.groupBy("y", "x").agg(F.sum(bit).alias("code"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).select("y", "x", "code")


def census_cost(left: DataFrame, right: DataFrame, disparities: int) -> DataFrame:
    """Hamming distance of the codes."""
    shifted = left.select("y", "x", F.col("code").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(disparities - 1))).alias("d")).withColumn("rx", F.col("x") - F.col("d"))
    other = right.select("y", F.col("x").alias("rx"), F.col("code").alias("r"))
    return shifted.join(other, ["y", "rx"]).select("y", "x", "d", F.bit_count(F.col("l").bitwiseXOR(F.col("r"))).cast("double").alias("cost"))


def ad_census(difference: DataFrame, census_: DataFrame, truncate: float, bits: int, weight: float = 0.25) -> DataFrame:
    """Weighted sum of both costs, each as a share of its largest; only where both are known."""
    other = census_.select("y", "x", "d", (F.col("cost") / bits).alias("_c"))
    return difference.join(other, ["y", "x", "d"]).select("y", "x", "d", (weight * F.col("cost") / truncate + (1 - weight) * F.col("_c")).alias("cost"))


def birchfield_tomasi(left: DataFrame, right: DataFrame, disparities: int, truncate: float) -> DataFrame:
    """The least difference of either pixel to the other's interval of half-way values, for every d."""
    row = Window.partitionBy("y").orderBy("x")

    def interval(side: DataFrame, name: str) -> DataFrame:
        half = lambda f, step: F.when(f("x").over(row) == F.col("x") + step, (F.col("value") + f("value").over(row)) / 2).otherwise(F.col("value"))
        ends = side.withColumn("_a", half(F.lag, -1)).withColumn("_b", half(F.lead, 1))
        return ends.select("y", "x", F.col("value").alias(name), F.least("value", "_a", "_b").alias(f"{name}_lo"), F.greatest("value", "_a", "_b").alias(f"{name}_hi"))

    shifted = interval(left, "l").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(disparities - 1)))).withColumn("rx", F.col("x") - F.col("d"))
    both = shifted.join(interval(right, "r").withColumnRenamed("x", "rx"), ["y", "rx"])
    out = lambda v, lo, hi: F.greatest(F.lit(0.0), F.col(v) - F.col(hi), F.col(lo) - F.col(v))
    return both.select("y", "x", "d", F.least(out("l", "r_lo", "r_hi"), out("r", "l_lo", "l_hi"), F.lit(truncate)).alias("cost"))


def box_aggregate(cost: DataFrame, height: int, width: int, radius: int = 1) -> DataFrame:
    """Mean over the known costs of a square window whose border cells are repeated outwards; along x, then along y.

    Each pass pushes sums and counts to the cells around and adds them up, so a cell without a cost gets one from its window.
    """
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top))
    along = cost.select("y", "x", "d", "cost", F.explode(offsets).alias("k")).withColumn("x", clamp(F.col("x") + F.col("k"), width - 1))
    along = along.groupBy("y", "x", "d").agg(F.sum("cost").alias("s"), F.count(F.lit(1)).alias("n"))
    row = F.pmod("y", F.lit(height))
    down = along.select("y", "x", "d", "s", "n", F.explode(offsets).alias("k")).withColumn("y", F.col("y") - row + clamp(row + F.col("k"), height - 1))
    return down.groupBy("y", "x", "d").agg((F.sum("s") / F.sum("n")).alias("cost"))


def cross_arms(guide: DataFrame, height: int, width: int, most: int, threshold: float) -> DataFrame:
    """(y, x, left, right, up, down): how far a cell's row and column go on without a gap or a value off by over ``threshold``."""
    ways = {"left": (0, -1), "right": (0, 1), "up": (-1, 0), "down": (1, 0)}
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("way"), F.lit(k).alias("k"), F.lit(k * dy).alias("dy"), F.lit(k * dx).alias("dx")) for n, (dy, dx) in ways.items() for k in range(1, most + 1)])).alias("s")
    asked = guide.select("y", "x", "value", steps).select("y", "x", "value", "s.way", "s.k", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    met = asked.join(guide.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("value").alias("other")), ["ny", "nx"], "left")
    same = (F.floor(F.col("ny") / height) == F.floor(F.col("y") / height)) & F.col("nx").between(0, width - 1) & (F.abs(F.col("other") - F.col("value")) <= threshold)
    stop = lambda n: (F.coalesce(F.min(F.when((F.col("way") == n) & ~F.coalesce(same, F.lit(False)), F.col("k"))), F.lit(most + 1)) - 1).alias(n)
    return met.groupBy("y", "x").agg(*map(stop, ways))


def cross_aggregate(cost: DataFrame, guide: DataFrame, height: int, width: int, disparities: int, most: int = 5, threshold: float = 0.08, passes: int = 2) -> DataFrame:
    """Mean of the known costs in each cell's cross: the rows of its own column arm, each as far as both its and the cell's arms go.

    Running sums along every row answer an interval by two look-ups, so a cell costs as many look-ups as its column arm is
    long; the costs of all disparities travel together.  A cell whose cross holds no cost for a disparity has none there.
    """
    arms = checkpointed(cross_arms(guide, height, width, most, threshold))
    other = arms.select(F.col("y").alias("ry"), "x", F.col("left").alias("l"), F.col("right").alias("r"))
    rows = arms.select("y", "x", "left", "right", F.explode(F.sequence(F.col("y") - F.col("up"), F.col("y") + F.col("down"))).alias("ry")).join(other, ["ry", "x"])
    spans = checkpointed(rows.select("y", "x", "ry", (F.col("x") + F.least("right", "r")).alias("to"), (F.col("x") - F.least("left", "l") - 1).alias("since")))
    for _ in range(passes):
        run = Window.partitionBy("y", "d").orderBy("x")
        every = cost.select("y").distinct().select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), F.lit(None).cast("double").alias("none")).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(disparities - 1))).alias("d"))
        sums = every.join(cost.select("y", "x", "d", "cost"), ["y", "x", "d"], "left").select("y", "x", "d", F.sum(F.coalesce("cost", F.lit(0.0))).over(run).alias("s"), F.count("cost").over(run).alias("n"))
        packed = checkpointed(sums.groupBy(F.col("y").alias("ry"), F.col("x").alias("px")).agg(F.sort_array(F.collect_list(F.struct("d", "s", "n"))).alias("p")))
        met = spans.join(packed.select("ry", F.col("px").alias("to"), F.col("p").alias("b")), ["ry", "to"]).join(packed.select("ry", F.col("px").alias("since"), F.col("p").alias("a")), ["ry", "since"], "left")
        part = lambda k, n: F.sum(F.col("b")[k][n] - F.coalesce(F.col("a")[k][n], F.lit(0)))
        made = met.groupBy("y", "x").agg(*[F.struct(part(k, "s").alias("s"), part(k, "n").alias("n")).alias(f"d{k}") for k in range(disparities)])
        each = made.select("y", "x", F.posexplode(F.array(*[f"d{k}" for k in range(disparities)])).alias("d", "t"))
        cost = checkpointed(each.where("t.n > 0").select("y", "x", "d", (F.col("t.s") / F.col("t.n")).alias("cost")))
    return cost


def select_disparity(cost: DataFrame) -> DataFrame:
    """Least cost, second best and parabolic refinement, clipped to half a step."""
    best = cost.groupBy("y", "x").agg(F.min(F.struct("cost", "d")).alias("b"), F.sort_array(F.collect_list("cost")).alias("all"))
    near = best.select("y", "x", F.col("b.d").alias("d"), F.col("b.cost").alias("c"), F.try_element_at("all", F.lit(2)).alias("second"))
    sides = cost.select("y", "x", F.col("d").alias("dd"), "cost")
    low, high = F.max(F.when(F.col("dd") == F.col("d") - 1, F.col("cost"))), F.max(F.when(F.col("dd") == F.col("d") + 1, F.col("cost")))
    joined = near.join(sides, ["y", "x"]).groupBy("y", "x", "d", "c", "second").agg(low.alias("lo"), high.alias("hi"))
    curve = F.col("lo") - 2 * F.col("c") + F.col("hi")
    shift = F.when(curve > 0, F.least(F.greatest((F.col("lo") - F.col("hi")) / (2 * curve), F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    return joined.select("y", "x", F.col("d").alias("disparity"), F.col("c").alias("cost"), "second", (F.col("d") + F.coalesce(shift, F.lit(0.0))).alias("refined"))


def swept(costs: np.ndarray, guide: np.ndarray, p1: float, p2: float, edge: float, shift: int) -> np.ndarray:
    """Messages of one direction, first axis by first axis: each line from the one before, moved by ``shift`` along the second."""
    out = costs.copy()
    n = costs.shape[1]
    at = np.arange(max(0, shift), n + min(0, shift))
    for k in range(1, len(costs)):
        before = out[k - 1, at - shift]
        floor = before.min(1, keepdims=True)
        calm = np.abs(guide[k, at] - guide[k - 1, at - shift]) < edge
        best = np.minimum(before, floor + np.where(calm, p2, max(p1, 0.25 * p2))[:, None])
        best[:, 1:] = np.minimum(best[:, 1:], before[:, :-1] + p1)
        best[:, :-1] = np.minimum(best[:, :-1], before[:, 1:] + p1)
        out[k, at] = costs[k, at] + best - floor
    return out


def semi_global(cost: DataFrame, guide: DataFrame, height: int, p1: float, p2: float, paths: int = 8, edge: float = np.inf) -> DataFrame:
    """Costs regularised along 4 or 8 paths and averaged; a task holds one panorama, whose size the lattice fixes.

    A step between neighbours whose guide values differ by ``edge`` or more costs a quarter of p2 (p1 at least).  Unknown costs
    count as the panorama's largest and stay unknown.
    """
    if paths not in (4, 8):
        raise ValueError("paths must be 4 or 8")
    given = cost.join(guide.select("y", "x", F.col("value").alias("guide")), ["y", "x"]).withColumn("pano", F.floor(F.col("y") / height))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        top, xs = int(rows["pano"].iloc[0]) * height, np.sort(rows["x"].unique())
        y, x, d = rows["y"].to_numpy() - top, np.searchsorted(xs, rows["x"]), rows["d"].to_numpy()
        volume = np.full((height, len(xs), int(d.max()) + 1), rows["cost"].max())
        light = np.zeros(volume.shape[:2])
        volume[y, x, d], light[y, x] = rows["cost"], rows["guide"]
        total = np.zeros_like(volume)
        turned, dark = volume.transpose(1, 0, 2), light.T
        for back in (1, -1):
            total += swept(turned[::back], dark[::back], p1, p2, edge, 0)[::back].transpose(1, 0, 2)
            for shift in (0, 1, -1) if paths == 8 else (0,):
                total += swept(volume[::back], light[::back], p1, p2, edge, shift)[::back]
        return pd.DataFrame({"y": (y + top).astype(np.int32), "x": xs[x].astype(np.int32), "d": d.astype(np.int32), "cost": total[y, x, d] / paths})

    return given.groupBy("pano").applyInPandas(run, "y int, x int, d int, cost double")
