"""Labelled regions on the lattice: measures, adjacency, boundaries and connected components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..sources.lineage import checkpointed, written


def measure(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """Count, area, share of the sphere, mean bearing (null if it cancels out) and area-weighted mean value by label."""
    a, r = G.row_area(F.col("y"), height, width), G.erp_pixel_to_ray(F.col("x"), F.col("y"), height, width)
    sums = cells.withColumn("a", a).withColumn("r", r).groupBy(label).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("a").alias("area"), F.try_divide(F.sum(F.col("value") * F.col("a")), F.sum("a")).alias("mean_value"), *[F.sum(F.col("a") * F.col("r")[k]).alias(k) for k in "xyz"]
    )
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return sums.select(label, "cells", "area", (F.col("area") / (4 * math.pi)).alias("share"), "mean_value", *[F.when(n > 4096 * 2.2e-16, F.col(k) / n).alias(f"c{k}") for k in "xyz"])


def neighbours(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """(y, x, label, other, edge, side): each cell with its eastern and its southern neighbour and their shared edge.

    The seam wraps, the poles do not, and panoramas of a stack do not touch; two equi-joins, no all-pairs step.
    """
    a = cells.select("y", "x", F.col(label).alias("label"))
    b = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(label).alias("other"))
    east = a.join(b, (F.col("ny") == F.col("y")) & (F.col("nx") == F.pmod(F.col("x") + 1, F.lit(width)))).withColumn("edge", F.lit(math.pi / height)).withColumn("side", F.lit("east"))
    south = a.join(b, (F.col("ny") == F.col("y") + 1) & (F.col("nx") == F.col("x")) & (G.row_in(F.col("ny"), height) > 0)).withColumn("edge", 2 * math.pi / width * F.abs(F.cos(math.pi / 2 - math.pi * (G.row_in(F.col("y"), height) + 1) / height))).withColumn("side", F.lit("south"))
    return east.unionByName(south)


def adjacency(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """Shared boundary of each unordered pair of labels."""
    pairs = neighbours(cells, height, width, label).where("label <> other")
    return pairs.groupBy(F.least("label", "other").alias("label_a"), F.greatest("label", "other").alias("label_b")).agg(F.sum("edge").alias("shared"), F.count(F.lit(1)).alias("edges"))


def boundaries(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """Cells with a neighbour of another label."""
    pairs = neighbours(cells, height, width, label).where("label <> other")
    other = pairs.select(F.when(F.col("side") == "south", F.col("y") + 1).otherwise(F.col("y")).alias("y"), F.when(F.col("side") == "east", F.pmod(F.col("x") + 1, F.lit(width))).otherwise(F.col("x")).alias("x"))
    return pairs.select("y", "x").unionByName(other.select(F.col("y").cast("int"), F.col("x").cast("int"))).distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100, task_rows: int = 50_000) -> DataFrame:
    """(node, root) with the smallest node of each component; nodes without edges are their own.

    Large-star and small-star rounds on checkpointed edges: joins on nodes only, pre-aggregated, logarithmic rounds, at the
    end of which the number of edges never exceeds the input's.  As many tasks run as the edges fill with ``task_rows``.
    """
    ties = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    tasks = max(2, -(-2 * ties.count() // task_rows))
    ties, seen = ties.coalesce(tasks), None
    for _ in range(most_rounds):
        both = ties.unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        ties = checkpointed(moved.unionByName(low.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks))
        now = ties.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = ties.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select("node").join(roots, F.col("node") == F.col("a"), "left").select("node", F.coalesce("root", "node").alias("root"))


def diagonals(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """(y, x, label, ny, nx, other): each cell with its south-eastern and south-western neighbour."""
    a = cells.select("y", "x", F.col(label).alias("label"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("step"))
    b = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col(label).alias("other"))
    return a.join(b, (F.col("ny") == F.col("y") + 1) & (F.col("nx") == F.pmod(F.col("x") + F.col("step"), F.lit(width))) & (G.row_in(F.col("ny"), height) > 0)).drop("step")


def perimeters(cells: DataFrame, height: int, width: int, label: str = "label") -> DataFrame:
    """Length of the boundary of each label with other labels."""
    pairs = neighbours(cells, height, width, label).where("label <> other")
    sides = pairs.select(F.explode(F.array("label", "other")).alias("label"), "edge")
    return sides.groupBy("label").agg(F.sum("edge").alias("perimeter"), F.count(F.lit(1)).alias("edges"))


def filled(cells: DataFrame, height: int, width: int, most_area: float, connectivity: int = 4) -> DataFrame:
    """Cells outside of a mask ``inside`` whose 4- or 8-connected piece has at most ``most_area`` and lies among known cells only.

    A piece that touches a place without a cell, other than beyond the poles, may go on there and is not filled.
    """
    holes = label_components(cells.withColumn("label", F.col("inside")), height, width, connectivity=connectivity).join(cells.select("y", "x", "inside"), ["y", "x"]).where("NOT inside")
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (connectivity == 8 or not dy * dx)]
    around = holes.select("y", "x", "component", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("s"))
    ny, nx = F.col("y") + F.col("s.dy"), F.pmod(F.col("x") + F.col("s.dx"), F.lit(width))
    around = around.select("component", ny.alias("ny"), nx.alias("nx"), (F.floor(ny / height) == F.floor(F.col("y") / height)).alias("same")).where("same")
    known = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"))
    open_ = around.join(known, ["ny", "nx"], "left_anti").select("component").distinct()
    area = holes.groupBy("component").agg(F.sum(G.row_area(F.col("y"), height, width)).alias("area")).where(F.col("area") <= most_area)
    closed = area.join(open_, "component", "left_anti")
    return holes.join(closed, "component").select("y", "x", "component")


def runs(cells: DataFrame, flag: str) -> DataFrame:
    """(y, start, length): a mask as runs along its rows."""
    from pyspark.sql import Window

    on = cells.where(flag).withColumn("_g", F.col("x") - F.row_number().over(Window.partitionBy("y").orderBy("x")))
    return on.groupBy("y", "_g").agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("length")).drop("_g")


def from_runs(made: DataFrame) -> DataFrame:
    """(y, x): the cells of runs."""
    return made.select("y", F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("length") - 1).cast("int"))).alias("x"))


def label_components(cells: DataFrame, height: int, width: int, label: str = "label", connectivity: int = 4) -> DataFrame:
    """4- or 8-connected pieces of equal label: (y, x, component), named by their first cell in raster order."""
    number = lambda y, x: (y * width + x).cast("long")
    same = neighbours(cells, height, width, label).where("label = other")
    other_y = F.when(F.col("side") == "south", F.col("y") + 1).otherwise(F.col("y"))
    other_x = F.when(F.col("side") == "east", F.pmod(F.col("x") + 1, F.lit(width))).otherwise(F.col("x"))
    edges = same.select(number(F.col("y"), F.col("x")).alias("a"), number(other_y, other_x).alias("b"))
    if connectivity == 8:
        across = diagonals(cells, height, width, label).where("label = other")
        edges = edges.unionByName(across.select(number(F.col("y"), F.col("x")).alias("a"), number(F.col("ny"), F.col("nx")).alias("b")))
    found = components(cells.select(number(F.col("y"), F.col("x")).alias("node")), edges)
    return found.select(F.floor(F.col("node") / width).cast("int").alias("y"), (F.col("node") % width).cast("int").alias("x"), F.col("root").alias("component"))


def rank_in(df: DataFrame, by: list[Column], keys: list[str]) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def overlaps(masks: DataFrame, region: str = "region", cell: str = "cell") -> DataFrame:
    """(a, b, common, iou) of all regions that share a cell; an equi-join on cells, counted before it meets the sizes."""
    own = masks.select(F.col(region).alias("a"), F.col(cell).alias("cell")).distinct()
    size = own.groupBy("a").agg(F.count(F.lit(1)).alias("n_a"))
    both = own.join(own.withColumnRenamed("a", "b"), "cell").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    sized = both.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b")
    return sized.select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("iou"), (F.col("common") / F.least("n_a", "n_b")).alias("containment"))


def merged(masks: DataFrame, scores: DataFrame, least_iou: float | None, least_containment: float | None = None, kind: str | None = None) -> DataFrame:
    """(keeper, members, cells): groups of regions tied by their overlap; the best score keeps, null last, then the smallest id; masks unite.

    Regions are tied by intersection over union or by the share of the smaller one that lies in the other, whichever is
    asked for, and only inside one class where ``kind`` names that column of ``scores``, null being a class.
    """
    if least_iou is None and least_containment is None:
        raise ValueError("at least one threshold is needed")
    enough = [F.col(c) >= least for c, least in (("iou", least_iou), ("containment", least_containment)) if least is not None]
    ties = overlaps(masks).where(enough[0] if len(enough) == 1 else enough[0] | enough[1]).select("a", "b")
    if kind:
        of = lambda c: scores.select(F.col("region").alias(c), F.col(kind).alias(f"kind_{c}"))
        ties = ties.join(of("a"), "a").join(of("b"), "b").where(F.col("kind_a").eqNullSafe(F.col("kind_b"))).select("a", "b")
    grouped = components(scores.select(F.col("region").alias("node")), ties)
    best = F.struct(F.col("score").isNull(), F.coalesce(-F.col("score"), F.lit(0.0)), F.col("region"))
    keeper = grouped.join(scores, F.col("node") == F.col("region")).groupBy("root").agg(F.min_by("region", best).alias("keeper"), F.count(F.lit(1)).alias("members"))
    united = masks.join(grouped, F.col("region") == F.col("node")).select("root", "cell").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("cells"))
    return keeper.join(united, "root").select("keeper", "members", "cells")


def joint_clusters(points: DataFrame, radius: float) -> DataFrame:
    """(node, root): matches (id, a, b) linked if their bearings lie within ``radius`` of one another in both views.

    Bearings are hashed to a grid as wide as the chord, and a point meets those of the 27 boxes around its own only.
    """
    side = 2 * math.sin(min(radius, math.pi) / 2)
    box = lambda k: F.floor(F.col("a")[k] / side)
    homes = points.select("id", "a", "b", *[box(k).alias(f"g{k}") for k in "xyz"])
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = homes
    for k in "xyz":
        around = around.withColumn("_s", F.explode(steps)).withColumn(f"g{k}", F.col(f"g{k}") + F.col("_s")).drop("_s")
    near = around.join(homes.select(F.col("id").alias("other"), F.col("a").alias("oa"), F.col("b").alias("ob"), "gx", "gy", "gz"), ["gx", "gy", "gz"]).where("id < other")
    close = lambda p, q: F.round(G.angle(F.col(p), F.col(q)), 9) <= radius
    edges = near.where(close("a", "oa") & close("b", "ob")).select(F.col("other").alias("a"), F.col("id").alias("b"))
    return components(points.select(F.col("id").alias("node")), edges)


def suppressed(scores: DataFrame, conflicts: DataFrame, kind: str | None = None) -> DataFrame:
    """(region, score) that greedy suppression keeps: by falling score, null last, then id, whatever conflicts with a kept one goes.

    Regions conflict only inside one class where ``kind`` names that column of ``scores``, null being a class.  A conflict of
    a region with itself is none, and a region without an id has none.  Rounds keep every undecided row without an undecided
    better rival and drop the rivals of what is kept, until none is undecided; ids that occur twice with other scores raise.
    """
    order = F.struct(F.col("score").isNull(), F.coalesce(-F.col("score"), F.lit(0.0)), F.col("region"))
    own = (F.col(kind) if kind else F.lit(0)).alias("kind")
    nameless = scores.where("region IS NULL").select("region", "score")
    named = checkpointed(scores.where("region IS NOT NULL").select("region", "score", order.alias("rank"), own).distinct())
    rank = lambda c: named.select(F.col("region").alias(c), F.col("rank").alias(f"rank_{c}"), F.col("kind").alias(f"kind_{c}"))
    beats = conflicts.where("a <> b").join(rank("a"), "a").join(rank("b"), "b").where(F.col("kind_a").eqNullSafe(F.col("kind_b")))
    better = F.col("rank_a") < F.col("rank_b")
    pairs = checkpointed(beats.select(F.when(better, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("loser")).distinct())
    open_, kept = written(named.select("region", "score")), nameless
    while not open_.isEmpty():
        live = pairs.join(open_.select(F.col("region").alias("winner")), "winner", "left_semi").join(open_.select(F.col("region").alias("loser")), "loser", "left_semi")
        top = written(open_.join(live.select(F.col("loser").alias("region")), "region", "left_anti"))
        if top.isEmpty():
            raise ValueError("regions suppress one another: an id has several scores")
        kept = kept.unionByName(top)
        gone = live.join(top.select(F.col("region").alias("winner")), "winner", "left_semi").select(F.col("loser").alias("region"))
        open_ = written(open_.join(top.select("region"), "region", "left_anti").join(gone, "region", "left_anti"))
    return kept


def support_boundaries(cells: DataFrame, height: int, width: int) -> DataFrame:
    """Cells next to a place of their panorama that has none."""
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("s")
    around = cells.select("y", "x", steps).select("y", "x", (F.col("y") + F.col("s.dy")).alias("ny"), F.pmod(F.col("x") + F.col("s.dx"), F.lit(width)).alias("nx"))
    around = around.where(F.floor(F.col("ny") / height) == F.floor(F.col("y") / height))
    known = cells.select(F.col("y").alias("ny"), F.col("x").alias("nx"))
    return around.join(known, ["ny", "nx"], "left_anti").select("y", "x").distinct()
