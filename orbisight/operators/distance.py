"""Distances on the lattice: to the nearest target over the sphere, to the edge of a mask in the plane, and blends by them.

Both are separable and exact.  In one row the nearest target of a column is told by windows over that row; what is left is
a least value over the rows of a column, an array of at most the lattice's height.  So a distance field costs an exchange by
row and one by column, whatever the number of targets, and no cell meets all targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..sources.lineage import checkpointed


def _latitude(row: Column, height: int) -> Column:
    return math.pi / 2 - math.pi * (row + 0.5) / height


def nearest_in_rows(targets: DataFrame, width: int) -> DataFrame:
    """(pano, ty, x, dx): for every row with targets (pano, ty, x) and every column, how many columns off the nearest lies, around the seam."""
    rows = targets.select("pano", "ty").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    on = targets.select("pano", "ty", "x", F.col("x").alias("at")).distinct()
    row = Window.partitionBy("pano", "ty")
    before, after = (row.orderBy("x").rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    seen = rows.join(on, ["pano", "ty", "x"], "left").select(
        "pano", "ty", "x", F.last("at", True).over(before).alias("west"), F.first("at", True).over(after).alias("east"), F.min("at").over(row).alias("low"), F.max("at").over(row).alias("high")
    )
    x = F.col("x")
    return seen.select("pano", "ty", "x", F.least(x - F.col("west"), F.col("east") - x, x + width - F.col("high"), F.col("low") + width - x).alias("dx"))


def geodesic_distance(cells: DataFrame, target: Column, height: int, width: int, units: str = "degrees") -> DataFrame:
    """(y, x, distance): from every cell of the stack to the nearest target of its panorama along a great circle.

    Distance is 0 on targets and null in a panorama without any.  Rows too far off by latitude alone are left out before any
    angle is computed: going along the column and then along the row is never shorter than the nearest target.
    """
    if units not in ("degrees", "radians"):
        raise ValueError("units are degrees or radians")
    pano, row = F.floor(F.col("y") / height), G.row_in(F.col("y"), height)
    targets = cells.where(target).select(pano.alias("pano"), row.alias("ty"), "x")
    columns = nearest_in_rows(targets, width).groupBy("pano", "x").agg(F.collect_list(F.struct("ty", "dx")).alias("rows"))
    north, east = math.pi / height, 2 * math.pi / width
    own = cells.select("y", "x", pano.alias("pano"), row.alias("row")).join(columns, ["pano", "x"], "left")
    off = lambda t: F.abs(t["ty"] - F.col("row")) * north
    reach = F.array_min(F.transform("rows", lambda t: off(t) + t["dx"] * east))
    lat = _latitude(F.col("row"), height)

    def half_chord(t: Column) -> Column:
        up, across = F.sin(off(t) / 2), F.sin(t["dx"] * east / 2)
        return up * up + F.cos(lat) * F.cos(_latitude(t["ty"], height)) * across * across

    # bound by a lambda, the reach is computed once for a cell and not for each of its rows
    least = F.transform(F.array(reach), lambda b: F.array_min(F.transform(F.filter("rows", lambda t: off(t) <= b + 1e-9), half_chord)))[0]
    found = own.select("y", "x", least.alias("h"))
    angle = F.when(F.col("h").isNotNull(), 2 * F.asin(F.least(F.sqrt("h"), F.lit(1.0))))
    return found.select("y", "x", (F.degrees(angle) if units == "degrees" else angle).alias("distance"))


def mask_depth(mask: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """(keys.., y, x, depth): from each cell of a mask to the nearest lattice cell outside of it, straight across the lattice.

    The lattice ends at its borders, which are not outside; a mask that covers it all has null for depth.  Runs along rows
    give the distance in the row; a cell's nearest cell outside lies in the rows of its own run along the column, or ends it.
    """
    number = lambda by, along: F.col(along) - F.row_number().over(Window.partitionBy(*keys, by).orderBy(along))

    def ends(by: str, along: str, run: str, size: int) -> Column:
        w = Window.partitionBy(*keys, by, run)
        low, high = F.min(along).over(w), F.max(along).over(w)
        return F.least(F.when(low > 0, F.col(along) - low + 1), F.when(high < size - 1, high - F.col(along) + 1)).cast("double")

    cells = mask.select(*keys, "y", "x").distinct()
    rows = cells.withColumn("_r", number("y", "x")).withColumn("_h", ends("y", "x", "_r", width)).drop("_r")
    both = rows.withColumn("_c", number("x", "y")).withColumn("_v", ends("x", "y", "_c", height))
    runs = both.groupBy(*keys, "x", "_c").agg(F.sort_array(F.collect_list(F.struct("y", "_h", "_v"))).alias("run"))
    flat = runs.withColumn("flat", F.transform("run", lambda s: s["_h"] * s["_h"]))
    each = flat.select(*keys, "x", "flat", F.posexplode("run").alias("at", "s"))
    # null ends are endless: F.least and F.array_min pass over them
    bound = F.coalesce(F.least("s._h", "s._v"), F.lit(float(height))).cast("int")
    low, high = F.greatest(F.col("at") - bound, F.lit(0)), F.least(F.col("at") + bound, F.size("flat") - 1)
    inside = F.transform(F.sequence(low, high), lambda j: (j - F.col("at")) * (j - F.col("at")) + F.col("flat")[j])
    depth = F.sqrt(F.least(F.col("s._v") * F.col("s._v"), F.array_min(inside)))
    return each.select(*keys, F.col("s.y").alias("y"), "x", depth.alias("depth"))


def blend_by_depth(seen: DataFrame, keys: list[str], height: int, width: int, method: str) -> DataFrame:
    """(keys.., y, x, value, support): views of (keys.., view, y, x, value) blended by how deep in its mask each lies.

    ``feathering`` is the mean weighted by depth over the view's largest depth; ``closest`` takes the value of the deepest
    view, of equal ones the first.  A view without an edge weighs 1 and is deepest.
    """
    whole = [*keys, "view"]
    deep = mask_depth(seen, whole, height, width)
    met = seen.join(deep.hint("merge"), [*whole, "y", "x"])  # as many rows as are seen, which no estimate after an explode tells
    own = [*keys, "y", "x"]
    if method == "closest":
        return met.groupBy(*own).agg(F.min_by("value", F.struct(F.coalesce(-F.col("depth"), F.lit(-math.inf)), F.col("view"))).alias("value"), F.count(F.lit(1)).alias("support"))
    if method != "feathering":
        raise ValueError(f"no blend {method}")
    most = deep.groupBy(*whole).agg(F.max("depth").alias("most"))
    w = F.coalesce(F.col("depth") / F.col("most"), F.lit(1.0))
    return met.join(most, whole).groupBy(*own).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.count(F.lit(1)).alias("support"))


def skeleton(cells: DataFrame, inside: Column, height: int, width: int, connectivity: int = 8, least_degrees: float = 0.0) -> DataFrame:
    """(y, x, distance): cells of a mask where the distance to what lies outside of it has a ridge, in degrees.

    A ridge cell is at least as far from the outside as both neighbours of some opposite pair and farther than one of them; a
    neighbour that isn't in the mask counts as lower, the seam wraps and the poles don't.  A mask that fills what is known of a
    panorama has no skeleton.
    """
    far = geodesic_distance(cells, ~inside, height, width).withColumn("distance", F.round("distance", 9))
    own = checkpointed(far.join(cells.where(inside).select("y", "x"), ["y", "x"], "left_semi")).where("distance IS NOT NULL")
    pairs = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if connectivity == 8 else [])]
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s * dy).alias("dy"), F.lit(s * dx).alias("dx")) for k, (dy, dx) in enumerate(pairs) for s in (1, -1)])).alias("s")
    asked = own.select("y", "x", "distance", steps).select("y", "x", "distance", "s.k", (F.col("y") + F.col("s.dy")).alias("ny"), F.pmod(F.col("x") + F.col("s.dx"), F.lit(width)).alias("nx"))
    near = own.select(F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("distance").alias("other"))
    met = asked.join(near, ["ny", "nx"], "left").withColumn("other", F.when(F.floor(F.col("ny") / height) == F.floor(F.col("y") / height), F.col("other")))
    sides = met.groupBy("y", "x", "distance", "k").agg(F.max(F.coalesce("other", F.lit(-1.0))).alias("most"), F.min(F.coalesce("other", F.lit(-1.0))).alias("least"))
    ridge = sides.where((F.col("distance") >= F.col("most")) & (F.col("distance") > F.col("least")) & (F.col("distance") >= least_degrees))
    return ridge.select("y", "x", "distance").distinct()
