"""Masked and weighted aggregation: areas, blends of overlapping evidence, metrics.

Every blend is an algebraic or partially combined aggregate, so one shuffle by cell carries running sums only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.lineage import checkpointed


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def if_valid(value: Column, valid: Column) -> Column:
    return F.when(valid, value)


def blend(df: DataFrame, method: str, cell: str = "cell", view: str = "view", value: str = "value", valid: str = "valid", weight: Column | None = None) -> DataFrame:
    """(cell, blended, support): support counts valid views; a cell without any has 0 for it and null for the value."""
    v, w, one = if_valid(F.col(value), F.col(valid)), weight, F.count_if(F.col(valid))
    simple = {
        "average": lambda: F.avg(v), "sum": lambda: F.sum(v), "max": lambda: F.max(v), "min": lambda: F.min(v), "counter": lambda: one.cast("double"), "std": lambda: F.stddev_pop(v), "median": lambda: F.median(v),
        "weighted": lambda: F.try_divide(F.sum(v * w), F.sum(F.when(F.col(valid), w))), "closest": lambda: F.max_by(v, F.when(F.col(valid), F.struct(w, -F.col(view)))),
    }
    return df.groupBy(cell).agg(simple[method]().alias("blended"), one.alias("support"))


def vote(df: DataFrame, cell: str, label: Column) -> DataFrame:
    """The most frequent label, the smallest if several are."""
    counted = df.groupBy(cell, label.alias("label")).agg(F.count(F.lit(1)).alias("votes"))
    return counted.groupBy(cell).agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"), F.max("votes").alias("votes"))


def robust_blend(df: DataFrame, delta: float, cell: str = "cell", value: str = "value", valid: str = "valid") -> DataFrame:
    """Half the mean weighted about the median and half the one weighted about the mean, by Huber weights."""
    centre = df.where(F.col(valid)).groupBy(cell).agg(F.median(value).alias("m"), F.avg(value).alias("a"), F.var_pop(value).alias("s"))
    joined = df.where(F.col(valid)).join(centre, cell)

    def huber(about: str) -> Column:
        r = F.abs(F.col(value) - F.col(about))
        return F.when(r <= delta, 1.0).otherwise(delta / (r + 1e-6)) * F.exp(-F.least(F.col("s") / 1e12, F.lit(1.0)))

    mean = lambda w: F.sum(w * F.col(value)) / (F.sum(w) + 1e-6)
    return joined.groupBy(cell).agg((0.5 * mean(huber("m")) + 0.5 * mean(huber("a"))).alias("blended"))


def histogram(df: DataFrame, value: str, weight: Column, low: float, high: float, bins: int) -> DataFrame:
    """Weight by bin; the last bin is closed above."""
    step = (high - low) / bins
    bin_of = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(bin_of.alias("bin")).agg(F.sum(weight).alias("area"), F.count(F.lit(1)).alias("n"))


def equalisation(df: DataFrame, level: Column, weight: Column, levels: int = 256) -> DataFrame:
    """level -> mapped, from the running weighted distribution; the table has at most ``levels`` rows."""
    sums = df.groupBy(level.alias("level")).agg(F.sum(weight).alias("w"))
    run = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cdf = sums.withColumn("cdf", F.sum("w").over(run)).withColumn("total", F.sum("w").over(whole)).withColumn("first", F.first("cdf").over(run))
    return cdf.select("level", F.coalesce(F.rint(F.try_divide((F.col("cdf") - F.col("first")) * (levels - 1), F.col("total") - F.col("first"))), F.col("level")).cast("int").alias("mapped"))


def binary_metrics(df: DataFrame, predicted: Column, true: Column, weight: Column) -> DataFrame:
    """IoU, Dice, precision and recall; an empty union scores one."""
    s = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    both, p, t, either = s(predicted & true), s(predicted), s(true), s(predicted | true)
    ratio = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(1.0)
    return df.agg(ratio(both, either).alias("iou"), ratio(2 * both, p + t).alias("dice"), ratio(both, p).alias("precision"), ratio(both, t).alias("recall"))


def range_metrics(df: DataFrame, predicted: Column, true: Column, weight: Column) -> DataFrame:
    """Weighted MAE, RMSE, absolute relative error and the share within a factor of 1.25."""
    e = predicted - true
    within = F.greatest(F.try_divide(predicted, true), F.try_divide(true, predicted)) < 1.25
    return df.agg(
        weighted_mean(F.abs(e), weight).alias("mae"), F.sqrt(weighted_mean(e * e, weight)).alias("rmse"), weighted_mean(F.abs(e) / true, weight).alias("abs_rel"), weighted_mean(within.cast("double"), weight).alias("delta_1"), F.count(F.lit(1)).alias("n")
    )


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, share: float, name: str = "weighted_quantile") -> DataFrame:
    """The lower weighted quantile: first value whose running weight reaches the share of the group's.

    Values are sorted by ranges over all groups; running weights start from the sums of the ranges before, of which there are
    as many as shuffle partitions, so a group is never sorted in one task.
    """
    from ..sources.lineage import checkpointed

    each = df.groupBy(*keys, value).agg(F.sum(weight).alias("w")).orderBy(*keys, value)
    placed = checkpointed(each.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))  # the number of the range
    ranges = placed.groupBy(*keys, "_part").agg(F.sum("w").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0))).withColumn("_total", F.sum("_sum").over(Window.partitionBy(*keys))).drop("_sum")
    run = Window.partitionBy(*keys, "_part").orderBy(value)
    upto = placed.join(ranges, [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.sum("w").over(run))
    return upto.where(F.col("_upto") >= F.col("_total") * share).groupBy(*keys).agg(F.min(value).alias(name))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The weighted quantile at one half."""
    return weighted_quantile(df, keys, value, weight, 0.5, "weighted_median")


def majority_and_envelope(df: DataFrame, cell: str, view: Column, mask: Column) -> DataFrame:
    """(cell, majority, envelope) of three masks: set in two of them at least, and set in any."""
    by_mask = df.groupBy(cell, view.alias("_view")).agg(F.bool_or(mask).alias("_set"))
    return by_mask.groupBy(cell).agg((F.count_if("_set") >= 2).alias("majority"), F.bool_or("_set").alias("envelope"))


def voxel_blend(df: DataFrame, size: float, weight: str = "w", axes: tuple[str, ...] = ("x", "y", "z"), carried: tuple[str, ...] = ()) -> DataFrame:
    """Weighted mean position (and carried values) in each voxel; cells of hardly any weight go."""
    key = [F.floor(F.col(a) / size).cast("long").alias(f"k{a}") for a in axes]
    sums = df.groupBy(*key).agg(F.sum(weight).alias("weight"), *[weighted_mean(F.col(a), F.col(weight)).alias(a) for a in (*axes, *carried)])
    return sums.where(F.col("weight") >= 1e-6)


def surface_metrics(found: DataFrame, truth: DataFrame, distance: float) -> DataFrame:
    """Precision, recall and their harmonic mean of points (id, x, y, z) that have a point of the other side within ``distance``.

    Equal points are asked once.  Two points of a box of half that width are near for certain, so most need no pair; the
    others meet the points of the boxes of full width around theirs, as far as there are any.  Only whether there is one is kept.
    """
    at, wide, fine = list("xyz"), list("fgh"), list("uvw")
    bounded = lambda k, width: F.floor(F.least(F.greatest(F.col(k) / width, F.lit(-(2.0**60))), F.lit(2.0**60)))
    exact = F.greatest(*[F.abs(k) for k in at]) < distance * 2.0**40  # beyond, rounding may move a point to another box

    def boxed(df: DataFrame) -> DataFrame:
        each = df.select(*[F.col(k).cast("double").alias(k) for k in at]).groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
        finite = F.greatest(*[F.abs(k) for k in at]) < math.inf
        known = F.when(finite & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.lit(True))
        halves = [F.when(known & exact, bounded(k, distance / 2)).alias(b) for k, b in zip(at, fine, strict=True)]
        return each.select(*at, "n", *[F.when(known, bounded(k, distance)).alias(b) for k, b in zip(at, wide, strict=True)], *halves)

    def share(a: DataFrame, b: DataFrame) -> DataFrame:
        told = checkpointed(a.join(b.select(*fine, F.lit(True).alias("same")).distinct(), fine, "left").select(*at, "n", *wide, "same"))
        left = told.where("same IS NULL")
        boxes = left.select(*wide).distinct()
        for k in wide:
            boxes = boxes.withColumn(f"o{k}", F.explode(F.array(*[F.col(k) + s for s in (-1, 0, 1)])))
        other = b.select(*[F.col(k).alias(f"o{k}") for k in wide], *[F.col(k).alias(f"b{k}") for k in at])
        meet = [f"o{k}" for k in wide]
        boxes = boxes.hint("merge").join(other.select(*meet).distinct(), meet)
        apart = sum((F.pow(F.col(k) - F.col(f"b{k}"), F.lit(2.0)) for k in at), F.lit(0.0))
        asked = left.join(boxes, wide).select(*at, "n", *meet)
        near = asked.join(other, [*[asked[k] == other[k] for k in meet], apart <= distance * distance], "left_semi").select(*at, "n").distinct()
        both = told.select("n", F.when(F.col("same"), F.col("n")).alias("hit")).unionByName(near.select(F.lit(0).cast("long").alias("n"), F.col("n").alias("hit")))
        return both.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.sum("n").alias("n"))

    found, truth = checkpointed(boxed(found)), checkpointed(boxed(truth))
    p, q = share(found, truth).select(F.lit(0).alias("k"), F.try_divide("hits", "n").alias("precision")), share(truth, found).select(F.lit(0).alias("k"), F.try_divide("hits", "n").alias("recall"))
    return p.join(q, "k").select("precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f_score"))
