"""View planners: rows of directions and perspective views from a layout."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The six canonical directions (name, lat, lon) in order.
CUBE = (("front", 0.0, 0.0), ("right", 0.0, 90.0), ("back", 0.0, 180.0), ("left", 0.0, -90.0), ("up", 90.0, 0.0), ("down", -90.0, 0.0))


def cube(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, a, o) for k, (n, a, o) in enumerate(CUBE)], "view int, name string, lat_deg double, lon_deg double")


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """Golden-ratio spiral through k = i + 1/2: height 1 - 2 k / n, longitude 2 pi k / phi brought to (-180, 180]."""
    k = F.col("id") + 0.5
    turn = k * (2 * math.pi / ((1 + math.sqrt(5)) / 2))
    return spark.range(n).select(F.col("id").alias("view"), F.degrees(F.asin(1 - 2 * k / n)).alias("lat_deg"), F.degrees(F.atan2(F.sin(turn), F.cos(turn))).alias("lon_deg"))


def spiral(spark: SparkSession, n: int) -> DataFrame:
    """n even steps t from 0 to 1: latitude acos(1 - 2 t) - 90, longitude sqrt(n) turns of t, from -180 on."""
    t = F.col("id") / float(max(1, n - 1))
    return spark.range(n).select(F.col("id").alias("view"), (F.degrees(F.acos(1 - 2 * t)) - 90).alias("lat_deg"), (F.pmod(360 * math.sqrt(n) * t, F.lit(360.0)) - 180).alias("lon_deg"))


def icosahedron(spark: SparkSession, subdivisions: int = 0) -> DataFrame:
    """Vertices of the icosahedron and of its midpoint subdivisions, by latitude and longitude."""
    g = (1 + math.sqrt(5)) / 2
    points = [(s * a, t * b, 0.0) for s in (1, -1) for t in (1, -1) for a, b in ((1, g),)]
    points = [p for q in points for p in (q, (q[2], q[0], q[1]), (q[1], q[2], q[0]))]
    scale = lambda p: tuple(v / math.sqrt(sum(w * w for w in p)) for v in p)
    points = [scale(p) for p in points]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(subdivisions):
        edge = min(apart(a, b) for k, a in enumerate(points) for b in points[:k])
        middle = [scale(tuple(x + y for x, y in zip(a, b, strict=True))) for k, a in enumerate(points) for b in points[:k] if apart(a, b) < 1.6 * edge]
        points += [m for k, m in enumerate(middle) if all(apart(m, o) > 1e-9 for o in middle[:k])]
    rows = sorted((round(math.degrees(math.asin(p[1])), 9), round(math.degrees(math.atan2(p[0], p[2])), 9)) for p in points)
    return spark.createDataFrame([(k, a, o) for k, (a, o) in enumerate(rows)], "view int, lat_deg double, lon_deg double")


def anchors(regions: DataFrame, scales: tuple[float, ...], aspects: tuple[float, ...], low: float, high: float) -> DataFrame:
    """Field-of-view anchors: scale by aspect around each region, clamped; equal ones keep the best score."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a")) for s in scales for a in aspects])).alias("g")
    clamp = lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    made = regions.select("id", "score", "hfov", "vfov", grid).select(
        "id", F.round(clamp(F.col("hfov") * F.col("g.s") * F.sqrt("g.a")), 9).alias("hfov"), F.round(clamp(F.col("vfov") * F.col("g.s") / F.sqrt("g.a")), 9).alias("vfov"),
        (F.col("score") * F.exp(-0.15 * (F.abs(F.log("g.s")) + 0.5 * F.abs(F.log("g.a"))))).alias("score"),
    )
    return made.groupBy("id", "hfov", "vfov").agg(F.max("score").alias("score"))


def blue_noise(spark: SparkSession, n: int, least_deg: float, seed: int = 0) -> DataFrame:
    """Seeded uniform directions of which none lies nearer than ``least_deg`` to one before it."""
    from .match import angular_suppression

    lon, lat = (F.rand(seed) * 2 - 1) * math.pi, F.asin(F.rand(seed + 1) * 2 - 1)
    drawn = spark.range(0, n, 1, 1).select("id", F.lit(0).alias("g"), F.lit(0.0).alias("score"), lon.alias("lon"), lat.alias("lat"))
    kept = angular_suppression(drawn, "g", math.radians(least_deg))
    return kept.select(F.col("id").alias("view"), F.degrees("lat").alias("lat_deg"), F.degrees("lon").alias("lon_deg"))
