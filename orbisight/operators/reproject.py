"""Perspective views of panoramas and panoramas from views: lattices, frustum predicates and equi-joins on pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from . import distance as D, stencil as S

#: Name, latitude and longitude in degrees.
Layout = Sequence[tuple[str, float, float]]


def _views(layout: Layout) -> Column:
    """A row for each view with its right, up and forward axes; a layout has a few fixed views."""
    made = []
    for k, (_, lat, lon) in enumerate(layout):
        axes = G.view_basis(lat, lon)
        made.append(F.struct(F.lit(k).alias("view"), *[F.lit(axis[j]).alias(f"{n}{c}") for n, axis in zip("ruf", axes, strict=True) for j, c in enumerate("xyz")]))
    return F.explode(F.array(*made)).alias("b")


def _axis(name: str) -> Column:
    return G.ray(*[F.col(f"{name}{c}") for c in "xyz"])


def face_rays(spark: SparkSession, layout: Layout, fov_deg: float, size: int) -> DataFrame:
    """(view, v, u, ray): every pixel of square views, the same for every panorama."""
    each = spark.range(size * size).select("id", _views(layout)).select("id", "b.*")
    focal, middle = size / (2 * G.math.tan(G.math.radians(fov_deg) / 2)), (size - 1) / 2
    v, u = F.floor(F.col("id") / size), F.col("id") % size
    a, b = (u - middle) / focal, (middle - v) / focal
    ray = G.unit(G.ray(*[a * F.col(f"r{c}") + b * F.col(f"u{c}") + F.col(f"f{c}") for c in "xyz"]))
    return each.select("view", v.cast("int").alias("v"), u.cast("int").alias("u"), ray.alias("ray"))


def extract(cells: DataFrame, layout: Layout, fov_deg: float, size: int, height: int, width: int, how: str = "nearest") -> DataFrame:
    """(pano, view, v, u, value ..): views sampled from the panoramas, nearest (with ``valid``) or bilinear over valid corners."""
    pixel = G.ray_to_erp_pixel(F.col("ray"), height, width)
    targets = face_rays(cells.sparkSession, layout, fov_deg, size).withColumn("p", pixel)
    x, y = F.round("p.x", 9), F.round("p.y", 9)
    rows = len(layout) * size * size
    if how == "nearest":
        return S.resample_nearest(cells, targets, x, y, height, width, rows).drop("p", "ray")
    return S.resample_bilinear(cells, targets, ["pano", "view", "v", "u"], x, y, height, width, rows)


def footprints(spark: SparkSession, layout: Layout, fov_deg: float, size: int, height: int, width: int) -> DataFrame:
    """(y, x, view, v, u, dot): the pixel of every view that sees a cell of a panorama, and how near its axis the cell lies."""
    y, x = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    rays = spark.range(height * width).select(y.alias("y"), x.alias("x")).withColumn("ray", G.erp_pixel_to_ray(F.col("x"), F.col("y"), height, width))
    seen = rays.select("y", "x", "ray", _views(layout)).select("y", "x", "ray", "b.*")
    focal, middle = size / (2 * G.math.tan(G.math.radians(fov_deg) / 2)), (size - 1) / 2
    ahead = G.dot(F.col("ray"), _axis("f"))
    seen = seen.withColumn("dot", F.round(ahead, 12)).where("dot > 0.01")
    u = F.round(focal * G.dot(F.col("ray"), _axis("r")) / ahead + middle, 9)
    v = F.round(middle - focal * G.dot(F.col("ray"), _axis("u")) / ahead, 9)
    seen = seen.select("y", "x", "view", "dot", u.alias("u"), v.alias("v")).where(F.col("u").between(-0.5, size - 0.5) & F.col("v").between(-0.5, size - 0.5))
    clamp = lambda c: F.least(G.nearest(F.col(c)), F.lit(size - 1)).cast("int").alias(c)
    return seen.select("y", "x", "view", "dot", clamp("v"), clamp("u"))


def reconstruct(faces: DataFrame, layout: Layout, fov_deg: float, size: int, height: int, width: int, method: str = "average") -> DataFrame:
    """(y, x, value, support): cells of the stack from all views that see them.

    By average, gaussian (of the angle to the axis), nearest_axis (the least such angle), or by how deep a cell lies in what
    a view sees: feathering and closest.
    """
    sees = S.lattice(footprints(faces.sparkSession, layout, fov_deg, size, height, width), len(layout) * height * width)
    found = faces.where("valid").join(sees, ["view", "v", "u"])
    if method in ("feathering", "closest"):
        made = D.blend_by_depth(found.select("pano", "view", "y", "x", "value"), ["pano"], height, width, method)
    else:
        weight = {"average": F.lit(1.0), "gaussian": F.exp(6 * (F.col("dot") - 1)), "nearest_axis": F.lit(1.0)}[method]
        mean = F.sum(weight * F.col("value")) / F.sum(weight)
        best = F.min_by("value", F.struct(-F.col("dot"), F.col("view")))
        made = found.groupBy("pano", "y", "x").agg((best if method == "nearest_axis" else mean).alias("value"), F.count(F.lit(1)).alias("support"))
    return made.select((F.col("pano") * height + F.col("y")).cast("int").alias("y"), "x", "value", "support")
