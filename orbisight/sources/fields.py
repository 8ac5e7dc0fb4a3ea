"""Panoramas from constants, functions of the ray and arrays; values sampled at rays; crops, pastes, reflections; typed rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G


def from_field(spark: SparkSession, panos: int, height: int, width: int, value: Callable[[Column], Column]) -> DataFrame:
    """A stack whose cells hold a function of their ray; rows are made on the executors."""
    y, x = F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x")
    cells = spark.range(panos * height * width).select(y, x)
    return cells.select("y", "x", value(G.erp_pixel_to_ray(F.col("x"), F.col("y"), height, width)).alias("value"), F.lit(True).alias("valid"))


def constant(spark: SparkSession, panos: int, height: int, width: int, value: float) -> DataFrame:
    return from_field(spark, panos, height, width, lambda _: F.lit(float(value)))


def from_array(spark: SparkSession, values: np.ndarray) -> DataFrame:
    """The cells of one array of the driver, (rows, columns); NaN is not valid."""
    y, x = np.indices(values.shape)
    rows = zip(y.ravel().tolist(), x.ravel().tolist(), values.astype(float).ravel().tolist(), (~np.isnan(values.astype(float))).ravel().tolist(), strict=True)
    return spark.createDataFrame(list(rows), "y int, x int, value double, valid boolean")


def sampled(cells: DataFrame, rays: DataFrame, columns: Sequence[str], height: int, width: int) -> DataFrame:
    """``rays`` (pano, ray, ..) with the columns of the cell that each falls on: one join for all columns."""
    at = rays.withColumn("_p", G.ray_to_erp_pixel(F.col("ray"), height, width))
    at = at.withColumn("_x", F.pmod(G.nearest(F.round("_p.x", 9)), F.lit(width)).cast("int"))
    at = at.withColumn("_y", (F.col("pano") * height + F.least(F.greatest(G.nearest(F.round("_p.y", 9)), F.lit(0)), F.lit(height - 1))).cast("int"))
    return at.join(cells.select(F.col("y").alias("_y"), F.col("x").alias("_x"), *columns), ["_y", "_x"]).drop("_p", "_x", "_y", "ray")


def cropped(cells: DataFrame, height: int, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """A window of every panorama; the stack keeps its row numbers."""
    return cells.where(G.row_in(F.col("y"), height).between(top, top + rows - 1) & F.col("x").between(left, left + columns - 1))


def pasted(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Cells of the patch where it is valid, of the base elsewhere."""
    over = patch.where("valid").select("y", "x", F.col("value").alias("_v"))
    both = base.join(over, ["y", "x"], "left")
    return both.select("y", "x", F.coalesce("_v", "value").alias("value"), (F.col("valid") | F.col("_v").isNotNull()).alias("valid"))


def transposed(cells: DataFrame, height: int, width: int, method: str) -> DataFrame:
    """Named reflections: flip_longitude, flip_latitude, and antipodal, which turns by half and flips the latitude."""
    y, x = F.col("y") + height - 1 - 2 * G.row_in(F.col("y"), height), F.col("x")
    moved = {"flip_longitude": (F.col("y"), width - 1 - x), "flip_latitude": (y, x), "antipodal": (y, (x + width // 2) % width)}[method]
    return cells.withColumns({"y": moved[0].cast("int"), "x": moved[1].cast("int")})


def encoded(df: DataFrame, kind: str) -> DataFrame:
    """(kind, body): each row as JSON under the name of its kind."""
    return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))


def decoded(df: DataFrame, kind: str, schema: str) -> DataFrame:
    """Rows of a kind back from JSON; a row of another kind or that doesn't fit the schema raises."""
    fits = F.assert_true(F.col("kind") == kind, F.lit(f"a row is not of kind {kind}"))
    return df.select(F.from_json("body", schema, {"mode": "FAILFAST"}).alias("row"), fits.alias("_fits")).where("_fits IS NULL").select("row.*")
