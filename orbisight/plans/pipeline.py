"""Operators as named stages with parameters, composed into pipelines that are kept as JSON.

A stage takes the cells of a stack of panoramas and gives cells, or a table that ends the pipeline.  ``fields`` runs stages
side by side on the same cells and attaches each result as a column; ``select`` reads another column as the value.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import aggregate as A, regions as R, stencil as S
from ..sources import archive
from ..sources.tables import HEIGHT as H, WIDTH as W

STEP = 2 * G.PI / W
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def _table(cells: DataFrame, kernel: list[list[float]]) -> DataFrame:
    return S.row_table(cells.sparkSession, H, W, S.kernel_taps(kernel, STEP))


def _cells(found: DataFrame) -> DataFrame:
    return found.select("y", "x", "value", F.lit(True).alias("valid"))


def _filtered(cells: DataFrame, kernel: list[list[float]], kind: str, invalid_policy: str) -> DataFrame:
    """``renormalize`` works with the valid taps; ``propagate`` leaves out cells that miss one."""
    found = S.filtered(S.gather(cells, _table(cells, kernel), H, W), kind)
    if invalid_policy not in ("renormalize", "propagate"):
        raise ValueError(invalid_policy)
    taps = sum(len(row) for row in kernel)
    return _cells(found.where(F.col("taps") == taps) if invalid_policy == "propagate" else found)


@stage
def filter2d(cells: DataFrame, kernel: list[list[float]], invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, kernel, "sum", invalid_policy)


@stage
def box_blur(cells: DataFrame, size: int = 3, invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, [[1 / size**2] * size] * size, "mean", invalid_policy)


@stage
def gaussian_blur(cells: DataFrame, size: int = 5, sigma: float = 1.0, invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, S.gaussian_kernel(size, sigma), "mean", invalid_policy)


@stage
def median_blur(cells: DataFrame, size: int = 3, invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, [[1.0] * size] * size, "median", invalid_policy)


@stage
def max_pool(cells: DataFrame, size: int = 3, invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, [[1.0] * size] * size, "max", invalid_policy)


@stage
def sobel(cells: DataFrame, axis: str = "east", invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, {"east": S.SOBEL_EAST, "north": S.SOBEL_NORTH}[axis], "sum", invalid_policy)


@stage
def gradient(cells: DataFrame, invalid_policy: str = "renormalize") -> DataFrame:
    """Magnitude of both derivatives."""
    e, n = sobel(cells, "east", invalid_policy), sobel(cells, "north", invalid_policy)
    return e.withColumnRenamed("value", "e").join(n.select("y", "x", F.col("value").alias("n")), ["y", "x"]).select("y", "x", F.hypot("e", "n").alias("value"), "valid")


@stage
def laplacian(cells: DataFrame, invalid_policy: str = "renormalize") -> DataFrame:
    return _filtered(cells, S.LAPLACE, "sum", invalid_policy)


@stage
def bilateral(cells: DataFrame, size: int = 5, sigma_color: float = 25.0, sigma_space: float = 1.5) -> DataFrame:
    return _cells(S.bilateral(cells, _table(cells, spatial_kernel(size, sigma_space)), H, W, sigma_color))


@stage
def dilate(cells: DataFrame, radius_deg: float = 6.0) -> DataFrame:
    return _morphology(cells, radius_deg, "dilate")


@stage
def erode(cells: DataFrame, radius_deg: float = 6.0) -> DataFrame:
    return _morphology(cells, radius_deg, "erode")


def _morphology(cells: DataFrame, radius_deg: float, kind: str) -> DataFrame:
    taps = S.disk_taps(G.math.radians(radius_deg), STEP, G.PI / H)
    return _cells(S.morphology(cells, S.row_table(cells.sparkSession, H, W, taps), H, W, kind))


@stage
def rotate(cells: DataFrame, axis: list[float], radians: float) -> DataFrame:
    """The panoramas turned about an axis, nearest cell."""
    panos = cells.select(F.floor(F.col("y") / H).alias("pano")).distinct()
    each = panos.select("pano", F.explode(F.sequence(F.lit(0), F.lit(H * W - 1))).alias("id")).select("pano", F.floor(F.col("id") / W).cast("int").alias("oy"), (F.col("id") % W).cast("int").alias("ox"))
    turned = G.rotate(G.axis_rotation(tuple(axis), radians), G.erp_pixel_to_ray(F.col("ox"), F.col("oy"), H, W))
    at = each.withColumn("p", G.ray_to_erp_pixel(turned, H, W))
    found = S.resample_nearest(cells, at, F.round("p.x", 9), F.round("p.y", 9), H, W)
    return found.select((F.col("pano") * H + F.col("oy")).cast("int").alias("y"), F.col("ox").alias("x"), "value", "valid")


@stage
def area_average(cells: DataFrame) -> DataFrame:
    weighted = cells.where("valid").withColumn("area", G.row_area(F.col("y"), H, W))
    return weighted.agg(A.weighted_mean(F.col("value"), F.col("area")).alias("value"), F.count(F.lit(1)).alias("cells"))


@stage
def area_histogram(cells: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    return A.histogram(cells.where("valid").withColumn("area", G.row_area(F.col("y"), H, W)), "value", F.col("area"), low, high, bins)


@stage
def analyze_regions(cells: DataFrame, label: str = "label") -> DataFrame:
    return R.measure(cells, H, W, label)


@stage
def threshold(cells: DataFrame, least: float) -> DataFrame:
    return cells.withColumn("valid", F.col("valid") & (F.col("value") >= least))


@stage
def select(cells: DataFrame, column: str) -> DataFrame:
    """Another column as the value."""
    return cells.withColumn("value", F.col(column))


@stage
def fields(cells: DataFrame, **branches: list) -> DataFrame:
    """Several pipelines on the same cells, each attached as a column under its name."""
    out = cells
    for name, stages in branches.items():
        made = Pipeline.from_config(stages)(cells).select("y", "x", F.col("value").alias(name))
        out = out.join(made, ["y", "x"], "left")
    return out


def spatial_kernel(size: int, sigma: float) -> list[list[float]]:
    """exp(-d^2 / 2 sigma^2) by distance in steps from the middle."""
    return [[G.math.exp(-((i - size // 2) ** 2 + (j - size // 2) ** 2) / (2 * sigma * sigma)) for j in range(size)] for i in range(size)]


@dataclass(frozen=True)
class Stage:
    name: str
    parameters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.name not in REGISTRY:
            raise ValueError(f"unknown stage {self.name}")

    def __call__(self, cells: DataFrame) -> DataFrame:
        return REGISTRY[self.name](cells, **self.parameters)


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]

    @classmethod
    def of(cls, *stages: Stage) -> Pipeline:
        return cls(tuple(stages))

    @classmethod
    def from_config(cls, config: list) -> Pipeline:
        return cls(tuple(Stage(x["stage"], dict(x.get("parameters", {}))) for x in config))

    def to_config(self) -> list:
        return [{"stage": s.name, "parameters": s.parameters} for s in self.stages]

    def save(self, spark, path: str) -> None:  # noqa: ANN001
        """As JSON in a one-row table, so that it can lie wherever Spark writes."""
        spark.createDataFrame([(json.dumps(self.to_config(), sort_keys=True),)], "config string").write.mode("errorifexists").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Pipeline:  # noqa: ANN001
        return cls.from_config(json.loads(spark.read.parquet(path).first().config))

    def __call__(self, cells: DataFrame) -> DataFrame:
        for s in self.stages:
            cells = s(cells)
        return cells

    def cached(self, cells: DataFrame) -> DataFrame:
        """The result by identity of configuration and input, written once to the shared folder."""
        return archive.kept(self.to_config(), self, cells)
