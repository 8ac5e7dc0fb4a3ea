"""Queries over fused masks and overlaps; each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import aggregate as A
from ..sources.tables import AREA, CELLS, EVIDENCE, OBSERVATIONS, cells, evidence, observations, read, with_area
from .area import r

MIN_OVERLAP = 20


def weighted_quantiles(spark, d: str) -> DataFrame:
    q = read(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return A.weighted_quantile(q, ["l_returnflag"], "l_extendedprice", "l_quantity", 0.75)


def mask_majority(spark, d: str) -> DataFrame:
    return A.majority_and_envelope(evidence(spark, d), "cell", F.col("view") % 3, F.col("valid"))


def weighted_region_iou(spark, d: str) -> DataFrame:
    """Solid-angle IoU of two masks over the supported cells."""
    c = with_area(cells(spark, d)).where("valid")
    m = A.binary_metrics(c, F.col("value") > 40, F.col("x") < 64, F.col("area"))
    return m.select(r("iou").alias("iou"))


def overlap_graph(spark, d: str) -> DataFrame:
    """Pairs of views that share enough valid cells, and the cells they share."""
    e = evidence(spark, d).where("valid").select("cell", "view")
    pairs = e.select("cell", F.col("view").alias("view_a")).join(e.select("cell", F.col("view").alias("view_b")), "cell").where("view_a < view_b")
    return pairs.groupBy("view_a", "view_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= MIN_OVERLAP)


def direction_errors(spark, d: str) -> DataFrame:
    """Degrees between each bearing and the +z axis, with and without regard to sign."""
    cosine = F.cos("lon") * F.cos("lat")
    o = observations(spark, d)
    degrees = lambda c: r(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))), 5)
    return o.select("id", degrees(cosine).alias("error"), degrees(F.abs(cosine)).alias("unsigned_error"))


def contribution_ids(spark, d: str) -> DataFrame:
    """Weighted mean, the view that weighs most (the first among equals) and the number of views in each cell."""
    w = F.exp(6 * (F.cos((F.col("cell") % 97) * G.PI / 97 - F.col("view") * G.PI / 8) - 1))
    e = evidence(spark, d).where("valid").withColumn("w", w)
    s = e.groupBy("cell").agg(A.weighted_mean(F.col("value"), F.col("w")).alias("m"), F.max_by("view", F.struct(F.round("w", 9), -F.col("view"))).alias("view"), F.count(F.lit(1)).alias("views"))
    return s.select("cell", r("m", 5).alias("blended"), "view", "views")


_W = "exp(6*(cos((cell % 97)*pi()/97 - view*pi()/8) - 1))"

QUERIES = {
    "weighted_quantiles": (weighted_quantiles, "WITH g AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS u, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM g) SELECT l_returnflag, min(v) AS weighted_quantile FROM c WHERE u >= t*0.75 GROUP BY 1"),
    "mask_majority": (mask_majority, f"WITH {EVIDENCE}, m AS (SELECT cell, view % 3 AS k, bool_or(valid) AS s FROM evidence GROUP BY 1, 2) SELECT cell, count(*) FILTER (WHERE s) >= 2 AS majority, bool_or(s) AS envelope FROM m GROUP BY 1"),
    "weighted_region_iou": (weighted_region_iou, f"WITH {CELLS}, a AS (SELECT {AREA} AS area, value > 40 AS p, x < 64 AS q FROM cells WHERE valid) SELECT round(CASE WHEN sum(CASE WHEN p OR q THEN area ELSE 0 END) > 0 THEN sum(CASE WHEN p AND q THEN area ELSE 0 END)/sum(CASE WHEN p OR q THEN area ELSE 0 END) ELSE 1 END,6) AS iou FROM a"),
    "overlap_graph": (overlap_graph, f"WITH {EVIDENCE} SELECT a.view AS view_a, b.view AS view_b, count(*) AS shared FROM evidence a JOIN evidence b ON a.cell = b.cell AND a.view < b.view WHERE a.valid AND b.valid GROUP BY 1, 2 HAVING count(*) >= {MIN_OVERLAP}"),
    "direction_errors": (direction_errors, f"WITH {OBSERVATIONS}, c AS (SELECT id, greatest(-1.0, least(1.0, cos(lon)*cos(lat))) AS c FROM observations) SELECT id, round(degrees(acos(c)),5) AS error, round(degrees(acos(abs(c))),5) AS unsigned_error FROM c"),
    "contribution_ids": (contribution_ids, f"WITH {EVIDENCE}, k AS (SELECT *, {_W} AS w, row_number() OVER (PARTITION BY cell ORDER BY round({_W},9) DESC, view) AS n FROM evidence WHERE valid) SELECT cell, round(sum(w*value)/sum(w),5) AS blended, max(CASE WHEN n = 1 THEN view END) AS view, count(*) AS views FROM k GROUP BY cell"),
}
