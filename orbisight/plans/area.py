"""Queries over the lattice: geometry, areas, blends, regions; each with the SQL that gives the same rows."""

from __future__ import annotations

import math as _m

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..operators import aggregate as A, regions as R
from ..sources.tables import AREA, CELLS, EVIDENCE, HEIGHT as H, OBSERVATIONS, WIDTH as W, cells, evidence, observations, read, with_area

LON, LAT = "(2*pi()*(x+0.5)/128 - pi())", "(pi()/2 - pi()*(y%64+0.5)/64)"
RAY = f"sin({LON})*cos({LAT}) AS rx, sin({LAT}) AS ry, cos({LON})*cos({LAT}) AS rz"
RAYS = f"{CELLS}, rays AS (SELECT *, {RAY} FROM cells)"


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _rays(spark, d: str) -> DataFrame:
    return cells(spark, d).withColumn("ray", G.erp_pixel_to_ray(F.col("x"), F.col("y"), H, W))


def area_weighted_region_measure(spark, d: str) -> DataFrame:
    m = R.measure(cells(spark, d), H, W)
    return m.select("label", "cells", r("area").alias("area"), r("share").alias("share"), r("mean_value").alias("mean_value"), *[r(f"c{k}").alias(f"c{k}") for k in "xyz"])


def erp_rays(spark, d: str) -> DataFrame:
    return _rays(spark, d).select("y", "x", *[r(F.col("ray")[k], 9).alias(f"r{k}") for k in "xyz"])


def ray_pixels(spark, d: str) -> DataFrame:
    o = observations(spark, d).withColumn("p", G.ray_to_erp_pixel(G.ray_of(F.col("lon"), F.col("lat")), H, W))
    return o.select("id", r("p.x").alias("px"), r("p.y").alias("py"), F.col("p.valid").alias("valid"))


VIEW = G.view_basis(20.0, 35.0)


def _vector(axis: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"({v!r}::DOUBLE)*r{k}" for v, k in zip(axis, "xyz", strict=True)) + ")"


def gnomonic_pixels(spark, d: str) -> DataFrame:
    p = _rays(spark, d).withColumn("p", G.gnomonic_pixel(F.col("ray"), VIEW, 90.0, 60.0, 48, 64))
    return p.where("p.valid").select("y", "x", r("p.u").alias("u"), r("p.v").alias("v"))


def gnomonic_rays(spark, d: str) -> DataFrame:
    ray = G.gnomonic_ray(F.col("id") % 64, F.floor(F.col("id") / 64), VIEW, 90.0, 60.0, 48, 64)
    return spark.range(48 * 64).select(F.col("id").alias("pixel"), ray.alias("a")).select("pixel", *[r(F.col("a")[k], 9).alias(f"r{k}") for k in "xyz"])


def cube_face_select(spark, d: str) -> DataFrame:
    """Each cell's cube face: the largest of the six signed axes, the first canonical one among ties."""
    ray = F.col("ray")
    faces = [("front", ray["z"]), ("right", ray["x"]), ("back", -ray["z"]), ("left", -ray["x"]), ("up", ray["y"]), ("down", -ray["y"])]
    best = F.greatest(*[F.round(v, 12) for _, v in faces])
    pick = F.coalesce(*[F.when(F.round(v, 12) == best, F.lit(n)) for n, v in faces])
    return _rays(spark, d).withColumn("face", pick).groupBy("face").agg(F.count(F.lit(1)).alias("cells"), r(F.sum("value"), 3).alias("total"))


def tangent_offsets(spark, d: str) -> DataFrame:
    a = G.tangent_offset_ray(F.col("ray"), F.lit(0.1), F.lit(-0.05))
    return _rays(spark, d).select("y", "x", a.alias("a")).select("y", "x", *[r(F.col("a")[k], 8).alias(f"r{k}") for k in "xyz"])


def pinhole_project(spark, d: str) -> DataFrame:
    p = _rays(spark, d).withColumn("p", G.pinhole_pixel(F.col("ray"), 50.0, 52.0, 31.5, 23.5)).where("p.valid AND ray.z > 0.01")
    return p.select("y", "x", r("p.u").alias("u"), r("p.v").alias("v"))


def fisheye_project(spark, d: str) -> DataFrame:
    p = _rays(spark, d).withColumn("p", G.fisheye_pixel(F.col("ray"), 40.0, 63.5, 63.5, (0.01, -0.002, 0.0, 0.0)))
    return p.select("y", "x", r("p.u").alias("u"), r("p.v").alias("v"))


def angular_errors(spark, d: str) -> DataFrame:
    rotated = G.rotate(G.axis_rotation((0.0, 1.0, 0.0), 0.3), F.col("ray"))
    return _rays(spark, d).select("y", "x", r(G.angle(F.col("ray"), rotated), 8).alias("angle"))


def world_points(spark, d: str) -> DataFrame:
    """Camera rays to world points: X = C + range R' ray."""
    m = G.axis_rotation((0.0, 1.0, 0.0), -0.7)
    p = _rays(spark, d).withColumn("q", G.rotate(m, F.col("ray")))
    return p.select("y", "x", *[r(F.col("q")[k] * F.col("value") + c, 5).alias(f"w{k}") for k, c in zip("xyz", (1.0, 2.0, 3.0), strict=True)])


def masked_invalid(spark, d: str) -> DataFrame:
    return cells(spark, d).select("y", "x", F.when(F.col("valid"), F.col("value")).alias("value"), F.col("valid").alias("support"))


def area_average(spark, d: str) -> DataFrame:
    return with_area(cells(spark, d)).where("valid").agg(r(A.weighted_mean(F.col("value"), F.col("area"))).alias("area_average"), F.count(F.lit(1)).alias("cells"))


def area_histogram(spark, d: str) -> DataFrame:
    return A.histogram(with_area(cells(spark, d)).where("valid"), "value", F.col("area"), 0.0, 500.0, 25).select("bin", r("area", 8).alias("area"), "n")


def equalize_histogram(spark, d: str) -> DataFrame:
    level = F.least(F.floor(F.col("value")), F.lit(255)).cast("int")
    return A.equalisation(cells(spark, d).where("valid"), level, F.round(F.cos(G.PI / 2 - G.PI * (G.row_in(F.col("y"), H) + 0.5) / H) * 1e6).cast("long").cast("double"))


def measure_by_row(spark, d: str) -> DataFrame:
    return with_area(cells(spark, d)).groupBy("y").agg(r(F.sum("area"), 8).alias("area"), F.count_if("valid").alias("valid_cells"))


def region_adjacency(spark, d: str) -> DataFrame:
    return R.adjacency(cells(spark, d), H, W).select("label_a", "label_b", r("shared", 5).alias("shared"), "edges")


def region_boundaries(spark, d: str) -> DataFrame:
    return R.boundaries(cells(spark, d), H, W)


def region_components(spark, d: str) -> DataFrame:
    return R.label_components(cells(spark, d), H, W).groupBy("component").agg(F.count(F.lit(1)).alias("cells"))


def _blend(method: str, weight: Column | None = None):
    def run(spark, d: str) -> DataFrame:
        return A.blend(evidence(spark, d), method, weight=weight).select("cell", r("blended", 6).alias("blended"), "support")

    return run


WEIGHT_SQL = "exp(6*(cos((cell % 97)*pi()/97 - view*pi()/8) - 1))"


def _gauss() -> Column:
    return F.exp(6 * (F.cos((F.col("cell") % 97) * G.PI / 97 - F.col("view") * G.PI / 8) - 1))


def blend_weighted(spark, d: str) -> DataFrame:
    return _blend("weighted", _gauss())(spark, d)


def blend_closest(spark, d: str) -> DataFrame:
    return _blend("closest", F.round(_gauss(), 9))(spark, d)


def blend_huber(spark, d: str) -> DataFrame:
    return A.robust_blend(evidence(spark, d), 5000.0).select("cell", r("blended", 3).alias("blended"))


def label_vote(spark, d: str) -> DataFrame:
    return A.vote(evidence(spark, d).where("valid"), "cell", F.floor(F.col("value") / 10000).cast("int"))


def overlap_scales(spark, d: str) -> DataFrame:
    """Median log ratio of each pair of views over the cells that both see, from ten cells up."""
    e = evidence(spark, d).where("valid")
    b = e.select("cell", F.col("view").alias("view_b"), F.col("value").alias("vb"))
    pairs = e.select("cell", F.col("view").alias("view_a"), F.col("value").alias("va")).join(b, "cell").where("view_a < view_b")
    return pairs.groupBy("view_a", "view_b").agg(r(F.median(F.log(F.col("va") / F.col("vb")))).alias("log_ratio"), F.count(F.lit(1)).alias("n")).where("n >= 10")


def fused_range(spark, d: str) -> DataFrame:
    """Weighted range, its disagreement, and the number of contributors."""
    w, v = _gauss(), F.col("value") / 1000
    s = evidence(spark, d).where("valid").groupBy("cell").agg(F.sum(w).alias("sw"), F.sum(w * v).alias("swr"), F.sum(w * v * v).alias("swrr"), F.count(F.lit(1)).alias("n"))
    mean = F.col("swr") / F.col("sw")
    return s.where("sw > 1e-6").select("cell", r(mean, 5).alias("range"), r(F.sqrt(F.greatest(F.lit(0.0), F.round(F.col("swrr") / F.col("sw") - mean * mean, 7))), 2).alias("disagreement"), "n")


def weighted_medians(spark, d: str) -> DataFrame:
    q = read(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    return A.weighted_median(q, ["l_returnflag"], "l_extendedprice", "l_quantity")


def voxel_blend(spark, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_discount").alias("y"), (F.col("l_quantity") / 10).alias("z"), F.col("l_quantity").alias("w"))
    v = A.voxel_blend(p, 5.0)
    return v.select("kx", "ky", "kz", r("weight", 3).alias("weight"), *[r(k, 5).alias(k) for k in "xyz"])


def binary_region_metrics(spark, d: str) -> DataFrame:
    m = A.binary_metrics(read(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 0, F.lit(1.0))
    return m.select(*[r(c).alias(c) for c in m.columns])


def range_metrics(spark, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").where("l_extendedprice > 0")
    m = A.range_metrics(p, F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"), F.col("l_quantity"))
    return m.select(*[r(c, 4).alias(c) for c in ("mae", "rmse", "abs_rel", "delta_1")], "n")


def transpose_antipodal(spark, d: str) -> DataFrame:
    return cells(spark, d).select((F.col("y") + H - 1 - 2 * G.row_in(F.col("y"), H)).alias("y"), ((F.col("x") + W // 2) % W).alias("x"), "value")


def epipolar_errors(spark, d: str) -> DataFrame:
    e = [[0.0, -0.3, 0.2], [0.3, 0.0, -0.9], [-0.2, 0.9, 0.0]]
    b = G.rotate(G.axis_rotation((0.0, 1.0, 0.0), 0.1), F.col("ray"))
    return _rays(spark, d).select("y", "x", r(G.epipolar_residual(F.col("ray"), b, e), 7).alias("residual"))


def luma_of_parts(spark, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", r(G.luma(F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 255), 4).alias("luma"))


_E = "((-0.3)*ry + 0.2*rz)", "(0.3*rx - 0.9*rz)", "((-0.2)*rx + 0.9*ry)"
_NEIGHBOURS = f"""{CELLS}, pairs AS (SELECT a.y, a.x, a.label, b.label AS other, pi()/64 AS edge, b.y AS ny, b.x AS nx FROM cells a JOIN cells b ON b.y = a.y AND b.x = (a.x + 1) % 128
 UNION ALL SELECT a.y, a.x, a.label, b.label, 2*pi()/128*abs(cos(pi()/2 - pi()*(a.y%64+1)/64)), b.y, b.x FROM cells a JOIN cells b ON b.y = a.y + 1 AND b.x = a.x AND b.y % 64 > 0)"""


def _blend_sql(expression: str) -> str:
    return f"WITH {EVIDENCE} SELECT cell, round({expression}, 6) AS blended, count(*) FILTER (WHERE valid) AS support FROM evidence GROUP BY cell"


_V = "CASE WHEN valid THEN value END"

_FX, _FY = 64 / (2 * _m.tan(_m.radians(90) / 2)), 48 / (2 * _m.tan(_m.radians(60) / 2))
_GN = "SELECT id AS pixel, " + ", ".join(f"(a*({VIEW[0][k]!r}::DOUBLE) + b*({VIEW[1][k]!r}::DOUBLE) + ({VIEW[2][k]!r}::DOUBLE)) AS q{c}" for k, c in enumerate("xyz")) + f" FROM (SELECT id, (id % 64 - 31.5)/({_FX!r}::DOUBLE) AS a, (23.5 - id // 64)/({_FY!r}::DOUBLE) AS b FROM range(3072) t(id))"
_ROT1 = G.axis_rotation((0.0, 1.0, 0.0), 0.1)
_ROT7 = G.axis_rotation((0.0, 1.0, 0.0), -0.7)


def _times(m: list, a: str) -> list[str]:
    return ["(" + " + ".join(f"({float(v)!r}::DOUBLE)*{a}{c}" for v, c in zip(row, "xyz", strict=True)) + ")" for row in m]


_RO, _R1, _R7 = _times(G.axis_rotation((0.0, 1.0, 0.0), 0.3), "r"), _times(_ROT1, "r"), _times(_ROT7, "r")

QUERIES = {
    "area_weighted_region_measure": (area_weighted_region_measure, f"""WITH {RAYS}, s AS (SELECT label, count(*) AS cells, sum({AREA}) AS area, sum(value*{AREA})/sum({AREA}) AS mean_value, sum({AREA}*rx) AS sx, sum({AREA}*ry) AS sy, sum({AREA}*rz) AS sz FROM rays GROUP BY label)
 SELECT label, cells, round(area,6) AS area, round(area/(4*pi()),6) AS share, round(mean_value,6) AS mean_value, round(sx/sqrt(sx*sx+sy*sy+sz*sz),6) AS cx, round(sy/sqrt(sx*sx+sy*sy+sz*sz),6) AS cy, round(sz/sqrt(sx*sx+sy*sy+sz*sz),6) AS cz FROM s"""),
    "erp_rays": (erp_rays, f"WITH {RAYS} SELECT y, x, round(rx,9) AS rx, round(ry,9) AS ry, round(rz,9) AS rz FROM rays"),
    "ray_pixels": (ray_pixels, f"""WITH {OBSERVATIONS}, b AS (SELECT id, atan2(sin(lon)*cos(lat), cos(lon)*cos(lat)) AS o, asin(sin(lat)) AS a FROM observations), c AS (SELECT id, (o+pi())/(2*pi())*128-0.5 AS u, (pi()/2-a)/pi()*64-0.5 AS v FROM b)
 SELECT id, round(u - 128*floor(u/128),6) AS px, round(v,6) AS py, true AS valid FROM c"""),
    "gnomonic_pixels": (gnomonic_pixels, f"""WITH {RAYS}, p AS (SELECT y, x, {_vector(VIEW[0])} AS a, {_vector(VIEW[1])} AS b, {_vector(VIEW[2])} AS f FROM rays), q AS (SELECT y, x, ({_FX!r}::DOUBLE)*a/f + 31.5 AS u, 23.5 - ({_FY!r}::DOUBLE)*b/f AS v FROM p WHERE f > 0)
 SELECT y, x, round(u,6) AS u, round(v,6) AS v FROM q WHERE u BETWEEN -0.5 AND 63.5 AND v BETWEEN -0.5 AND 47.5"""),
    "gnomonic_rays": (gnomonic_rays, f"WITH q AS ({_GN}) SELECT pixel, round(qx/sqrt(qx*qx+qy*qy+qz*qz),9) AS rx, round(qy/sqrt(qx*qx+qy*qy+qz*qz),9) AS ry, round(qz/sqrt(qx*qx+qy*qy+qz*qz),9) AS rz FROM q"),
    "cube_face_select": (cube_face_select, f"""WITH {RAYS}, f AS (SELECT value, round(rz,12) AS a, round(rx,12) AS b, round(-rz,12) AS c, round(-rx,12) AS e, round(ry,12) AS g, round(-ry,12) AS h FROM rays), m AS (SELECT *, greatest(a,b,c,e,g,h) AS t FROM f)
 SELECT CASE WHEN a=t THEN 'front' WHEN b=t THEN 'right' WHEN c=t THEN 'back' WHEN e=t THEN 'left' WHEN g=t THEN 'up' ELSE 'down' END AS face, count(*) AS cells, round(sum(value),3) AS total FROM m GROUP BY 1"""),
    "tangent_offsets": (tangent_offsets, f"""WITH {RAYS}, o AS (SELECT y, x, rx, ry, rz, {LON} AS lon, {LAT} AS lat, sqrt(0.1::DOUBLE*0.1 + 0.05::DOUBLE*0.05) AS t FROM rays), p AS (SELECT *, sin(t)/t AS s FROM o)
 SELECT y, x, round(cos(t)*rx + s*(0.1*cos(lon) - 0.05*(-sin(lon)*sin(lat))),8) AS rx, round(cos(t)*ry + s*(-0.05)*cos(lat),8) AS ry, round(cos(t)*rz + s*(0.1*(-sin(lon)) - 0.05*(-cos(lon)*sin(lat))),8) AS rz FROM p"""),
    "pinhole_project": (pinhole_project, f"WITH {RAYS} SELECT y, x, round(50.0*rx/rz+31.5,6) AS u, round(52.0*ry/rz+23.5,6) AS v FROM rays WHERE rz > 0.01"),
    "fisheye_project": (fisheye_project, f"""WITH {RAYS}, t AS (SELECT *, sqrt(rx*rx+ry*ry) AS s, atan2(sqrt(rx*rx+ry*ry), rz) AS t FROM rays), k AS (SELECT *, CASE WHEN s > 0 THEN 40.0*t*(1+0.01*t*t-0.002*t*t*t*t)/s ELSE 0 END AS f FROM t)
 SELECT y, x, round(f*rx+63.5,6) AS u, round(f*ry+63.5,6) AS v FROM k"""),
    "angular_errors": (angular_errors, f"""WITH {RAYS}, q AS (SELECT y, x, rx, ry, rz, {_RO[0]} AS qx, {_RO[1]} AS qy, {_RO[2]} AS qz FROM rays)
 SELECT y, x, round(atan2(sqrt((ry*qz-rz*qy)*(ry*qz-rz*qy)+(rz*qx-rx*qz)*(rz*qx-rx*qz)+(rx*qy-ry*qx)*(rx*qy-ry*qx)), rx*qx+ry*qy+rz*qz),8) AS angle FROM q"""),
    "world_points": (world_points, f"WITH {RAYS} SELECT y, x, round({_R7[0]}*value+1,5) AS wx, round({_R7[1]}*value+2,5) AS wy, round({_R7[2]}*value+3,5) AS wz FROM rays"),
    "masked_invalid": (masked_invalid, f"WITH {CELLS} SELECT y, x, CASE WHEN valid THEN value END AS value, valid AS support FROM cells"),
    "area_average": (area_average, f"WITH {CELLS} SELECT round(sum(value*{AREA})/sum({AREA}),6) AS area_average, count(*) AS cells FROM cells WHERE valid"),
    "area_histogram": (area_histogram, f"WITH {CELLS} SELECT CAST(least(floor(value/20.0),24) AS INTEGER) AS bin, round(sum({AREA}),8) AS area, count(*) AS n FROM cells WHERE valid AND value BETWEEN 0 AND 500 GROUP BY 1"),
    "equalize_histogram": (equalize_histogram, f"""WITH {CELLS}, s AS (SELECT CAST(least(floor(value),255) AS INTEGER) AS level, sum(round(cos({LAT})*1000000)) AS w FROM cells WHERE valid GROUP BY 1), c AS (SELECT level, sum(w) OVER (ORDER BY level) AS cdf, sum(w) OVER () AS total FROM s), f AS (SELECT *, first_value(cdf) OVER (ORDER BY level) AS h FROM c)
 SELECT level, CAST(coalesce(round_even((cdf-h)*255/nullif(total-h,0),0), level) AS INTEGER) AS mapped FROM f"""),
    "measure_by_row": (measure_by_row, f"WITH {CELLS} SELECT y, round(sum({AREA}),8) AS area, count(*) FILTER (WHERE valid) AS valid_cells FROM cells GROUP BY y"),
    "region_adjacency": (region_adjacency, f"WITH {_NEIGHBOURS} SELECT least(label,other) AS label_a, greatest(label,other) AS label_b, round(sum(edge),5) AS shared, count(*) AS edges FROM pairs WHERE label <> other GROUP BY 1, 2"),
    "region_boundaries": (region_boundaries, f"WITH {_NEIGHBOURS} SELECT y, x FROM pairs WHERE label <> other UNION SELECT ny, nx FROM pairs WHERE label <> other"),
    "region_components": (region_components, f"""WITH RECURSIVE {_NEIGHBOURS}, e AS (SELECT y*128+x AS a, ny*128+nx AS b FROM pairs WHERE label = other UNION ALL SELECT ny*128+nx, y*128+x FROM pairs WHERE label = other), w AS (SELECT y*128+x AS node, y*128+x AS root FROM cells UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node WHERE w.root < e.b), m AS (SELECT node, min(root) AS component FROM w GROUP BY node)
 SELECT CAST(component AS BIGINT) AS component, count(*) AS cells FROM m GROUP BY 1"""),
    "blend_average": (_blend("average"), _blend_sql(f"avg({_V})")), "blend_sum": (_blend("sum"), _blend_sql(f"sum({_V})")), "blend_max": (_blend("max"), _blend_sql(f"max({_V})")), "blend_min": (_blend("min"), _blend_sql(f"min({_V})")),
    "blend_counter": (_blend("counter"), _blend_sql("CAST(count(*) FILTER (WHERE valid) AS DOUBLE)")), "blend_std": (_blend("std"), _blend_sql(f"stddev_pop({_V})")), "blend_median": (_blend("median"), _blend_sql(f"median({_V})")),
    "blend_weighted": (blend_weighted, _blend_sql(f"sum({WEIGHT_SQL}*{_V})/sum(CASE WHEN valid THEN {WEIGHT_SQL} END)")),
    "blend_closest": (blend_closest, f"WITH {EVIDENCE}, k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY valid DESC, round({WEIGHT_SQL},9) DESC, view) AS n FROM evidence) SELECT cell, round(max(CASE WHEN n = 1 AND valid THEN value END),6) AS blended, count(*) FILTER (WHERE valid) AS support FROM k GROUP BY cell"),
    "blend_huber": (blend_huber, f"""WITH {EVIDENCE}, c AS (SELECT cell, median(value) AS m, avg(value) AS a, var_pop(value) AS s FROM evidence WHERE valid GROUP BY cell), j AS (SELECT cell, value, exp(-least(s/1e12,1.0)) AS z, abs(value-m) AS dm, abs(value-a) AS da FROM evidence JOIN c USING (cell) WHERE valid),
 w AS (SELECT cell, value, z*CASE WHEN dm <= 5000 THEN 1.0 ELSE 5000/(dm+1e-6) END AS wm, z*CASE WHEN da <= 5000 THEN 1.0 ELSE 5000/(da+1e-6) END AS wa FROM j)
 SELECT cell, round(0.5*sum(wm*value)/(sum(wm)+1e-6) + 0.5*sum(wa*value)/(sum(wa)+1e-6),3) AS blended FROM w GROUP BY cell"""),
    "label_vote": (label_vote, f"WITH {EVIDENCE}, c AS (SELECT cell, CAST(floor(value/10000) AS INTEGER) AS label, count(*) AS votes FROM evidence WHERE valid GROUP BY 1, 2) SELECT cell, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY votes DESC, label) AS n FROM c) WHERE n = 1"),
    "overlap_scales": (overlap_scales, f"WITH {EVIDENCE} SELECT a.view AS view_a, b.view AS view_b, round(median(ln(a.value/b.value)),6) AS log_ratio, count(*) AS n FROM evidence a JOIN evidence b ON a.cell = b.cell AND a.view < b.view WHERE a.valid AND b.valid GROUP BY 1, 2 HAVING count(*) >= 10"),
    "fused_range": (fused_range, f"WITH {EVIDENCE}, s AS (SELECT cell, sum({WEIGHT_SQL}) AS sw, sum({WEIGHT_SQL}*(value/1000)) AS swr, sum({WEIGHT_SQL}*(value/1000)*(value/1000)) AS swrr, count(*) AS n FROM evidence WHERE valid GROUP BY cell) SELECT cell, round(swr/sw,5) AS range, round(sqrt(greatest(0,round(swrr/sw-(swr/sw)*(swr/sw),7))),2) AS disagreement, n FROM s WHERE sw > 1e-6"),
    "weighted_medians": (weighted_medians, "WITH g AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT l_returnflag, v, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS u, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM g) SELECT l_returnflag, min(v) AS weighted_median FROM c WHERE u >= t/2 GROUP BY 1"),
    "voxel_blend": (voxel_blend, "WITH p AS (SELECT l_extendedprice/1000 AS x, l_discount AS y, l_quantity/10 AS z, l_quantity AS w FROM lineitem) SELECT CAST(floor(x/5) AS BIGINT) AS kx, CAST(floor(y/5) AS BIGINT) AS ky, CAST(floor(z/5) AS BIGINT) AS kz, round(sum(w),3) AS weight, round(sum(w*x)/sum(w),5) AS x, round(sum(w*y)/sum(w),5) AS y, round(sum(w*z)/sum(w),5) AS z FROM p GROUP BY 1, 2, 3 HAVING sum(w) >= 1e-6"),
    "binary_region_metrics": (binary_region_metrics, "WITH s AS (SELECT sum(CASE WHEN quality=1 AND toxic=0 THEN 1.0 ELSE 0 END)::DOUBLE AS b, sum(CASE WHEN quality=1 THEN 1.0 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN toxic=0 THEN 1.0 ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN quality=1 OR toxic=0 THEN 1.0 ELSE 0 END)::DOUBLE AS u FROM labels) SELECT round(b/u,6) AS iou, round(2*b/(p+t),6) AS dice, round(b/p,6) AS precision, round(b/t,6) AS recall FROM s"),
    "range_metrics": (range_metrics, "WITH p AS (SELECT l_extendedprice*(1-l_discount) AS a, l_extendedprice AS t, l_quantity AS w FROM lineitem WHERE l_extendedprice > 0) SELECT round(sum(abs(a-t)*w)/sum(w),4) AS mae, round(sqrt(sum((a-t)*(a-t)*w)/sum(w)),4) AS rmse, round(sum(abs(a-t)/t*w)/sum(w),4) AS abs_rel, round(sum(CASE WHEN greatest(a/t,t/a) < 1.25 THEN w ELSE 0 END)/sum(w),4) AS delta_1, count(*) AS n FROM p"),
    "transpose_antipodal": (transpose_antipodal, f"WITH {CELLS} SELECT y + 63 - 2*(y%64) AS y, (x + 64) % 128 AS x, value FROM cells"),
    "epipolar_errors": (epipolar_errors, f"""WITH {RAYS}, q AS (SELECT y, x, {_E[0]} AS ax, {_E[1]} AS ay, {_E[2]} AS az, {_R1[0]} AS bx, {_R1[1]} AS by_, {_R1[2]} AS bz FROM rays), g AS (SELECT *, 0.3*by_ - 0.2*bz AS cx, -0.3*bx + 0.9*bz AS cy, 0.2*bx - 0.9*by_ AS cz, bx*ax + by_*ay + bz*az AS v FROM q), h AS (SELECT *, ax*ax+ay*ay+az*az - v*v + cx*cx+cy*cy+cz*cz - v*v AS n FROM g)
 SELECT y, x, round(CASE WHEN n > 0 THEN abs(v)/sqrt(n) ELSE abs(v) END,7) AS residual FROM h"""),
    "luma_of_parts": (luma_of_parts, "SELECT p_partkey, round(0.299*p_size + 0.587*p_retailprice + 0.114*(p_partkey % 255),4) AS luma FROM part"),
}
