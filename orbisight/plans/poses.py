"""Queries over relative poses; the SQL states the planted poses and counts the matches that hold them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import bundle as B, pose as P
from ..sources.lineage import checkpointed, written
from ..sources.tables import read
from .area import r

THRESHOLD = math.radians(0.2)


def matches(spark, d: str) -> DataFrame:
    """Bearings of line items in two panoramas of their supplier; every third item of an order is matched wrongly.

    Every step has plain columns, which are computed once however often the next one reads them.
    """
    share = lambda c, k: F.floor((F.col(c) * k - F.floor(F.col(c) * k)) * 1e9 + 0.5) / 1e9
    pair, c = F.col("pair"), F.col
    items = read(spark, d, "lineitem").select(
        c("l_suppkey").alias("pair"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), (c("l_linenumber") % 3 == 0).alias("wrong"), (2 + c("l_quantity") / 10).alias("depth"),
        share("l_partkey", 0.618034).alias("u1"), share("l_orderkey", 0.754878).alias("v1"), share("l_extendedprice", 0.31831).alias("u2"), share("l_partkey", 0.23606).alias("v2"),
    )
    bearing = lambda u, v, n: [(F.sin(2 * math.pi * c(u)) * F.cos(F.asin(1 - 2 * c(v)))).alias(f"{n}x"), (1 - 2 * c(v)).alias(f"{n}y"), (F.cos(2 * math.pi * c(u)) * F.cos(F.asin(1 - 2 * c(v)))).alias(f"{n}z")]
    seen = items.select("pair", "id", "wrong", "depth", *bearing("u1", "v1", "a"), *bearing("u2", "v2", "l"))
    posed = seen.select("*", ((pair % 7) * 0.05 - 0.15).alias("vx"), ((pair % 11) * 0.06 - 0.3).alias("vy"), ((pair % 5) * 0.04 - 0.08).alias("vz"), ((pair % 3) - 1.0).alias("sx"), ((pair % 4) * 0.25 - 0.5).alias("sy"))
    turn = G.rotation_exp(c("vx"), c("vy"), c("vz"))
    length = F.sqrt(c("sx") * c("sx") + c("sy") * c("sy") + 1)
    met = posed.select(*seen.columns, *[turn[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], (c("sx") / length).alias("tx"), (c("sy") / length).alias("ty"), (1 / length).alias("tz"))
    moved = met.select("*", *[((c(f"r{i}0") * c("ax") + c(f"r{i}1") * c("ay") + c(f"r{i}2") * c("az")) * c("depth") + c(f"t{k}")).alias(f"p{k}") for i, k in enumerate("xyz")])
    sized = moved.withColumn("far", F.sqrt(c("px") * c("px") + c("py") * c("py") + c("pz") * c("pz")))
    return sized.select("pair", "id", *[f"a{k}" for k in "xyz"], *[F.when(c("wrong"), c(f"l{k}")).otherwise(c(f"p{k}") / c("far")).alias(f"b{k}") for k in "xyz"])


def relative_pose_fits(spark, d: str) -> DataFrame:
    """Rotation vector, direction and inliers of each supplier's pair."""
    found = P.relative_poses(matches(spark, d), THRESHOLD)
    found = checkpointed(found)
    turn = G.rotation_log([[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)])
    return found.withColumn("v", turn).select("pair", "n", "inliers", "accepted", *[(r(F.col("v")[k], 4) + 0.0).alias(f"v{k}") for k in "xyz"], *[(r(f"t{k}", 4) + 0.0).alias(f"t{k}") for k in "xyz"])


_SQL = f"""WITH i AS (SELECT l_suppkey AS pair, l_linenumber % 3 = 0 AS wrong, 2 + l_quantity/10 AS depth, l_partkey, l_orderkey, l_extendedprice FROM lineitem),
 s AS (SELECT *, round(l_partkey*0.618034::DOUBLE - floor(l_partkey*0.618034::DOUBLE),9) AS u1, round(l_orderkey*0.754878::DOUBLE - floor(l_orderkey*0.754878::DOUBLE),9) AS v1, round(l_extendedprice*0.31831::DOUBLE - floor(l_extendedprice*0.31831::DOUBLE),9) AS u2, round(l_partkey*0.23606::DOUBLE - floor(l_partkey*0.23606::DOUBLE),9) AS v2 FROM i),
 b0 AS (SELECT pair, wrong, depth, sin(2*pi()*u1)*cos(asin(1-2*v1)) AS ax, 1-2*v1 AS ay, cos(2*pi()*u1)*cos(asin(1-2*v1)) AS az, sin(2*pi()*u2)*cos(asin(1-2*v2)) AS lx, 1-2*v2 AS ly, cos(2*pi()*u2)*cos(asin(1-2*v2)) AS lz,
 (pair%7)*0.05::DOUBLE-0.15 AS vx, (pair%11)*0.06::DOUBLE-0.3 AS vy, (pair%5)*0.04::DOUBLE-0.08 AS vz, (pair%3)-1.0::DOUBLE AS sx, (pair%4)*0.25::DOUBLE-0.5 AS sy FROM s),
 b1 AS (SELECT *, sqrt(vx*vx+vy*vy+vz*vz) AS th, sqrt(sx*sx+sy*sy+1) AS sn FROM b0), b2 AS (SELECT *, CASE WHEN th > 0 THEN sin(th)/th ELSE 1 END AS f, CASE WHEN th > 0 THEN (1-cos(th))/(th*th) ELSE 0.5 END AS g, sx/sn AS tx, sy/sn AS ty, 1/sn AS tz FROM b1),
 b3 AS (SELECT *, vy*az-vz*ay AS cx, vz*ax-vx*az AS cy, vx*ay-vy*ax AS cz FROM b2), b4 AS (SELECT *, ax+f*cx+g*(vy*cz-vz*cy) AS rx, ay+f*cy+g*(vz*cx-vx*cz) AS ry, az+f*cz+g*(vx*cy-vy*cx) AS rz FROM b3),
 b5 AS (SELECT *, rx*depth+tx AS px, ry*depth+ty AS py, rz*depth+tz AS pz FROM b4), b6 AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS pn FROM b5),
 b7 AS (SELECT *, CASE WHEN wrong THEN lx ELSE px/pn END AS bx, CASE WHEN wrong THEN ly ELSE py/pn END AS by_, CASE WHEN wrong THEN lz ELSE pz/pn END AS bz FROM b6),
 e AS (SELECT *, ty*rz-tz*ry AS ex, tz*rx-tx*rz AS ey, tx*ry-ty*rx AS ez, by_*tz-bz*ty AS hx, bz*tx-bx*tz AS hy, bx*ty-by_*tx AS hz FROM b7),
 w AS (SELECT *, bx*ex+by_*ey+bz*ez AS val FROM e), q AS (SELECT *, abs(val)/sqrt(greatest(ex*ex+ey*ey+ez*ez + hx*hx+hy*hy+hz*hz - 2*val*val, 1e-30)) AS err FROM w)
 SELECT pair, count(*) AS n, count(*) FILTER (err <= {THRESHOLD!r}::DOUBLE) AS inliers, true AS accepted, round(vx,4)+0 AS vx, round(vy,4)+0 AS vy, round(vz,4)+0 AS vz, round(tx,4)+0 AS tx, round(ty,4)+0 AS ty, round(tz,4)+0 AS tz FROM q GROUP BY ALL"""

def scenes(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A scene for each supplier: line numbers modulo 4 are cameras, parts in forties landmarks that three of them see; a guess of both.

    Bearings are those of planted cameras and landmarks; the first two cameras are known.
    """
    items = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("scene"), (F.col("l_linenumber") % 4 + 1).cast("long").alias("camera"), (F.col("l_partkey") % 40).alias("landmark"))
    # the cameras of a landmark as bits: -2 to 4 from the second on, null as the first
    bit = F.call_function("shiftleft", F.lit(1), F.coalesce(F.col("camera") + 3, F.lit(0)).cast("int"))
    often = written(items.groupBy("scene", "landmark").agg(F.bit_or(bit).alias("bits")).where(F.bit_count("bits") >= 3))
    told = lambda df, *names: df.select(*names, F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit("bits", k) == 1)).alias("k")).select(*names, F.when(F.col("k") > 0, F.col("k") - 3).cast("long").alias("camera"))
    met = often.where("scene IS NOT NULL AND landmark IS NOT NULL")
    seen = told(met, "scene", "landmark")
    c, m = F.col("camera"), F.col("landmark")
    share = lambda k: F.pmod(m * k, F.lit(1.0))
    far = 4 + (m % 5) * 0.5
    ray = G.ray_of(2 * math.pi * share(0.618034), F.asin(1 - 2 * share(0.754878)))
    spot = G.ray(ray["x"] * far + (F.col("scene") % 10) * 0.01, ray["y"] * far, ray["z"] * far)
    centre = G.ray((c % 3) * 0.5, (c % 2) * 0.3, c * 0.2)
    turn = lambda yaw: [[F.cos(yaw), F.lit(0.0), -F.sin(yaw)], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], [F.sin(yaw), F.lit(0.0), F.cos(yaw)]]
    placed = seen.withColumn("s", spot).withColumn("c", centre)
    moved = G.ray(*[F.col("s")[k] - F.col("c")[k] for k in "xyz"])
    seen_at = placed.withColumn("q", G.rotate(turn(c * 0.2), moved)).select("scene", "camera", "landmark", *[F.col("q")[k].alias(f"b{k}") for k in "xyz"])
    size = F.sqrt(sum(F.col(f"b{k}") * F.col(f"b{k}") for k in "xyz"))
    bearings = seen_at.withColumn("n", size).select("scene", "camera", "landmark", *[(F.col(f"b{k}") / F.col("n")).alias(f"b{k}") for k in "xyz"], F.lit(1.0).alias("w"))
    free = F.when(c > 2, 1.0).otherwise(0.0)
    guess = turn(c * 0.2 + free * 0.01)
    cameras = told(met.groupBy("scene").agg(F.bit_or("bits").alias("bits")), "scene").withColumn("c", centre).select("scene", "camera", *[(F.col("c")[k] + free * 0.05 * F.sin(c * f)).alias(f"c{k}") for k, f in (("x", 1.3), ("y", 2.1), ("z", 0.7))], *[guess[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], (c <= 2).alias("fixed"))
    landmarks = often.withColumn("s", spot).select("scene", "landmark", *[(F.col("s")[k] * (1 + 0.03 * F.cos(m)) + 0.05).alias(k) for k in "xyz"])
    return bearings, cameras, landmarks


def bundle_adjustment(spark, d: str) -> DataFrame:
    """Centres of cameras and places of landmarks after adjustment."""
    cameras, landmarks, _ = B.adjust(*scenes(spark, d), outer=4, inner=8)
    told = lambda df, kind, name, cols: df.select("scene", F.lit(kind).alias("kind"), F.col(name).alias("id"), *[(r(c, 3) + 0.0).alias(k) for c, k in zip(cols, "xyz", strict=True)])
    return told(cameras, "camera", "camera", B.CENTRE).unionByName(told(landmarks, "landmark", "landmark", ["x", "y", "z"]))


_BUNDLE = """WITH s AS (SELECT DISTINCT l_suppkey AS scene, l_linenumber % 4 + 1 AS camera, l_partkey % 40 AS landmark FROM lineitem), o AS (SELECT scene, landmark FROM s GROUP BY ALL HAVING count(*) >= 3), t AS (SELECT s.* FROM s JOIN o USING (scene, landmark)),
 l AS (SELECT *, landmark*0.618034::DOUBLE - floor(landmark*0.618034::DOUBLE) AS u, landmark*0.754878::DOUBLE - floor(landmark*0.754878::DOUBLE) AS v, 4 + (landmark % 5)*0.5::DOUBLE AS far FROM o)
 SELECT DISTINCT scene, 'camera' AS kind, CAST(camera AS BIGINT) AS id, round((camera%3)*0.5::DOUBLE, 3) AS x, round((camera%2)*0.3::DOUBLE, 3) AS y, round(camera*0.2::DOUBLE, 3) AS z FROM t
 UNION ALL SELECT scene, 'landmark', landmark, round(sin(2*pi()*u)*cos(asin(1-2*v))*far + (scene%10)*0.01::DOUBLE, 3)+0, round((1-2*v)*far, 3)+0, round(cos(2*pi()*u)*cos(asin(1-2*v))*far, 3)+0 FROM l"""

QUERIES = {"relative_pose_fits": (relative_pose_fits, _SQL), "bundle_adjustment": (bundle_adjustment, _BUNDLE)}
