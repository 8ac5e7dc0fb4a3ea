"""Queries of the gather kind: stencils, resampling, morphology, stereo; and view planners."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..operators import stencil as S, stereo as T, views as V
from ..sources.tables import CELLS, HEIGHT as H, WIDTH as W, cells
from .area import r

STEP = 2 * math.pi / W


def _lut_sql(taps: list[tuple[float, float, float]]) -> str:
    """The same table of rows, from the taps, in SQL."""
    values = ", ".join(f"({e!r}::DOUBLE, {n!r}::DOUBLE, {w!r}::DOUBLE)" for e, n, w in taps)
    return f"""taps(e, n, w) AS (VALUES {values}), base AS (SELECT y, e, n, w, sqrt(e*e+n*n) AS t, pi()/2 - pi()*(y+0.5)/64 AS lat FROM range(64) q(y), taps), pt AS (SELECT *, CASE WHEN t > 0 THEN sin(t)/t ELSE 1 END AS s FROM base),
 pos AS (SELECT y, w, atan2(s*e, cos(t)*cos(lat) - s*n*sin(lat)) AS lon, asin(greatest(-1.0, least(1.0, cos(t)*sin(lat) + s*n*cos(lat)))) AS pl FROM pt),
 lut AS (SELECT y, CAST(floor(lon/(2*pi())*128 + 0.5) AS BIGINT) AS dx, CAST(least(63, greatest(0, floor((pi()/2-pl)/pi()*64 - 0.5 + 0.5))) AS BIGINT) AS sy, w FROM pos)"""


def _stencil(kernel: list[list[float]], kind: str, digits: int = 5):
    taps = S.kernel_taps(kernel, STEP)

    def run(spark, d: str) -> DataFrame:
        found = S.filtered(S.gather(cells(spark, d), S.row_table(spark, H, W, taps), H, W), kind)
        return found.select("y", "x", r("value", digits).alias("value"), "taps")

    made = {"sum": "sum(w*value)", "mean": "sum(w*value)/sum(w)", "median": "median(value)", "max": "max(value)", "min": "min(value)"}[kind]
    sql = f"WITH {CELLS}, {_lut_sql(taps)} SELECT CAST(c.y - c.y%64 + l.y AS INTEGER) AS y, ((c.x - dx) % 128 + 128) % 128 AS x, round({made}, {digits}) AS value, count(*) AS taps FROM cells c JOIN lut l ON c.y % 64 = l.sy WHERE c.valid GROUP BY 1, 2"
    return run, sql


_BOX = [[1 / 9] * 3] * 3
_DISK = S.disk_taps(math.radians(6.0), STEP, math.pi / H)


def gradient(spark, d: str) -> DataFrame:
    """East, north, magnitude and orientation by two kernels in one aggregate."""
    east, north = S.kernel_taps(S.SOBEL_EAST, STEP), S.kernel_taps(S.SOBEL_NORTH, STEP)
    pairs = S.row_table(spark, H, W, [(e[0], e[1], k) for k, e in enumerate(east)]).withColumnRenamed("w", "k")
    weights = spark.createDataFrame([(float(k), e[2], n[2]) for k, (e, n) in enumerate(zip(east, north, strict=True))], "k double, we double, wn double")
    taps = pairs.join(F.broadcast(weights), "k").withColumn("w", F.struct("we", "wn"))
    got = S.gather(cells(spark, d), taps.select("y", "dx", "sy", "w"), H, W).where("valid")
    sums = got.groupBy("y", "x").agg(F.sum(F.col("w.we") * F.col("value")).alias("e"), F.sum(F.col("w.wn") * F.col("value")).alias("n"))
    return sums.select("y", "x", r("e", 5).alias("east"), r("n", 5).alias("north"), r(F.hypot("e", "n"), 5).alias("magnitude"))


def _gradient_sql() -> str:
    east, north = S.kernel_taps(S.SOBEL_EAST, STEP), S.kernel_taps(S.SOBEL_NORTH, STEP)
    both = _lut_sql([(a[0], a[1], a[2] * 1024 + b[2]) for a, b in zip(east, north, strict=True)])
    # the two weights are packed into one number, multiples of 1/8 below one and of 128 above
    return f"""WITH {CELLS}, {both}, s AS (SELECT CAST(c.y - c.y%64 + l.y AS INTEGER) AS y, ((c.x - dx) % 128 + 128) % 128 AS x, sum(round(w/1024*8)/8*value) AS e, sum((w - round(w/1024*8)/8*1024)*value) AS n FROM cells c JOIN lut l ON c.y % 64 = l.sy WHERE c.valid GROUP BY 1, 2)
 SELECT y, x, round(e,5) AS east, round(n,5) AS north, round(sqrt(e*e+n*n),5) AS magnitude FROM s"""


def _morph(kind: str):
    def run(spark, d: str) -> DataFrame:
        return S.morphology(cells(spark, d), S.row_table(spark, H, W, _DISK), H, W, kind)

    best = "max" if kind == "dilate" else "min"
    sql = f"""WITH {CELLS}, {_lut_sql(_DISK)}, p AS (SELECT c.y - c.y%64 + l.y AS y, ((c.x - dx) % 128 + 128) % 128 AS x, value FROM cells c JOIN lut l ON c.y % 64 = l.sy WHERE c.valid UNION ALL SELECT c.y - c.y%64 + l.sy, (c.x + dx + 128) % 128, value FROM cells c JOIN lut l ON c.y % 64 = l.y WHERE c.valid)
 SELECT CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, {best}(p.value) AS value FROM p JOIN cells t ON t.y = p.y AND t.x = p.x GROUP BY 1, 2"""
    return run, sql


def _twice_sql(first: str, second: str) -> str:
    """A morphology of a morphology: the second reads what the first made of every cell."""
    step = lambda source, best: f"SELECT CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, {best}(p.value) AS value FROM (SELECT c.y - c.y%64 + l.y AS y, ((c.x - dx) % 128 + 128) % 128 AS x, value FROM {source} c JOIN lut l ON c.y % 64 = l.sy UNION ALL SELECT c.y - c.y%64 + l.sy, (c.x + dx + 128) % 128, value FROM {source} c JOIN lut l ON c.y % 64 = l.y) p JOIN {{0}} t ON t.y = p.y AND t.x = p.x GROUP BY 1, 2"
    return f"WITH {CELLS}, {_lut_sql(_DISK)}, vc AS (SELECT * FROM cells WHERE valid), one AS ({step('vc', first).format('cells')}) {step('one', second).format('one')}"


def opening(spark, d: str) -> DataFrame:
    lut = S.row_table(spark, H, W, _DISK)
    low = S.morphology(cells(spark, d), lut, H, W, "erode").withColumn("valid", F.lit(True))
    return S.morphology(low, lut, H, W, "dilate")


def closing(spark, d: str) -> DataFrame:
    lut = S.row_table(spark, H, W, _DISK)
    high = S.morphology(cells(spark, d), lut, H, W, "dilate").withColumn("valid", F.lit(True))
    return S.morphology(high, lut, H, W, "erode")


def _targets(spark, d: str, h: int, w: int) -> DataFrame:
    """(pano, oy, ox): an output lattice for each panorama of the stack."""
    panos = cells(spark, d).select(F.floor(F.col("y") / H).alias("pano")).distinct()
    each = panos.select("pano", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("id"))
    return each.select("pano", F.floor(F.col("id") / w).cast("int").alias("oy"), (F.col("id") % w).cast("int").alias("ox"))


def resize_bilinear(spark, d: str) -> DataFrame:
    x, y = (F.col("ox") + 0.5) / 48 * W - 0.5, (F.col("oy") + 0.5) / 24 * H - 0.5
    return S.resample_bilinear(cells(spark, d), _targets(spark, d, 24, 48), ["pano", "oy", "ox"], x, y, H, W).select("pano", "oy", "ox", r("value").alias("value"), r("weight").alias("weight"))


def resize_nearest(spark, d: str) -> DataFrame:
    x, y = (F.col("ox") + 0.5) / 48 * W - 0.5, (F.col("oy") + 0.5) / 24 * H - 0.5
    return S.resample_nearest(cells(spark, d), _targets(spark, d, 24, 48), x, y, H, W).select("pano", "oy", "ox", "value", "valid")


def rotate_nearest(spark, d: str) -> DataFrame:
    m = G.axis_rotation((0.3, 1.0, 0.2), -0.7)
    t = _targets(spark, d, H, W).withColumn("p", G.ray_to_erp_pixel(G.rotate(m, G.erp_pixel_to_ray(F.col("ox"), F.col("oy"), H, W)), H, W))
    return S.resample_nearest(cells(spark, d), t, F.round("p.x", 9), F.round("p.y", 9), H, W).select("pano", "oy", "ox", "value", "valid")


def _rotate_sql() -> str:
    m = G.axis_rotation((0.3, 1.0, 0.2), -0.7)
    q = [" + ".join(f"({v!r}::DOUBLE)*{c}" for v, c in zip(row, ("sin(lon)*cos(lat)", "sin(lat)", "cos(lon)*cos(lat)"), strict=True)) for row in m]
    return f"""WITH {CELLS}, t AS (SELECT id // 128 AS oy, id % 128 AS ox, 2*pi()*((id % 128)+0.5)/128 - pi() AS lon, pi()/2 - pi()*((id // 128)+0.5)/64 AS lat FROM range(8192) g(id)), q AS (SELECT oy, ox, {q[0]} AS a, {q[1]} AS b, {q[2]} AS c FROM t),
 p AS (SELECT oy, ox, (atan2(a,c)+pi())/(2*pi())*128-0.5 AS u, round((pi()/2-asin(greatest(-1.0,least(1.0,b/sqrt(a*a+b*b+c*c)))))/pi()*64-0.5,9) AS v FROM q), n AS (SELECT oy, ox, CAST(floor(round(u-128*floor(u/128),9)+0.5) AS BIGINT) % 128 AS sx, CAST(least(63,greatest(0,floor(v+0.5))) AS BIGINT) AS sy FROM p)
 SELECT c.y // 64 AS pano, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, value, valid FROM n JOIN cells c ON c.y % 64 = sy AND c.x = sx"""


_RESIZE = "t AS (SELECT id // 48 AS oy, id % 48 AS ox, ((id % 48)+0.5)/48*128-0.5 AS u, ((id // 48)+0.5)/24*64-0.5 AS v FROM range(1152) g(id))"
_DISP = 8


def _pair(spark, d: str) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, d).where("valid")
    return c.select("y", "x", "value"), c.select("y", (F.col("x") - F.col("y") % 4).alias("x"), "value")


def absolute_difference_cost(spark, d: str) -> DataFrame:
    return T.absolute_difference(*_pair(spark, d), _DISP, 50.0).select("y", "x", "d", r("cost").alias("cost"))


def census_codes(spark, d: str) -> DataFrame:
    return T.census(cells(spark, d), H)


def census_cost(spark, d: str) -> DataFrame:
    c = T.census(cells(spark, d), H)
    return T.census_cost(c, c.withColumn("x", F.col("x") - 2), _DISP)


def box_cost(spark, d: str) -> DataFrame:
    return T.box_aggregate(T.absolute_difference(*_pair(spark, d), _DISP, 50.0), H, W).select("y", "x", "d", r("cost").alias("cost"))


def cross_cost(spark, d: str) -> DataFrame:
    """Absolute differences averaged over adaptive crosses, once."""
    left, right = _pair(spark, d)
    cost = T.absolute_difference(left, right, _DISP, 50.0)
    return T.cross_aggregate(cost, left, H, W, _DISP, 4, 30.0, 1).select("y", "x", "d", r("cost").alias("cost"))


def select_disparity(spark, d: str) -> DataFrame:
    found = T.select_disparity(T.absolute_difference(*_pair(spark, d), _DISP, 50.0).withColumn("cost", F.round("cost", 6)))
    return found.select("y", "x", "disparity", r("cost").alias("cost"), r("second").alias("second"), r("refined", 4).alias("refined"))


def semi_global_cost(spark, d: str) -> DataFrame:
    return _chosen(spark, d, 8)


def semi_global_four_paths(spark, d: str) -> DataFrame:
    return _chosen(spark, d, 4)


def _chosen(spark, d: str, paths: int) -> DataFrame:
    left, right = _pair(spark, d)
    return T.select_disparity(T.semi_global(T.absolute_difference(left, right, _DISP, 50.0), left, H, 2.0, 20.0, paths, 30.0)).select("y", "x", "disparity")


def _shifted(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """The cells, and the same two columns further."""
    c = cells(spark, d).where("valid").select("y", "x", "value")
    return c, c.withColumn("x", F.col("x") - 2)


def ad_census_cost(spark, d: str) -> DataFrame:
    left, right = _shifted(spark, d)
    census = T.census_cost(T.census(left, H), T.census(left, H).withColumn("x", F.col("x") - 2), _DISP)
    return T.ad_census(T.absolute_difference(left, right, _DISP, 50.0), census, 50.0, 8).select("y", "x", "d", r("cost").alias("cost"))


def birchfield_tomasi_cost(spark, d: str) -> DataFrame:
    return T.birchfield_tomasi(*_shifted(spark, d), _DISP, 50.0).select("y", "x", "d", r("cost").alias("cost"))


_AD = f"{CELLS}, l AS (SELECT y, x, value, d FROM cells, range({_DISP}) g(d) WHERE valid), rr AS (SELECT y, x - y % 4 AS x, value FROM cells WHERE valid), ad AS (SELECT l.y, l.x, CAST(d AS INTEGER) AS d, least(abs(l.value - rr.value), 50.0) AS cost FROM l JOIN rr ON rr.y = l.y AND rr.x = l.x - d)"
_OFFSETS = ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
_CENSUS = f"{CELLS}, o(bit, dy, dx) AS (VALUES {_OFFSETS}), census AS (SELECT c.y, c.x, CAST(sum(CASE WHEN n.value >= c.value THEN 1::BIGINT << bit ELSE 0 END) AS BIGINT) AS code FROM cells c, o JOIN cells n ON n.y = c.y + o.dy AND n.x = c.x + o.dx AND n.y // 64 = c.y // 64 GROUP BY 1, 2 HAVING count(*) = 8)"


def views_cube(spark, d: str) -> DataFrame:
    return V.cube(spark)


def views_fibonacci(spark, d: str) -> DataFrame:
    return V.fibonacci(spark, 200).select("view", r("lat_deg").alias("lat_deg"), r("lon_deg").alias("lon_deg"))


def views_spiral(spark, d: str) -> DataFrame:
    return V.spiral(spark, 200).select("view", r("lat_deg").alias("lat_deg"), r("lon_deg").alias("lon_deg"))


def views_icosahedron(spark, d: str) -> DataFrame:
    return V.icosahedron(spark, 1)


def fov_anchors(spark, d: str) -> DataFrame:
    from ..sources.tables import read

    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10000).alias("score"), (20.0 + F.col("p_size")).alias("hfov"), (15.0 + F.col("p_size") / 2).alias("vfov"))
    return V.anchors(p, (0.5, 1.0, 2.0), (0.5, 1.0, 2.0), 10.0, 90.0).select("id", r("hfov").alias("hfov"), r("vfov").alias("vfov"), r("score", 8).alias("score"))


QUERIES = {
    "filter_box": _stencil(_BOX, "sum"), "box_blur": _stencil(_BOX, "mean"), "gaussian_blur": _stencil(S.gaussian_kernel(5, 1.0), "mean"), "median_blur": _stencil([[1.0] * 3] * 3, "median", 6), "max_pool": _stencil([[1.0] * 3] * 3, "max"), "min_pool": _stencil([[1.0] * 3] * 3, "min"),
    "sobel_east": _stencil(S.SOBEL_EAST, "sum"), "sobel_north": _stencil(S.SOBEL_NORTH, "sum"), "laplacian": _stencil(S.LAPLACE, "sum"), "gradient": (gradient, _gradient_sql()),
    "dilate": _morph("dilate"), "erode": _morph("erode"), "opening": (opening, _twice_sql("min", "max")), "closing": (closing, _twice_sql("max", "min")),
    "resize_nearest": (resize_nearest, f"WITH {CELLS}, {_RESIZE} SELECT c.y // 64 AS pano, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, value, valid FROM t JOIN cells c ON c.x = CAST(floor(u+0.5) AS BIGINT) % 128 AND c.y % 64 = least(63,greatest(0,CAST(floor(v+0.5) AS BIGINT)))"),
    "resize_bilinear": (resize_bilinear, f"""WITH {CELLS}, {_RESIZE}, k AS (SELECT oy, ox, (CAST(floor(u) AS BIGINT)+i+128) % 128 AS sx, least(63,greatest(0,CAST(floor(v) AS BIGINT)+j)) AS sy, (CASE WHEN i=0 THEN 1-(u-floor(u)) ELSE u-floor(u) END)*(CASE WHEN j=0 THEN 1-(v-floor(v)) ELSE v-floor(v) END) AS w FROM t, range(2) a(i), range(2) b(j))
 SELECT c.y // 64 AS pano, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, round(CASE WHEN sum(w) <> 0 THEN sum(w*value)/sum(w) END,6) AS value, round(sum(w),6) AS weight FROM k JOIN cells c ON c.x = sx AND c.y % 64 = sy WHERE valid GROUP BY 1, 2, 3"""),
    "rotate_nearest": (rotate_nearest, _rotate_sql()),
    "absolute_difference_cost": (absolute_difference_cost, f"WITH {_AD} SELECT y, x, d, round(cost,6) AS cost FROM ad"), "census_codes": (census_codes, f"WITH {_CENSUS} SELECT y, x, code FROM census"),
    "census_cost": (census_cost, f"WITH {_CENSUS} SELECT a.y, a.x, CAST(d AS INTEGER) AS d, CAST(bit_count(xor(a.code, b.code)) AS DOUBLE) AS cost FROM census a, range({_DISP}) g(d) JOIN census b ON b.y = a.y AND b.x - 2 = a.x - d"),
    "box_cost": (box_cost, f"""WITH {_AD}, o(k) AS (VALUES (-1),(0),(1)), a1 AS (SELECT y, least(127,greatest(0,x+k)) AS x, d, sum(cost) AS s, count(*) AS n FROM ad, o GROUP BY 1, 2, 3) SELECT CAST(y - y%64 + least(63,greatest(0,y%64+k)) AS INTEGER) AS y, x, d, round(sum(s)/sum(n),6) AS cost FROM a1, o GROUP BY 1, 2, 3"""),
    "cross_cost": (cross_cost, f"""WITH {_AD}, g AS (SELECT y, x, value FROM cells WHERE valid), w(way, dy, dx) AS (VALUES ('l',0,-1),('r',0,1),('u',-1,0),('d',1,0)),
 st AS (SELECT g.y, g.x, way, k, n.value IS NOT NULL AND abs(n.value - g.value) <= 30 AS ok FROM (g CROSS JOIN w CROSS JOIN range(1,5) t(k)) LEFT JOIN g n ON n.y = g.y + k*dy AND n.x = g.x + k*dx AND n.y // 64 = g.y // 64),
 ar AS (SELECT y, x, way, coalesce(min(k) FILTER (NOT ok), 5) - 1 AS arm FROM st GROUP BY ALL), am AS (SELECT y, x, max(arm) FILTER (way='l') AS l, max(arm) FILTER (way='r') AS r, max(arm) FILTER (way='u') AS u, max(arm) FILTER (way='d') AS dn FROM ar GROUP BY ALL)
 SELECT a.y, a.x, ad.d, round(avg(cost),6) AS cost FROM am a JOIN am b ON b.x = a.x AND b.y BETWEEN a.y - a.u AND a.y + a.dn JOIN ad ON ad.y = b.y AND ad.x BETWEEN a.x - least(a.l, b.l) AND a.x + least(a.r, b.r) GROUP BY ALL"""),
    "select_disparity": (select_disparity, f"""WITH {_AD}, c AS (SELECT y, x, d, round(cost,6) AS cost FROM ad), k AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY cost, d) AS n FROM c), b AS (SELECT y, x, max(CASE WHEN n=1 THEN d END) AS d, max(CASE WHEN n=1 THEN cost END) AS cost, max(CASE WHEN n=2 THEN cost END) AS second FROM k GROUP BY 1, 2),
 s AS (SELECT b.y, b.x, b.d, b.cost, b.second, max(CASE WHEN c.d=b.d-1 THEN c.cost END) AS lo, max(CASE WHEN c.d=b.d+1 THEN c.cost END) AS hi FROM b JOIN c ON c.y=b.y AND c.x=b.x GROUP BY 1, 2, 3, 4, 5)
 SELECT y, x, d AS disparity, round(cost,6) AS cost, round(second,6) AS second, round(d + coalesce(CASE WHEN lo-2*cost+hi > 0 THEN least(greatest((lo-hi)/(2*(lo-2*cost+hi)),-0.5),0.5) ELSE 0 END, 0),4) AS refined FROM s"""),
    "semi_global_cost": (semi_global_cost, None), "semi_global_four_paths": (semi_global_four_paths, None),
    "ad_census_cost": (ad_census_cost, f"""WITH {_CENSUS.replace("census AS", "vc AS (SELECT * FROM cells WHERE valid), census AS").replace("FROM cells c, o JOIN cells n", "FROM vc c, o JOIN vc n")}, ad AS (SELECT l.y, l.x, d, least(abs(l.value - q.value), 50.0) AS cost FROM vc l, range({_DISP}) g(d) JOIN vc q ON q.y = l.y AND q.x - 2 = l.x - d)
 SELECT ad.y, ad.x, CAST(ad.d AS INTEGER) AS d, round(0.25*ad.cost/50.0 + 0.75*bit_count(xor(a.code, b.code))/8.0,6) AS cost FROM ad JOIN census a ON a.y = ad.y AND a.x = ad.x JOIN census b ON b.y = ad.y AND b.x - 2 = ad.x - ad.d"""),
    "birchfield_tomasi_cost": (birchfield_tomasi_cost, f"""WITH {CELLS}, n AS (SELECT y, x, value AS v, CASE WHEN lag(x) OVER w = x-1 THEN (value + lag(value) OVER w)/2 ELSE value END AS a, CASE WHEN lead(x) OVER w = x+1 THEN (value + lead(value) OVER w)/2 ELSE value END AS b FROM cells WHERE valid WINDOW w AS (PARTITION BY y ORDER BY x)), i AS (SELECT y, x, v, least(v,a,b) AS lo, greatest(v,a,b) AS hi FROM n)
 SELECT l.y, l.x, CAST(d AS INTEGER) AS d, round(least(greatest(0.0, l.v - q.hi, q.lo - l.v), greatest(0.0, q.v - l.hi, l.lo - q.v), 50.0),6) AS cost FROM i l, range({_DISP}) g(d) JOIN i q ON q.y = l.y AND q.x - 2 = l.x - d"""),
    "views_cube": (views_cube, "SELECT * FROM (VALUES (0,'front',0.0::DOUBLE,0.0::DOUBLE),(1,'right',0,90),(2,'back',0,180),(3,'left',0,-90),(4,'up',90,0),(5,'down',-90,0)) t(view,name,lat_deg,lon_deg)"),
    "views_fibonacci": (views_fibonacci, "WITH t AS (SELECT id, id+0.5::DOUBLE AS k, (id+0.5::DOUBLE)*(2*pi()/((1+sqrt(5.0::DOUBLE))/2)) AS a FROM range(200) t(id)) SELECT id AS view, round(degrees(asin(1 - 2*k/200)),6) AS lat_deg, round(degrees(atan2(sin(a),cos(a))),6) AS lon_deg FROM t"),
    "views_spiral": (views_spiral, "WITH t AS (SELECT id, id/199.0::DOUBLE AS t FROM range(200) t(id)), a AS (SELECT id, t, 360*sqrt(200.0::DOUBLE)*t AS o FROM t) SELECT id AS view, round(degrees(acos(1 - 2*t)) - 90,6) AS lat_deg, round(o - floor(o/360)*360 - 180,6) AS lon_deg FROM a"),
    "views_icosahedron": (views_icosahedron, None),
    "fov_anchors": (fov_anchors, """WITH p AS (SELECT p_partkey AS id, p_retailprice/10000 AS score, 20.0 + p_size AS hfov, 15.0 + p_size/2.0 AS vfov FROM part), g AS (SELECT id, score, hfov, vfov, s, a FROM p, (VALUES (0.5::DOUBLE),(1),(2)) q(s), (VALUES (0.5::DOUBLE),(1),(2)) w(a)),
 m AS (SELECT id, round(least(greatest(hfov*s*sqrt(a),10.0),90.0),9) AS h, round(least(greatest(vfov*s/sqrt(a),10.0),90.0),9) AS v, score*exp(-0.15*(abs(ln(s))+0.5*abs(ln(a)))) AS sc FROM g)
 SELECT id, round(h,6) AS hfov, round(v,6) AS vfov, round(max(sc),8) AS score FROM m GROUP BY id, h, v"""),
}
