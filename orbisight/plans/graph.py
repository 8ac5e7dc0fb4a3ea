"""Queries over matches, graphs, tracks, streams and text tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..operators import decisions as D, match as M, regions as R, robust as B
from ..sources.tables import OBSERVATIONS, observations, read
from ..streaming import keyframes as K, slam
from .area import r


def _embeddings(spark, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _near(spark, d: str, odd: bool, k: int) -> DataFrame:
    e = _embeddings(spark, d)
    a, b = e.where(F.col("vec_id") % 2 == int(odd)), e.where(F.col("vec_id") % 2 != int(odd))
    return M.nearest_descriptors(a.select(F.col("vec_id").alias("query_id"), "vector"), b.select(F.col("vec_id").alias("train_id"), "vector"), k)


def embedding_ratio_match(spark, d: str) -> DataFrame:
    return M.ratio_matches(_near(spark, d, False, 2), 0.98).select("query_id", "train_id", r("distance", 5).alias("distance"))


def mutual_match(spark, d: str) -> DataFrame:
    one = lambda odd: _near(spark, d, odd, 1).select("query_id", "train_id", "distance")
    return M.mutual(one(False), one(True)).select("query_id", "train_id", r("distance", 5).alias("distance"))


def embedding_topk(spark, d: str) -> DataFrame:
    """Labels by the largest cosine of any member to vector 0; order by score, then label."""
    e = _embeddings(spark, d)
    first = e.where("vec_id = 0").first()  # one row
    query = first.vector if first else []
    members = e.where("vec_id <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    top = M.embedding_query(e.where("vec_id <> 0"), query, 5, "label")
    return top.join(members, "label").select("label", r("similarity", 5).alias("similarity"), "members")


def _joint_matches(spark, d: str) -> DataFrame:
    """(class_id, id_a, id_b, inlier, residual_deg): parts that two suppliers of a nation both deliver, as feature matches."""
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("class_id"))
    l = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("q")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    a = l.where("l_suppkey % 2 = 0").select("class_id", "l_partkey", F.col("l_suppkey").alias("id_a"), F.col("q").alias("q_a"))
    b = l.where("l_suppkey % 2 = 1").select("class_id", "l_partkey", F.col("l_suppkey").alias("id_b"), F.col("q").alias("q_b"))
    off = F.abs(F.col("q_a") - F.col("q_b")) / 10
    return a.join(b, ["class_id", "l_partkey"]).select("class_id", "id_a", "id_b", (off <= 2).alias("inlier"), off.alias("residual_deg"))


def _sides(spark, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("class_id"), F.col("s_suppkey").alias("id"), ((F.col("s_acctbal") + 1000) / 11000).alias("score"), (F.col("s_suppkey") % 10 / 10).alias("v"))
    return s.where("id % 2 = 0"), s.where("id % 2 = 1")


def region_association(spark, d: str) -> DataFrame:
    p = M.propose_associations(*_sides(spark, d), _joint_matches(spark, d))
    return p.select("class_id", "id_a", "id_b", "matches", "inliers", r("score").alias("score"), r("geometric").alias("geometric"), "state", F.array_join("reasons", ",").alias("reasons"))


def region_assignment(spark, d: str) -> DataFrame:
    return M.assign(M.propose_associations(*_sides(spark, d), _joint_matches(spark, d)).where("state = 'accepted'"))


def spatial_box_query(spark, d: str) -> DataFrame:
    return observations(spark, d).where(F.col("lon").between(1.0, 2.5) & F.col("lat").between(-0.5, 0.7)).select("id", r("lon").alias("lon"), r("lat").alias("lat"), "label")


def _next_customers(spark, d: str) -> DataFrame:
    """(c, n): customers of orders that follow one another on a day."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("c"), "o_orderdate", "o_orderkey")
    w = Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey")
    return o.select("c", F.lead("c").over(w).alias("n")).where("n IS NOT NULL AND c <> n")


def neighbors(spark, d: str) -> DataFrame:
    e = _next_customers(spark, d)
    return e.select("c", "n").unionByName(e.select(F.col("n").alias("c"), F.col("c").alias("n"))).distinct().groupBy(F.col("c").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("n").alias("first"), F.max("n").alias("last"))


_EDGES = "e AS (SELECT c, n FROM (SELECT o_custkey AS c, lead(o_custkey) OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders) WHERE n IS NOT NULL AND c <> n), u AS (SELECT c, n FROM e UNION SELECT n, c FROM e)"


def graph_components(spark, d: str) -> DataFrame:
    """Components of customers, each tied to the next customer of the same day."""
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return R.components(nodes, _next_customers(spark, d).select(F.col("c").alias("a"), F.col("n").alias("b"))).groupBy("root").agg(F.count(F.lit(1)).alias("members"))




def hypotheses(spark, d: str) -> DataFrame:
    """One row for each customer with support from several priorities: confidence, state and view count."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("views"), F.round(F.avg("o_totalprice") / F.max("o_totalprice"), 5).alias("confidence"))
    return o.select("o_custkey", "views", "confidence", D.promotion_state(F.col("views"), F.col("confidence")).alias("state"))


def nms_angular(spark, d: str) -> DataFrame:
    return M.angular_suppression(observations(spark, d), "label", 0.12).select("id", "label", "score")


def duplicate_free_events(spark, d: str) -> DataFrame:
    """The latest event of each user and type, as an upsert by key."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id", r("value", 4).alias("value"))


def resolution_plateau(spark, d: str) -> DataFrame:
    """The first size from which every later step of the mean price changes by less than a tenth."""
    s = read(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    w = Window.partitionBy("p_brand").orderBy("p_size")
    step = s.withColumn("change", F.round(F.abs(F.lead("m").over(w) - F.col("m")) / F.col("m"), 9))
    rest = step.withColumn("worst", F.max("change").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return rest.where("worst < 0.1 OR worst IS NULL").groupBy("p_brand").agg(F.min("p_size").alias("size"))


def text_query(spark, d: str) -> DataFrame:
    """Documents by cosine of a hashed bag of words to the words of the first one; a top-k report."""
    docs = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.text_encoding(F.col("text")).alias("vector"))
    first = docs.where("doc_id = 0").first()  # one row
    query = first.vector if first else []
    return M.embedding_query(docs, query, 20, "doc_id").select("doc_id", r("similarity", 6).alias("score"))


def canonical_ids(spark, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.trim("text")), 256), 1, 24).alias("id"))


def referential_integrity(spark, d: str) -> DataFrame:
    """Rows whose reference is missing, by table."""
    o, c, l, s = (read(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    missing = lambda a, b, on, name: a.join(b, on, "left_anti").agg(F.count(F.lit(1)).alias("missing")).select(F.lit(name).alias("reference"), "missing")
    return missing(o, c, F.col("o_custkey") == F.col("c_custkey"), "orders-customer").unionByName(missing(l, s, F.col("l_suppkey") == F.col("s_suppkey"), "lineitem-supplier")).unionByName(missing(c, o, F.col("c_custkey") == F.col("o_custkey"), "customer-orders"))


def pair_affinity(spark, d: str) -> DataFrame:
    """Jaccard overlap of the parts of two suppliers that share any."""
    l = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    n = l.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    both = l.join(l.select(F.col("s").alias("t"), "p"), "p").where("s < t").groupBy("s", "t").agg(F.count(F.lit(1)).alias("common"))
    j = both.join(n, "s").join(n.select(F.col("s").alias("t"), F.col("n").alias("m")), "t")
    return j.select("s", "t", "common", r(F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("jaccard"))


def _frames(df: DataFrame) -> DataFrame:
    return df.select(F.col("user_id").alias("session"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")


def keyframes_stream(spark, d: str) -> DataFrame:
    """The stateful tracker over the events as a stream that ends; its rows by state."""
    import os
    import uuid

    from ..sources.lineage import shared_folder

    schema = read(spark, d, "events").schema
    name = f"keyframes_{uuid.uuid4().hex}"
    shared = shared_folder(spark)
    stream = K.track(_frames(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events*.parquet")), 600.0, 7200.0, 50.0)
    out = os.path.join(shared, name, "rows")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(shared, name, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("session long, event_id long, at double, state string").parquet(out).groupBy("state").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("session").alias("sessions"))


def _bearings(frames: pa.RecordBatch) -> list[slam.Seen]:
    """Forty landmarks of a ring that an event's value looks along, seen under a yaw of a hundredth of it; none without a value."""
    value = frames.column("value").to_numpy(zero_copy_only=False).astype(float)
    many = np.where(np.isfinite(value), 40, 0).tolist()
    value = np.nan_to_num(value, nan=0.0, posinf=0.0, neginf=0.0)[:, None]
    ids = np.floor(value / 8).astype(np.int64) + np.arange(40)
    lon, lat = np.mod(ids * 2.399963, 2 * math.pi) - value * 0.01, np.sin(ids * 1.7)
    seen = np.stack([np.sin(lon) * np.cos(lat), np.sin(lat), np.cos(lon) * np.cos(lat)], axis=2)
    return [slam.Seen(i[:n], s[:n]) for i, s, n in zip(ids, seen, many, strict=True)]


#: Sessions of the events last for days; values jump, so frames often need a map that holds more than the last keyframes.
TRACKED = slam.Options(window=2, most_keyframes=12, idle_seconds=20 * 86400.0)


def tracked_frames(spark, d: str) -> DataFrame:
    """The batch form of incremental tracking over all events, a frame for each."""
    frames = read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = slam.replay(frames, TRACKED, _bearings)
    return found.select("session", "frame", "state", "keyframe", "reference", "matches", "inliers", "keyframes")


def windowed_events(spark, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.counted(e, "1 day").select(F.unix_seconds("window.start").alias("start"), "event_type", "n", r("total", 3).alias("total"))


def user_sessions(spark, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return K.sessions(e, 6 * 3600 * 1_000_000)


def loop_candidates(spark, d: str) -> DataFrame:
    """For each nation the three others with most shared parts (at least one), by (-shared, key)."""
    l = read(spark, d, "lineitem").join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("a"), F.col("l_partkey").alias("p")).distinct()
    both = l.join(l.select(F.col("a").alias("b"), "p"), "p").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).where("rank <= 3")


def rotation_fit(spark, d: str) -> DataFrame:
    """Rotations between bearings and their turned copies with one outlier in five, fitted by label."""
    o = observations(spark, d).select((F.crc32("label") % 100).alias("g"), F.col("id").alias("order"), G.ray_of(F.col("lon"), F.col("lat")).alias("a"))
    b = G.rotate(G.axis_rotation((0.2, 1.0, 0.1), 0.4), F.col("a"))
    bad = F.col("order") % 5 == 0
    p = o.select("g", "order", *[F.col("a")[k].alias(f"a{k}") for k in "xyz"], *[F.when(bad, F.col("a")[k]).otherwise(b[k]).alias(f"b{k}") for k in "xyz"])
    return B.fit_rotations(p, "g", 0.01).select("g", "n", "inliers", r("angle", 5).alias("angle"))


def triangulated_tracks(spark, d: str) -> DataFrame:
    """Rays from four places to known points, met again by least squares."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("track"), (F.col("p_size") - 25.0).alias("px"), (F.col("p_retailprice") / 100).alias("py"), (F.col("p_partkey") % 17 + 5.0).alias("pz"))
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy"), F.lit(0.0).alias("oz")) for x, y in ((0.0, 0.0), (3.0, 0.0), (0.0, 3.0), (2.0, 2.0))])).alias("o")
    ray = G.unit(G.ray(F.col("px") - F.col("ox"), F.col("py") - F.col("oy"), F.col("pz") - F.col("oz")))
    rows = p.select("*", at).select("track", "px", "py", "pz", "o.*").select("track", "ox", "oy", "oz", ray.alias("b")).select("track", "ox", "oy", "oz", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.z").alias("bz"), F.lit(1.0).alias("w"))
    return B.triangulate(rows).select("track", "n", *[r(k, 3).alias(k) for k in "xyz"])


_KNN = "n AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = {0} AND b.vec_id % 2 = {1}), k{0} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS rank FROM n)"

QUERIES = {
    "embedding_ratio_match": (embedding_ratio_match, f"WITH {_KNN.format(0, 1)} SELECT query_id, max(CASE WHEN rank=1 THEN train_id END) AS train_id, round(min(distance),5) AS distance FROM k0 WHERE rank <= 2 GROUP BY query_id HAVING min(distance) < 0.98*max(distance)"),
    "mutual_match": (mutual_match, f"WITH {_KNN.format(0, 1)}, f AS (SELECT * FROM k0 WHERE rank=1), g AS (SELECT * FROM (SELECT b.vec_id AS q, a.vec_id AS t, row_number() OVER (PARTITION BY b.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), a.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) WHERE rank = 1) SELECT query_id, train_id, round(distance,5) AS distance FROM f JOIN g ON g.q = train_id AND g.t = query_id"),
    "embedding_topk": (embedding_topk, "SELECT e.label, round(max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])),5) AS similarity, count(*) AS members FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE vec_id <> 0 GROUP BY 1 ORDER BY similarity DESC, label LIMIT 5"),
    "region_association": (region_association, """WITH s AS (SELECT CAST(s_nationkey AS BIGINT) AS class_id, s_suppkey AS id, (s_acctbal+1000)/11000 AS score FROM supplier), l AS (SELECT class_id, l_partkey AS p, l_suppkey AS id, min(l_quantity) AS q FROM lineitem JOIN s ON l_suppkey = id GROUP BY 1, 2, 3),
 m AS (SELECT a.class_id, a.id AS id_a, b.id AS id_b, count(*) AS matches, count(*) FILTER (WHERE abs(a.q-b.q)/10 <= 2) AS inliers, median(abs(a.q-b.q)/10) FILTER (WHERE abs(a.q-b.q)/10 <= 2) AS res FROM l a JOIN l b ON a.class_id = b.class_id AND a.p = b.p AND a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1, 2, 3),
 k AS (SELECT a.class_id, a.id AS id_a, b.id AS id_b, coalesce(matches,0) AS matches, coalesce(inliers,0) AS inliers, res, sqrt(a.score*b.score) AS sem, coalesce(inliers,0)/greatest(coalesce(matches,0),1)::DOUBLE AS ratio, CASE WHEN res IS NULL THEN 0 ELSE exp(-res/1.5) END AS fit FROM s a JOIN s b ON a.class_id = b.class_id AND a.id % 2 = 0 AND b.id % 2 = 1 LEFT JOIN m ON m.id_a = a.id AND m.id_b = b.id)
 SELECT class_id, id_a, id_b, matches, inliers, round(least(greatest(0.35*sem+0.4*ratio+0.25*fit,0),1),6) AS score, round(least(greatest(0.6*ratio+0.4*fit,0),1),6) AS geometric, CASE WHEN matches >= 3 AND inliers >= 3 AND coalesce(res,0) <= 1.5 THEN 'accepted' ELSE 'rejected' END AS state,
 concat_ws(',', CASE WHEN matches < 3 THEN 'too-few-region-matches' END, CASE WHEN inliers < 3 THEN 'too-few-region-pose-inliers' END, CASE WHEN res > 1.5 THEN 'high-region-pose-residual' END) AS reasons FROM k"""),
    "region_assignment": (region_assignment, None),
    "spatial_box_query": (spatial_box_query, f"WITH {OBSERVATIONS} SELECT id, round(lon,6) AS lon, round(lat,6) AS lat, label FROM observations WHERE lon BETWEEN 1.0 AND 2.5 AND lat BETWEEN -0.5 AND 0.7"),
    "neighbors": (neighbors, f"WITH {_EDGES} SELECT c AS node, count(*) AS degree, min(n) AS first, max(n) AS last FROM u GROUP BY 1"),
    "graph_components": (graph_components, f"WITH RECURSIVE {_EDGES}, w AS (SELECT c_custkey AS node, c_custkey AS root FROM customer UNION SELECT u.n, w.root FROM w JOIN u ON u.c = w.node WHERE w.root < u.n), m AS (SELECT node, min(root) AS root FROM w GROUP BY 1) SELECT root, count(*) AS members FROM m GROUP BY 1"),
    "hypotheses": (hypotheses, "WITH o AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS views, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders GROUP BY 1) SELECT o_custkey, views, round(mean/most,5) AS confidence, CASE WHEN views < 2 THEN 'proposed' WHEN round(mean/most,5) >= 0.55 THEN 'confirmed' WHEN round(mean/most,5) < 0.2 THEN 'dormant' ELSE 'ambiguous' END AS state FROM o"),
    "nms_angular": (nms_angular, None),
    "duplicate_free_events": (duplicate_free_events, "SELECT user_id, event_type, event_id, round(value,4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"),
    "resolution_plateau": (resolution_plateau, "WITH s AS (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY 1, 2), c AS (SELECT *, round(abs(lead(m) OVER (PARTITION BY p_brand ORDER BY p_size) - m)/m,9) AS change FROM s), w AS (SELECT *, max(change) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM c) SELECT p_brand, min(p_size) AS size FROM w WHERE worst < 0.1 OR worst IS NULL GROUP BY 1"),
    "text_query": (text_query, None),
    "canonical_ids": (canonical_ids, "SELECT conv_id, turn, substr(sha256(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, trim(text, ' '))),1,24) AS id FROM conversations"),
    "referential_integrity": (referential_integrity, "SELECT 'orders-customer' AS reference, count(*) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lineitem-supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'customer-orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "pair_affinity": (pair_affinity, "WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS n FROM l GROUP BY 1), b AS (SELECT a.s, c.s AS t, count(*) AS common FROM l a JOIN l c ON a.p = c.p AND a.s < c.s GROUP BY 1, 2) SELECT b.s, t, common, round(common/(x.n + y.n - common)::DOUBLE,6) AS jaccard FROM b JOIN n x ON x.s = b.s JOIN n y ON y.s = b.t"),
    "keyframes_stream": (keyframes_stream, None), "tracked_frames": (tracked_frames, None),
    "windowed_events": (windowed_events, "SELECT CAST(floor(epoch_us(ts)/86400000000.0) AS BIGINT)*86400 AS start, event_type, count(*) AS n, round(sum(value),3) AS total FROM events GROUP BY 1, 2"),
    "user_sessions": (user_sessions, "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS tm FROM events), s AS (SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS BIGINT) AS session FROM s) SELECT user_id, session, count(*) AS n, min(tm) AS first, max(tm) AS last FROM g GROUP BY 1, 2"),
    "loop_candidates": (loop_candidates, "WITH l AS (SELECT DISTINCT s_nationkey AS a, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), b AS (SELECT x.a, y.a AS b, count(*) AS shared FROM l x JOIN l y ON x.p = y.p AND x.a <> y.a GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS rank FROM b) WHERE rank <= 3"),
    "rotation_fit": (rotation_fit, None),
    "triangulated_tracks": (triangulated_tracks, "SELECT p_partkey AS track, CAST(4 AS BIGINT) AS n, round(p_size - 25.0::DOUBLE,3) AS x, round(p_retailprice/100,3) AS y, round(p_partkey % 17 + 5.0::DOUBLE,3) AS z FROM part"),
}
