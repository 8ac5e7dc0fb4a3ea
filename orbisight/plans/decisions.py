"""Queries that decide over evidence: claims, confidences, priors and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import decisions as D
from ..sources.tables import EVIDENCE, evidence, read
from .area import r

#: Parameters of the match prior: uniform part, exponent, largest ratio.
MIX, POWER, RATIO = 0.25, 1.0, 4.0


def panoptic_map(spark, d: str) -> DataFrame:
    """Parts are cells, suppliers segments, the quantity their quality; returned items claim nothing."""
    claims = read(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("segment"), F.col("l_quantity").alias("quality"))
    return D.exclusive_claims(claims, ["cell"], "segment", "quality")


def component_confidence(spark, d: str) -> DataFrame:
    edges = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("component"), (F.col("l_partkey") % 7).alias("g"), (F.col("l_discount") * 4).alias("c"), "l_returnflag", (F.col("l_tax") * 10).alias("s"))
    return D.component_confidence(edges, "component", "g", "c", F.col("l_returnflag") == "A", "s").select("component", r("confidence").alias("confidence"))


def semantic_match_prior(spark, d: str) -> DataFrame:
    matches = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.sqrt(F.col("l_discount") * F.col("l_tax")).alias("support"), "l_returnflag")
    found = D.match_prior(matches, "pair", "support", F.col("l_returnflag") != "R", MIX, POWER, RATIO)
    return found.select("pair", "n_valid", "n_supported", r("effective_size", 4).alias("effective_size"), r("weight_ratio", 4).alias("weight_ratio"))


def pose_acceptance(spark, d: str) -> DataFrame:
    """Orders by customer as pose reports: inliers, their share and a residual against thresholds."""
    done = F.col("o_orderstatus") == "F"
    reports = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("pair")).agg(F.count_if(done).alias("inliers"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("residual"))
    rules = [("too-few-inliers", F.col("inliers") < 4), ("low-inlier-ratio", F.col("inliers") < 0.4 * F.col("n")), ("high-residual", F.col("residual") > 400000)]
    return D.judged(reports, rules).select("pair", "accepted", F.array_join("reasons", ",").alias("reasons"))


def range_prior_matches(spark, d: str) -> DataFrame:
    priors = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("panorama"))
    tracks = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return D.unmatched_priors(priors, tracks, ["k"], "panorama")


def proposal_origins(spark, d: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "semantic").when(F.col("c_mktsegment") == "MACHINERY", "exhaustive").otherwise("frontier")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.floor(F.col("c_custkey") / 3) - 1).cast("long").alias("parent"), kind.alias("source"))
    return D.proposal_origins(rows)


def stereo_view_pairs(spark, d: str) -> DataFrame:
    """Even views as references and odd ones as sources; overlap and share from the valid cells both see."""
    e = evidence(spark, d).where("valid")
    n = e.groupBy("view").agg(F.count(F.lit(1)).alias("n"))
    side = lambda odd, name: e.where(F.col("view") % 2 == odd).select("cell", F.col("view").alias(name), F.col("value").alias(f"{name}_value"))
    gap = F.abs(F.col("reference_value") - F.col("source_value")) / 4e6
    seen = side(0, "reference").join(side(1, "source"), "cell").groupBy("reference", "source").agg(F.count(F.lit(1)).alias("shared"), F.percentile(gap, 0.5).alias("residual"))
    sized = seen.join(n.select(F.col("view").alias("reference"), F.col("n").alias("na")), "reference").join(n.select(F.col("view").alias("source"), F.col("n").alias("nb")), "source")
    one = F.lit(0.9)
    rows = sized.select("reference", "source", one.alias("support_a"), one.alias("support_b"), ((F.col("shared") / F.col("na") + F.col("shared") / F.col("nb")) / 2).alias("overlap"), (F.col("shared") / (F.col("na") + F.col("nb"))).alias("share"), "residual")
    return D.stereo_view_pairs(rows).select("reference", "source", r("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


QUERIES = {
    "panoptic_map": (panoptic_map, "SELECT cell, segment FROM (SELECT l_partkey AS cell, l_suppkey AS segment, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1"),
    "component_confidence": (component_confidence, """WITH o AS (SELECT l_suppkey AS component, l_partkey % 7 AS g, l_returnflag = 'A' AS p, max(l_discount*4) AS best, max(l_tax*10) AS s FROM lineitem GROUP BY 1, 2, 3),
 c AS (SELECT component, avg(best) FILTER (WHERE p) AS yes, coalesce(max(best) FILTER (WHERE NOT p), 0) AS no, max(s) AS s FROM o GROUP BY 1)
 SELECT component, round(CASE WHEN yes IS NULL THEN s*0.5 ELSE greatest(0, yes*(1-no)) END, 6) AS confidence FROM c"""),
    "semantic_match_prior": (semantic_match_prior, f"""WITH m AS (SELECT l_suppkey AS pair, CASE WHEN l_returnflag <> 'R' THEN sqrt(l_discount*l_tax) END AS s FROM lineitem),
 e AS (SELECT pair, max(s) AS top, min(s) AS low, count(s) AS n_valid, count(*) FILTER (WHERE s > 0) AS n_supported FROM m GROUP BY 1),
 w AS (SELECT pair, CASE WHEN top <= 0 THEN 1::DOUBLE ELSE least({MIX}::DOUBLE + {1 - MIX}::DOUBLE*pow(s/nullif(top,0), {POWER}), ({MIX}::DOUBLE + {1 - MIX}::DOUBLE*pow(low/nullif(top,0), {POWER}))*{RATIO}::DOUBLE) END AS w FROM m JOIN e USING (pair) WHERE s IS NOT NULL),
 t AS (SELECT pair, sum(w)*sum(w)/sum(w*w) AS ess, max(w)/min(w) AS ratio FROM w GROUP BY 1)
 SELECT pair, n_valid, n_supported, round(coalesce(ess,0),4) AS effective_size, round(coalesce(ratio,0),4) AS weight_ratio FROM e LEFT JOIN t USING (pair)"""),
    "pose_acceptance": (pose_acceptance, """WITH p AS (SELECT o_custkey AS pair, count(*) FILTER (WHERE o_orderstatus = 'F') AS i, count(*) AS n, max(o_totalprice) AS x FROM orders GROUP BY 1)
 SELECT pair, NOT (i < 4 OR i < 0.4::DOUBLE*n OR x > 400000) AS accepted, concat_ws(',', CASE WHEN i < 4 THEN 'too-few-inliers' END, CASE WHEN i < 0.4::DOUBLE*n THEN 'low-inlier-ratio' END, CASE WHEN x > 400000 THEN 'high-residual' END) AS reasons FROM p"""),
    "range_prior_matches": (range_prior_matches, "SELECT c_nationkey AS panorama, count(*) FILTER (WHERE s) AS matched, count(*) FILTER (WHERE s IS NULL) AS unmatched FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k, true AS s FROM orders WHERE o_orderpriority = '1-URGENT') ON k = c_custkey GROUP BY 1"),
    "proposal_origins": (proposal_origins, """WITH RECURSIVE p AS (SELECT c_custkey AS id, CAST(floor(c_custkey / 3) AS BIGINT) - 1 AS parent, CASE c_mktsegment WHEN 'BUILDING' THEN 'cam' WHEN 'MACHINERY' THEN 'coverage' END AS origin FROM customer),
 w AS (SELECT id, parent, origin FROM p UNION ALL SELECT w.id, q.parent, CASE WHEN q.id IS NULL THEN 'unresolved' ELSE q.origin END FROM w LEFT JOIN p q ON q.id = w.parent WHERE w.origin IS NULL)
 SELECT id, origin FROM w WHERE origin IS NOT NULL"""),
    "stereo_view_pairs": (stereo_view_pairs, f"""WITH {EVIDENCE}, v AS (SELECT * FROM evidence WHERE valid), n AS (SELECT view, count(*) AS n FROM v GROUP BY 1),
 s AS (SELECT a.view AS reference, b.view AS source, count(*) AS shared, median(abs(a.value - b.value)/4e6) AS residual FROM v a JOIN v b USING (cell) WHERE a.view % 2 = 0 AND b.view % 2 = 1 GROUP BY 1, 2),
 t AS (SELECT reference, source, (shared/x.n + shared/y.n)/2 AS overlap, shared/(x.n + y.n) AS share, residual FROM s JOIN n x ON x.view = reference JOIN n y ON y.view = source),
 u AS (SELECT reference, source, 0.9::DOUBLE*(0.60::DOUBLE*overlap + 0.25::DOUBLE*least(1.0::DOUBLE, 8*share) + 0.15::DOUBLE*exp(-residual/0.01::DOUBLE)) AS score FROM t WHERE overlap >= 0.05)
 SELECT reference, source, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY score DESC, source) AS place FROM u WHERE score >= 0.2) WHERE place <= 3"""),
}
