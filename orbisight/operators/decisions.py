"""Decisions over evidence: exclusive claims, confidence of components, match priors, acceptance with reasons, priors by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def exclusive_claims(claims: DataFrame, cell: Sequence[str], segment: str, quality: str) -> DataFrame:
    """Each claimed cell goes once to the best segment: highest quality, then smallest id; one partial aggregate."""
    best = F.min(F.struct((-F.col(quality)).alias("q"), F.col(segment).alias("s")))
    return claims.groupBy(*cell).agg(best.alias("best")).select(*cell, F.col("best.s").alias(segment))


def component_confidence(edges: DataFrame, component: str, group: str, confidence: str, positive: Column, semantic: str) -> DataFrame:
    """Mean over groups of the best positive edge, less what the best negative edge takes away.

    Correlated edges count once: each (component, group, polarity) gives its maximum.  Without positive edges half of the
    best semantic score stands.
    """
    once = edges.groupBy(component, F.col(group).alias("_group"), positive.alias("_positive")).agg(F.max(confidence).alias("best"), F.max(semantic).alias("semantic"))
    sums = once.groupBy(component).agg(
        F.avg(F.when(F.col("_positive"), F.col("best"))).alias("yes"), F.coalesce(F.max(F.when(~F.col("_positive"), F.col("best"))), F.lit(0.0)).alias("no"), F.max("semantic").alias("semantic")
    )
    left = F.greatest(F.lit(0.0), F.col("yes") * (1 - F.col("no")))
    return sums.select(component, F.when(F.col("yes").isNull(), F.col("semantic") * 0.5).otherwise(left).alias("confidence"))


def promotion_state(views: Column, confidence: Column, least_views: int = 2, least_confidence: float = 0.55, dormant_below: float = 0.2) -> Column:
    """Few views are proposed; of the others the sure ones are confirmed, the unsure dormant, and what lies between ambiguous."""
    return F.when(views < least_views, "proposed").when(confidence >= least_confidence, "confirmed").when(confidence < dormant_below, "dormant").otherwise("ambiguous")


def match_prior(matches: DataFrame, pair: str, support: str, valid: Column, mix: float, power: float, most_ratio: float) -> DataFrame:
    """Of every pair: valid and supported matches, effective sample size and the largest ratio of weights.

    Supports are scaled by the pair's largest, mixed with a uniform part and capped at a ratio to the smallest; a pair
    without support is uniform, one without valid matches has zeros.
    """
    s = F.when(valid, F.col(support))
    ends = matches.groupBy(pair).agg(F.max(s).alias("top"), F.min(s).alias("low"), F.count(s).alias("n_valid"), F.count_if(s > 0).alias("n_supported"))
    rows = matches.select(pair, s.alias("s")).where("s is not null").join(ends, pair)
    mixed = lambda c: mix + (1 - mix) * F.pow(F.col(c) / F.nullif(F.col("top"), F.lit(0.0)), F.lit(power))
    weight = F.when(F.col("top") <= 0, F.lit(1.0)).otherwise(F.least(mixed("s"), mixed("low") * most_ratio))
    sums = rows.groupBy(pair).agg(F.sum(weight).alias("w"), F.sum(weight * weight).alias("ww"), F.max(weight).alias("most"), F.min(weight).alias("least"))
    ess, ratio = F.col("w") * F.col("w") / F.col("ww"), F.col("most") / F.col("least")
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return ends.join(sums, pair, "left").select(pair, "n_valid", "n_supported", zero(ess, "effective_size"), zero(ratio, "weight_ratio"))


def judged(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``reasons`` names every rule whose column is true, in the rules' order; ``accepted`` if there is none."""
    named = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return df.withColumn("reasons", named).withColumn("accepted", F.size("reasons") == 0)


def unmatched_priors(priors: DataFrame, tracks: DataFrame, on: Sequence[str], by: str) -> DataFrame:
    """Of every ``by``: priors that some track observes, and those that none does; tracks are made distinct before the join."""
    seen = tracks.select(*on).distinct().withColumn("_seen", F.lit(True))
    return priors.join(seen, list(on), "left").groupBy(by).agg(F.count("_seen").alias("matched"), F.count_if(F.col("_seen").isNull()).alias("unmatched"))


def proposal_origins(proposals: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, origin) of rows (id, parent, source): ``cam`` or ``coverage`` by the root of the parent chain, else ``unresolved``.

    Only rows of source ``frontier`` point on; a missing parent leaves the chain unresolved and a cycle is an error.  Each
    round doubles what every pointer skips, so the rounds grow with the logarithm of the longest chain; ids are unique.
    """
    from .regions import checkpointed

    open_end = F.col("source") == "frontier"
    root = F.when(F.col("source") == "semantic", "cam").when(~open_end, "coverage")
    state = checkpointed(proposals.select("id", F.when(open_end & F.col("parent").isNotNull(), F.col("parent")).alias("at"), F.when(open_end & F.col("parent").isNull(), "unresolved").otherwise(root).alias("origin")))
    for _ in range(most_rounds):
        if state.where("origin is null").isEmpty():
            return state.select("id", "origin")
        done = state.where("origin is not null").select("id", "origin")
        nodes = state.select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("origin").alias("found"), F.lit(True).alias("known"))
        moved = state.where("origin is null").join(nodes, "at", "left")
        moved = moved.select("id", F.col("further").alias("at"), F.when(F.col("known").isNull(), "unresolved").otherwise(F.col("found")).alias("origin"))
        state = checkpointed(moved.unionByName(done.select("id", F.lit(None).cast(moved.schema["at"].dataType).alias("at"), "origin")))
    raise ValueError("the parents of proposals form a cycle")


def stereo_view_pairs(pairs: DataFrame, least_score: float = 0.2, least_overlap: float = 0.05, most: int | None = 3) -> DataFrame:
    """Scored pairs of views, at most ``most`` of each reference: by score, then source.

    Reads reference, source, support_a, support_b, overlap, share (of matches) and residual (median epipolar, null: none).
    """
    parts = 0.60 * F.col("overlap") + 0.25 * F.least(F.lit(1.0), 8 * F.col("share")) + 0.15 * F.coalesce(F.exp(-F.col("residual") / 0.01), F.lit(0.0))
    kept = pairs.withColumn("score", F.sqrt(F.col("support_a") * F.col("support_b")) * parts).where((F.col("score") >= least_score) & (F.col("overlap") >= least_overlap))
    if most is None:
        return kept
    place = F.row_number().over(Window.partitionBy("reference").orderBy(F.desc("score"), "source"))
    return kept.withColumn("place", place).where(F.col("place") <= most)
