"""Nearest neighbours by largest inner product with vantage-point trees, one for each shard.

Inner product is turned into a distance by one more component: with M the largest norm of all vectors, x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), so that |q - x|^2 = |q|^2 + M^2 - 2 <q, x> is smallest where the
inner product is largest.  Each tree splits its rows at the median distance from a vantage point; a query leaves a
branch if ``factor`` times the distance of the branch by the triangle inequality exceeds its k-th best so far.  Factor
one is exact search; more prunes more.  All rows are indexed; shards come from a hash of row and id.  The stated queries
go against all shards in blocks: a task holds one shard, its tree and one block, both bounded by parameters.

Leaves are scanned with a matrix product; whatever could be among the k best is scored again component by component, so
equal vectors score equally wherever they lie and ties go to the smaller id.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or candidates;
only vectors of equal length compare; repeated rows each count as candidates, but a repeated query is asked and answered
once, and rows that share a query's id are never its neighbours; rows with a null id take no part; with fewer than k
candidates all are returned; other columns are ignored, also if their names clash; empty tables work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import by_place, place


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in component order, so that equal vectors score equally wherever they lie."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * x[:, d]
    return out


class Best:
    """The k best (score, id, row) of each query; larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        both = np.concatenate([self.score[who], score], axis=1)
        names = np.concatenate([self.ids[who], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.score[who], self.ids[who] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, largest: float, factor: float = 1.0, leaf: int = 64) -> Best:
    """The k nearest rows of each query, by a vantage-point tree walked with all queries at once, nearer side first."""
    best = Best(len(q), k)
    if not len(x) or not len(q):
        return best
    square = (x * x).sum(1)
    lifted = np.concatenate([x, np.sqrt(np.maximum(0.0, largest**2 - square))[:, None]], axis=1)
    flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
    lengths = (q * q).sum(1) + largest**2
    slack = 1e-6 * (1.0 + np.sqrt(lengths))

    def build(rows: np.ndarray) -> tuple:
        if len(rows) <= leaf:
            return (rows,)
        vantage = lifted[rows[0]]
        d = np.sqrt(((lifted[rows] - vantage) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        return vantage, d[inner[-1]], d[outer[0]], build(rows[inner]), build(rows[outer])

    def visit(node: tuple, who: np.ndarray, bound: np.ndarray) -> None:
        """bound: how near the branch can be at the least, by the triangle inequalities above."""
        reach = np.sqrt(np.maximum(0.0, lengths[who] - 2 * best.score[who, -1]))  # infinite while fewer than k are known
        alive = bound * factor <= reach + slack[who]
        who, bound = who[alive], bound[alive]
        if not len(who):
            return
        if len(node) == 1:
            rows = node[0]
            for at in range(0, len(who), 2048):
                some = who[at : at + 2048]
                score = q[some] @ x[rows].T
                score[query_ids[some][:, None] == ids[rows][None, :]] = -np.inf  # never its own row
                near = score >= best.score[some, -1][:, None] - slack[some][:, None]
                asking = np.flatnonzero(near.any(1))
                if not len(asking):
                    continue
                near[np.isneginf(score)] = False
                at_q, at_x = np.nonzero(near[asking])
                score = np.full((len(asking), len(rows)), -np.inf)
                score[at_q, at_x] = products(q[some[asking][at_q]], x[rows[at_x]])
                best.offer(some[asking], score, np.where(np.isneginf(score), np.iinfo(np.int64).max, ids[rows][None, :]))
            return
        vantage, inner_far, outer_near, inner, outer = node
        d = np.sqrt(np.maximum(0.0, ((flat[who] - vantage) ** 2).sum(1)))
        to_inner, to_outer = np.maximum(bound, d - inner_far), np.maximum(bound, outer_near - d)
        first = d - inner_far < outer_near - d
        visit(inner, who[first], to_inner[first])
        visit(outer, who, to_outer)
        visit(inner, who[~first], to_inner[~first])

    order = np.argsort(ids, kind="stable")
    visit(build(order), np.arange(len(q)), np.zeros(len(q)))
    return best


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 32_768, block_rows: int = 8192, least_shards: int = 12
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` its k nearest others.

    There are as many shards as ``shard_rows`` asks for, and ``least_shards`` so that small tables occupy a cluster too.
    """
    rows = by_place(vectors).select(F.col(place(vectors, vec_id)).cast("long").alias("id"), F.col(place(vectors, embedding)).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("dims", F.size("v"))
    n, largest, asked = rows.agg(
        F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))), F.count_if(F.col("id") % every == 0)
    ).first()
    shards, blocks = max(1, min(n, least_shards), -(-n // shard_rows)), max(1, -(-asked // block_rows))
    numbers = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    name = F.xxhash64("v")
    points = rows.select("dims", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.explode(numbers(blocks)).alias("block"), "id", "v")
    distinct = rows.where(F.col("id") % every == 0).groupBy("id", name.alias("name")).agg(F.first("v").alias("v"), F.first("dims").alias("dims"))
    queries = distinct.select("dims", F.explode(numbers(shards)).alias("shard"), F.pmod(F.xxhash64("id", "name"), F.lit(blocks)).cast("int").alias("block"), "id", "name", "v")
    top = float(largest or 0.0)

    def run(x: pa.Table, asking: pa.Table) -> pa.Table:
        def take(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            flat = t.column("v").combine_chunks().flatten().to_numpy()
            return t.column("id").to_numpy().astype(np.int64), flat.reshape(t.num_rows, -1) if t.num_rows else flat.reshape(0, 0)

        ids, own = take(x)
        query_ids, q = take(asking)
        if not len(ids) or not len(query_ids):
            return pa.table({"query_id": pa.array([], pa.int64()), "name": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = search(ids, own, query_ids, q, k, top, factor)
        at, place_ = np.nonzero(~np.isneginf(best.score))
        return pa.table({"query_id": query_ids[at], "name": asking.column("name").to_numpy()[at], "vec_id": best.ids[at, place_], "score": best.score[at, place_]})

    found = points.groupBy("dims", "shard", "block").cogroup(queries.groupBy("dims", "shard", "block")).applyInArrow(run, "query_id long, name long, vec_id long, score double")
    order = Window.partitionBy("query_id", "name").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
