"""SimHash near-duplicates with vantage-point trees over Hamming distance.

Fingerprints are the bitwise majority of the XXH64 of word shingles.  Only distinct fingerprints are compared.  They are
dealt to shards in which every pair within the radius meets: the 64 bits are cut into radius + 2 pieces, of which two
must then be equal, so a shard holds what agrees in one choice of two pieces.  The shard's vantage point is that choice
with all other bits zero; its members are partitioned into rings of Hamming distance from it, at every size.  By the
triangle inequality a partner lies within the radius of the own distance, so members near a boundary also query the ring
that they overlap.  Inside a ring a vantage-point tree prunes by the same bound and yields exact pairs, of which only a
spanning forest leaves the task.  Components of the forests are joined by large-star and small-star rounds on
checkpointed edges.  Copies are never expanded into pairs and nothing is collected in the driver.

Edge cases: null and empty texts have fingerprint zero and link like any other; a null doc_id never becomes the
component's id unless all of its rows have none (then it is null); repeated rows repeat; empty tables work; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import regions
from ._common import blank_words, by_place, place, rows_by_arrow, settle


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; the whole sequence if it is shorter, nothing without words."""
    w = blank_words(text)
    digest = xxhash.xxh64_intdigest
    n = max(1, len(w) - words + 1) if w else 0
    return np.fromiter((digest(b" ".join(w[k : k + words]), 42) for k in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit by bit, whether it is set in more than half of the hashes; zero without hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded scratch for very long texts
        votes += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the shingles' hashes."""
    return majority(shingle_hashes(text, words))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, text)).cast("string").alias("text"))
    return rows_by_arrow(rows, "doc_id long, fp long", lambda doc_id, text: {"doc_id": doc_id, "fp": [signed(fingerprint(t, words)) for t in text]})


class Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def tree_links(points: np.ndarray, queries: np.ndarray, radius: int, leaf: int = 32) -> Iterator[tuple[int, int]]:
    """(query, point) positions within the radius: a vantage-point tree over the points, walked with all queries at once.

    A query leaves a branch as soon as the triangle inequality shows that nothing in it can be near enough.
    """
    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        own, asking = stack.pop()
        if not len(own) or not len(asking):
            continue
        inner = None
        if len(own) > leaf:
            vantage = points[own[0]]
            d = np.bitwise_count(points[own] ^ vantage)
            middle = int(np.median(d))
            inner = d <= middle
            if inner.all():
                middle -= 1
                inner = d <= middle
        if inner is None or inner.all() or not inner.any():
            for at in range(0, len(asking), 1024):
                some = asking[at : at + 1024]
                for lo in range(0, len(own), 1024):
                    part = own[lo : lo + 1024]
                    q, p = np.nonzero(np.bitwise_count(queries[some][:, None] ^ points[part][None, :]) <= radius)
                    yield from zip(some[q].tolist(), part[p].tolist(), strict=True)
            continue
        dq = np.bitwise_count(queries[asking] ^ vantage).astype(np.int16)
        stack.append((own[inner], asking[dq <= middle + radius]))
        stack.append((own[~inner], asking[dq > middle - radius]))


def links(distinct: DataFrame, radius: int = 3, ring: int = 13, bundle_rows: int = 2_500) -> DataFrame:
    """Edges a > b (signed longs) whose components are those of all pairs of distinct fp within the radius."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    pieces = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    choices = [signed(a | b) for a, b in combinations(pieces, 2)]
    bundles = max(1, distinct.count() * len(choices) // bundle_rows)  # many shards to a task, each ring whole
    each = distinct.select("fp", F.posexplode(F.array(*[F.lit(c) for c in choices])).alias("choice", "mask"))
    d = F.bit_count(F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    home = F.floor(d / ring)
    near = F.array_distinct(F.array(home, F.floor(F.greatest(d - radius, F.lit(0)) / ring), F.floor((d + radius) / ring)))
    dealt = each.select("fp", F.col("choice").cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), home.alias("home"), F.explode(near).alias("ring"))
    bundled = dealt.select("fp", "choice", F.col("ring").cast("byte").alias("ring"), (F.col("home") == F.col("ring")).alias("own"), F.pmod(F.xxhash64("choice", "value", "ring"), F.lit(bundles)).cast("int").alias("bundle"))
    masks = np.array(choices, np.int64)

    def pair(bundle: pa.Table) -> pa.Table:
        choice, at, fp = (bundle.column(c).to_numpy().astype(np.int64) for c in ("choice", "ring", "fp"))
        own = bundle.column("own").to_numpy(zero_copy_only=False).astype(bool)
        value = fp & masks[choice]
        order = np.lexsort((fp, ~own, at, value, choice))
        choice, value, at, fp, own = choice[order], value[order], at[order], fp[order], own[order]
        edge = np.flatnonzero((np.diff(choice) != 0) | (np.diff(value) != 0) | (np.diff(at) != 0)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(fp)]])
        bits, forest = fp.view(np.uint64), Forest(len(fp))
        for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            mine = int(own[lo:hi].sum())  # own members come first and are the points, all are queries
            for q, p in tree_links(bits[lo : lo + mine], bits[lo:hi], radius) if mine else ():
                if p != q:
                    forest.join(lo + q, lo + p)
        roots = np.fromiter((forest.root(k) for k in range(len(fp))), np.int64, len(fp))
        tied = np.flatnonzero(fp[roots] != fp)
        return pa.table({"a": pa.array(fp[tied], pa.int64()), "b": pa.array(fp[roots[tied]], pa.int64())})

    return bundled.groupBy("bundle").applyInArrow(pair, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) but the roots; root is the smallest node reachable."""
    edges = settle(edges.where("a <> b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return regions.components(nodes, edges).where("node <> root")


def groups(marks: DataFrame, radius: int = 3) -> DataFrame:
    """fp, root (a fingerprint that stands for the component) and component_id (smallest doc_id) of distinct fp."""
    firsts = marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = firsts.join(components(links(firsts.select("fp"), radius)), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    marks = settle(fingerprints(docs, doc_id, text, words))
    grouped = groups(marks, radius)
    return marks.join(grouped, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
