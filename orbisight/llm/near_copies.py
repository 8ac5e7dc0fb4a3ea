"""One document of each group of near copies: SimHash links first, then every pair at the stated Jaccard similarity.

This is the form of the SimHash operator for a similarity that its radius does not reach: texts with five-word shingles at
Jaccard 0.8 differ by 5 to 10 of 64 bits, where rings around vantage points overlap almost wholly.  Fingerprints and
vantage-point trees find the nearest pairs; MinHash bands find the rest, 32 bands of four minima each, of which a pair at
0.8 shares one but for a chance of (1 - 0.8**4)**32 = 5e-8.  Every link is an exact comparison of whole shingle sets.

A band of N sets has N**2 pairs, so few are formed.  Each set is checked against the least of its band.  Pairs inside one
component need no check.  A set can only be linked to another by shingles which others have too: with u such shingles of n, a partner of s shingles needs u >= t / (1 + t) * (n + s).  So each set outside the band's
main component meets only the sizes that this leaves, as an equi-join on (band, size step), in which 512 parities of each
set bound their difference from below.  No candidate is dropped otherwise, and no set is gathered with its group in one
task.

Edge cases: a text of fewer than five words is one shingle; null and empty texts are copies of one another; rows without
a doc_id come last in their group; rows that share doc_id and text leave one; empty tables work; other columns, maps and
names that differ only in case too, are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ._common import by_place, place, rows_by_arrow, settle
from .simhash import components, links, majority, shingle_hashes, signed

BANDS, MINIMA = 32, 4
#: Rows of (band, set) for a task of what follows them; small inputs run few tasks, large ones as many as there are.
TASK_ROWS = 50_000
#: Longs of parities kept for each set: bit k is the parity of the number of shingles whose hash ends in k.
PARITIES = 8
_RNG = np.random.default_rng(20)
_MASK, _ODD = _RNG.integers(0, 1 << 64, (2, BANDS * MINIMA, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima, as signed longs; nothing for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, ((found[None, at : at + 512] ^ _MASK) * _ODD).min(1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Bits in which two of these differ are at most as many as shingles that only one of the sets has."""
    odd = np.bincount((found & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64))


def _key(text: Column) -> Column:
    """Names a text; null and empty are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def alike(pairs: DataFrame, bodies: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity reaches ``similarity``; sizes and parities rule out most of the others first."""
    small, t = [F.size("body").alias("n"), "parity"], similarity
    told = lambda c, *what: bodies.select(F.col("set").alias(c), F.struct(*what).alias(f"of_{c}"))
    n, m = F.col("of_a.n"), F.col("of_b.n")
    apart = sum((F.bit_count(F.col("of_a.parity")[k].bitwiseXOR(F.col("of_b.parity")[k])) for k in range(PARITIES)), F.lit(0))
    near = (F.least(n, m) >= F.greatest(n, m) * t - 1e-9) & (apart <= (1 - t) / (1 + t) * (n + m) + 1e-9)
    left = pairs.join(told("a", *small), "a").join(told("b", *small), "b").where(near).select("a", "b").coalesce(tasks)
    both = F.size(F.array_intersect("of_a.body", "of_b.body"))
    whole = left.join(told("a", "body"), "a").join(told("b", "body"), "b")
    return whole.where(both >= (F.size("of_a.body") + F.size("of_b.body") - both) * F.lit(t) - 1e-9).select("a", "b").coalesce(tasks)


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with one fingerprint, and of those that the vantage-point trees link."""
    prints = settle(sets.groupBy("fp").agg(F.min("set").alias("first")))
    same = sets.join(prints, "fp").where("`set` <> first").select(F.col("set").alias("a"), F.col("first").alias("b"))
    near = links(prints.select("fp"))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"set_{c}"))
    return same.unionByName(near.join(of("a"), "a").join(of("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def torn_bands(near: DataFrame, roots: DataFrame, tasks: int) -> DataFrame:
    """(band, set, size, root) of the bands whose sets lie in more than one component."""
    rooted = near.join(roots, F.col("set") == F.col("node"), "left").select("band", "set", "size", F.coalesce("root", "set").alias("root"))
    torn = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    return settle(rooted.join(torn, "band").coalesce(tasks))


def pairs_by_size(torn: DataFrame, bodies: DataFrame, similarity: float, tasks: int) -> DataFrame:
    """The pairs of a torn band, of different components, that the shingles they can share still allow."""
    t, step = similarity, math.log(1.03)
    sets = torn.select("set").distinct()
    each = bodies.join(sets, "set").select("set", F.explode("body").alias("h"))
    own = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("set")).where("n = 1").coalesce(tasks).groupBy("set").agg(F.count(F.lit(1)).alias("own"))
    bits = [f"p{k}" for k in range(PARITIES)]
    common = bodies.join(own, "set", "left").select("set", (F.size("body") - F.coalesce("own", F.lit(0))).alias("u"), *[F.col("parity")[k].alias(c) for k, c in enumerate(bits)])
    grade = lambda c: F.floor(F.log(F.col(c).cast("double")) / step).cast("int")
    least, most = F.ceil(t * F.col("size") - 1e-9), F.floor(F.least(F.col("size") / t, F.col("u") * (1 + t) / t - F.col("size")) + 1e-9)
    open_ = torn.join(common, "set").withColumns({"least": least, "most": most}).where("most >= least")
    main = open_.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    open_ = settle(open_.join(main, "band").coalesce(tasks))
    asking = open_.where("root <> main").select("band", "set", "size", "root", "least", "most", *bits, F.explode(F.sequence(grade("least"), grade("most"))).alias("grade"))
    asked = open_.select("band", grade("size").alias("grade"), F.col("set").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("least").alias("least_b"), F.col("most").alias("most_b"), *[F.col(c).alias(f"{c}_b") for c in bits])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in bits), F.lit(0))
    fits = F.col("size_b").between(F.col("least"), F.col("most")) & F.col("size").between(F.col("least_b"), F.col("most_b")) & (F.col("root") != F.col("root_b"))
    near = apart <= (1 - t) / (1 + t) * (F.col("size") + F.col("size_b")) + 1e-9
    met = asking.join(asked, ["band", "grade"]).where(fits & near)
    return met.select(F.greatest("set", "b").alias("a"), F.least("set", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def set_links(texts: DataFrame, marks: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the sets that are linked to another one; ``texts`` has (key, text)."""
    sets = marks.where("size > 0").dropDuplicates(["set"]).select("set", "size", "key", "fp", "bands")
    keyed = sets.select("set", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("band")
    banded = settle(keyed.join(shared, "band"))
    tasks = max(2, -(-banded.count() // TASK_ROWS))
    banded = banded.coalesce(tasks)
    sets = settle(sets.join(banded.select("set").distinct(), "set").select("set", "size", "key", "fp").coalesce(tasks))
    near = banded.join(sets.select("set", "size"), "set")
    wanted = texts.join(sets.select("set", "key"), "key").groupBy("set").agg(F.min("text").alias("text"))

    def body(set: list, text: list) -> dict:  # noqa: A002
        own = [np.unique(shingle_hashes(t, words)) for t in text]
        return {"set": set, "body": [x.view(np.int64) for x in own], "parity": [parities(x) for x in own]}

    bodies = settle(rows_by_arrow(wanted, "set long, body array<long>, parity array<long>", body).coalesce(2 * tasks))

    least = banded.groupBy("band").agg(F.min("set").alias("b"))
    stars = banded.join(least, "band").where(F.col("set") != F.col("b")).select(F.col("set").alias("a"), "b")
    found = settle(alike(fingerprint_pairs(sets).unionByName(stars).coalesce(tasks).distinct().coalesce(tasks), bodies, similarity, tasks))
    roots = components(found)
    torn = torn_bands(near, roots, tasks)
    if torn.isEmpty():
        return roots
    return components(found.unionByName(alike(pairs_by_size(torn, bodies, similarity, tasks), bodies, similarity, tasks)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows, columns as they were, that stand for their group: one of the smallest doc_id; if it repeats, one of them."""
    own, at, body = by_place(docs), place(docs, doc_id), F.col(place(docs, text)).cast("string")
    rows = own.select(F.col(at).cast("long").alias("doc_id"), _key(body).alias("key"), body.alias("text"))

    def make(doc_id: list, key: list, text: list) -> dict:
        out: dict[str, list] = {"doc_id": doc_id, "key": key, "fp": [], "set": [], "size": [], "bands": []}
        for t in text:
            hashes = shingle_hashes(t, words)
            found = np.unique(hashes)
            for name, value in (("fp", signed(majority(hashes))), ("set", _digest(found)), ("size", len(found)), ("bands", bands(found))):
                out[name].append(value)
        return out

    marks = settle(rows_by_arrow(rows, "doc_id long, key binary, fp long, set long, size int, bands array<long>", make))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("key")))
    firsts = marks.groupBy("set").agg(first.alias("first"))
    roots = set_links(rows.select("key", "text"), marks, words, similarity)
    grouped = firsts.join(roots, F.col("set") == F.col("node"), "left").groupBy(F.coalesce("root", "set")).agg(F.min("first").alias("first"))
    names = ["none", "id", "key"]
    named = own.select(F.struct(*own.columns).alias("row"), F.col(at).cast("long").isNull().alias("none"), F.coalesce(F.col(at).cast("long"), F.lit(0)).alias("id"), _key(body).alias("key"))
    others = [F.col(f"row.{c}") for c in own.columns if c != place(docs, text)]
    kept = named.join(grouped.select("first.*"), names, "left_semi").groupBy(*names).agg(F.min_by("row", F.to_json(F.struct(*others))).alias("row"))
    return kept.select("row.*").toDF(*docs.columns)
