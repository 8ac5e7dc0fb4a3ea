"""How far the sources of a language differ: exact integer divergences from dense tiles of groups by terms.

One row for each (lang, term, source) with its count comes from tasks that count batches of text; rows of a term lie
together, so its document count needs no second exchange.  Kept terms are dealt to blocks of about ``TERMS`` terms, sources
to blocks of about ``GROUPS``.  Each pair of source blocks and block of terms is one int64 tile of smoothed shares, in which
all pairs are computed by broadcasting; a partial matrix of pair sums and the heap of each group's best terms leave it.
Partial sums are added up as usual, and heaps merge by rank in two steps, so nothing holds a language whole.

Edge cases: null text, lang and source are ''; every row is a document, so repeated rows count as often as they occur; a
text of any length is read whole; groups without terms, and languages of which no term is kept, are there with 0; ties
go by UTF-8 order; empty tables give an empty result; other columns are ignored, also if their names clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._common import by_place, place, settle

#: Keeps letters in lower case and every byte of a non-ASCII character, blanks the rest.
_LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SCALE, TERMS, GROUPS = 1_000_000_000, 1024, 32
#: Bytes of text counted at once in a task.
CHUNK = 8 << 20
#: A language's few numbers are there this many times, so that its terms and sources find them in as many tasks.
SALTS = 256


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), by long division in three digits of 1000, so products stay in 64 bits."""
    base, left, found = total + 2 * kept, count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, base)
        found = found * 1000 + digit
    return found + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and documents of a batch of (lang, source, text), by chunk."""
    pairs = [tuple(pair) for pair in zip(*(batch.column(k).cast(pa.binary()).to_pylist() for k in (0, 1)), strict=True)]
    texts, start = batch.column(2).cast(pa.binary()), 0
    while start < len(pairs):
        held, end, size = [], start, 0
        while end < len(pairs) and (end == start or size + len(texts[end].as_buffer()) <= CHUNK):
            held.append(texts[end].as_buffer().to_pybytes().translate(_LETTERS).split())
            size += len(texts[end].as_buffer())
            end += 1
        groups = sorted(set(pairs[start:end]))
        at = {g: k for k, g in enumerate(groups)}
        length = np.fromiter(map(len, held), np.int64, len(held))
        coded = pa.array([t for words in held for t in words], pa.binary()).dictionary_encode()
        code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
        group = np.fromiter((at[p] for p in pairs[start:end]), np.int64, end - start)
        key, n = np.unique(np.repeat(group, length) * many + code, return_counts=True)
        once = np.unique(np.repeat(np.arange(end - start), length) * many + code)
        docs = np.unique(group[once // many] * many + once % many, return_counts=True)[1]
        of = pa.array(key // many)
        names = [pc.take(pa.array([g[k] for g in groups], pa.binary()), of).view(pa.string()) for k in (0, 1)]
        term = coded.dictionary.take(pa.array(key % many)).view(pa.string())
        yield pa.RecordBatch.from_arrays([*names, term, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
        start = end
    pa.default_memory_pool().release_unused()


def documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source and text, null as ''."""
    return by_place(docs).select(*[F.coalesce(F.col(place(docs, c)).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])


def counts(rows: DataFrame) -> DataFrame:
    """lang, term, source, n, docs of every term and group of (lang, source, text); docs is that of the term in the language."""
    found = rows.mapInArrow(lambda batches: (out for batch in batches for out in _counted(batch)), "lang string, source string, term string, n long, docs long")
    each = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return each.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term")))


def _tile(key: tuple, table: pa.Table, best: int) -> pa.Table:
    """All pairs between two blocks of sources in one block of terms, and in a diagonal tile the best terms of each group."""
    lang, _, a, b = (k.as_py() for k in key)
    groups = table.filter(pc.is_null(table["term"])).select(["source", "block", "total", "kept", "whole"]).to_pylist()
    groups.sort(key=lambda g: g["source"].encode("utf-8", "surrogatepass"))
    at = {g["source"]: k for k, g in enumerate(groups)}
    cells = table.filter(pc.is_valid(table["term"]))
    total = np.array([g["total"] for g in groups], np.int64)[:, None]
    kept, whole = groups[0]["kept"], groups[0]["whole"]
    coded = cells["term"].combine_chunks().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    n = np.zeros((len(groups), len(terms)), np.int64)
    where = np.array([at[s] for s in cells["source"].to_pylist()], np.int64), coded.indices.to_numpy(zero_copy_only=False)
    n[where] = cells["n"].to_numpy()
    p = shares(n, total, kept)
    first = [k for k, g in enumerate(groups) if g["block"] == a]
    second = [k for k, g in enumerate(groups) if g["block"] == b]
    out = []
    for i in first:  # one row of the tile against a block of rows at a time
        js = [j for j in second if a != b or j > i]
        if js:
            value = apart(p[i], p[js]).sum(axis=1)
            out += [(lang, groups[i]["source"], "pair", groups[j]["source"], int(v)) for j, v in zip(js, value, strict=True)]
    if a == b and terms:
        of_lang = np.zeros(len(terms), np.int64)
        of_lang[where[1]] = cells["of_lang"].to_numpy()
        q = shares(of_lang, np.int64(whole), kept)
        f, told = apart(p, q), [t.encode("utf-8", "surrogatepass") for t in terms]
        for i in first:
            ok = np.flatnonzero((n[i] > 0) & (p[i] > q))
            out += [(lang, groups[i]["source"], "term", terms[t], int(f[i, t])) for t in heapq.nsmallest(best, ok, key=lambda t: (-f[i, t], told[t]))]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_docs: int = 10, best: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: 'pair' rows for all other sources of the language, 'term' rows for the best terms."""
    rows = documents(docs, text, lang, source)
    cells = settle(counts(rows).where(F.col("docs") >= least_docs).drop("docs"))
    groups = rows.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    terms = cells.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("of_lang").alias("whole"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(langs, "lang", "left").fillna(0, ["kept", "whole"])
    langs = settle(langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("lang", "salt", "kept", "whole", F.ceil(F.col("groups") / GROUPS).cast("int").alias("sides"), F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int").alias("parts")))
    block = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("block")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part")
    salted = lambda df, name: df.withColumn("salt", F.pmod(F.xxhash64(name, F.lit(1)), F.lit(SALTS)).cast("int"))
    heads = salted(groups, "source").join(langs, ["lang", "salt"]).select("lang", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "source", block, "sides", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("of_lang"), "total", "kept", "whole")
    zero = F.lit(0).cast("long")
    total_of = Window.partitionBy("lang", "term")
    body = salted(cells.withColumn("of_lang", F.sum("n").over(total_of)), "term").join(langs.select("lang", "salt", "sides", "parts"), ["lang", "salt"])
    body = body.select("lang", part, "source", block, "sides", "term", "n", "of_lang", zero.alias("total"), zero.alias("kept"), zero.alias("whole"))
    # each block of sources meets every block, the lower one first
    pairs = F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    dealt = heads.unionAll(body).select("*", F.explode(pairs).alias("p")).select("lang", "part", "p.a", "p.b", "source", "block", "term", "n", "of_lang", "total", "kept", "whole")
    tiles = settle(dealt.groupBy("lang", "part", "a", "b").applyInArrow(lambda key, table: _tile(key, table, best), "lang string, source string, part string, item string, value long").where("source is not null"))
    sums = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pair = sums.select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pair).unionByName(ranked(tiles.where("part = 'term'")).where(F.col("rank") <= best))
