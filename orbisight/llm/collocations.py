"""Phrase collocations: exploded n-grams counted by hash aggregation, scored exactly, without what a longer phrase explains.

Texts become one row for each n-gram of 1 to ``max_n`` words that a chunk of text holds, with its count there; Spark adds
them up by (lang, phrase).  Level n only forms n-grams whose two (n - 1)-grams may be frequent: a Bloom filter of fixed
size tells which can't be.  What it lets through by mistake is counted like the rest, so no count depends on it; a phrase
that occurs ``least`` times has only parts that do.  The frequent phrases of all levels are one table: a join with it gives
the counts of both parts of every cut, DECIMAL arithmetic the score, an anti-join on one-word extensions removes what they
explain (a longer phrase that explains more passes on through the extensions between), and a window ranks each language.

Edge cases: null text is empty; null lang is ``und``, joined with a lang spelled so; repeated rows count as often as they
occur; a text of any length is read whole; ties in score and count go by UTF-8 order of the phrase; empty tables give an
empty result; other columns are ignored, also if their names clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from ._common import by_place, place, settle, _FOLD

#: Piece separators become one mark that no word holds, A-Z are lower-cased.
_PIECES = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256)).translate(_FOLD)
#: Bytes of text counted at once in a task.
CHUNK = 8 << 20
#: Bits of a level's filter, whatever the input's size; four of them for each frequent phrase.
FILTER_BITS = 1 << 26
#: Parts of a language that are ranked before it is, so that its last task reads ``top`` rows of each at most.
PARTS = 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[0]
    return (h ^ (h >> np.uint64(29))) * _MIX[1]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def phrase_hashes(seed: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A hash for each row of word hashes, with the hash of its language as the seed."""
    for word in words:
        seed = _scrambled(seed + word)
    return seed


def filter_places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The four bits of each hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(4)]


def _may_be(seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for at in filter_places(h, 64 * len(seen)):
        found &= (seen[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return found


def _counted(lang: bytes, texts: list[bytes], n: int, seen: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The n-grams of some texts of one language that the filter lets through, and how often each occurs; for n = 1 also ''."""
    tokens = b" . ".join(t.translate(_PIECES).replace(b".", b" . ") for t in texts).split()
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    del tokens
    mark = np.flatnonzero(np.asarray(pc.equal(words, b"."))) if len(words) else np.zeros(0, np.int64)
    word = code != (mark[0] if len(mark) else -1)
    places = max(len(code) - n + 1, 0)
    whole = np.ones(places, bool)
    for k in range(n):
        whole &= word[k : k + places]
    if seen is not None and places:
        hashes = _word_hashes(words.to_pylist())[code]
        many = places + 1
        parts = _may_be(seen, phrase_hashes(_word_hashes([lang]).repeat(many), [hashes[k : k + many] for k in range(n - 1)]))
        whole &= parts[:places] & parts[1 : places + 1]
    at = np.flatnonzero(whole)
    key = code[at]
    for k in range(1, n):
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) * len(words) + code[at + k]
    _, first, often = np.unique(key, return_index=True, return_counts=True)
    parts_of = [words.take(pa.array(code[at[first] + k])) for k in range(n)]
    phrases = parts_of[0] if n == 1 else pc.binary_join_element_wise(*parts_of, pa.scalar(b" ", pa.large_binary()))
    if n == 1:
        phrases, often = pa.concat_arrays([phrases, pa.array([b""], pa.large_binary())]), np.append(often, word.sum())
    return phrases, often


def _chunks(langs: list, texts: pa.Array) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts by language, ``CHUNK`` bytes or one text at a time."""
    held: dict[bytes, list[bytes]] = {}
    size = 0
    for lang, text in zip(langs, texts, strict=True):
        t = text.as_buffer()
        if size and size + t.size > CHUNK:
            yield from held.items()
            held, size = {}, 0
        held.setdefault(lang, []).append(t.to_pybytes())
        size += t.size
    yield from held.items()


def _level(rows: DataFrame, n: int, seen) -> DataFrame:
    """lang, phrase, f of the n-grams of (lang, text); n-grams that the filter rules out are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).cast(pa.binary()).to_pylist()
            for lang, texts in _chunks(langs, batch.column(1).cast(pa.binary())):
                phrases, often = _counted(lang, texts, n, None if seen is None else seen.value)
                for at in range(0, len(phrases), 200_000):
                    part = phrases.slice(at, 200_000).cast(pa.binary()).view(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode("utf-8", "replace")] * len(part), pa.string()), part, pa.array(often[at : at + 200_000], pa.int64())], ["lang", "phrase", "f"])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(frequent: DataFrame, n: int):
    """The broadcast filter of frequent n-grams: at most ``FILTER_BITS`` bits reach the driver, however many there are."""
    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            langs, phrases = (c.cast(pa.binary()).to_pylist() for c in batch.columns)
            words = _word_hashes(b" ".join(phrases).split(b" ")).reshape(-1, n)
            at = np.concatenate(filter_places(phrase_hashes(_word_hashes(langs), list(words.T)), size))
            slot, back = np.unique(at >> 6, return_inverse=True)
            told = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(told, back, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(told.view(np.int64))], ["slot", "bits"])

    made = frequent.select("lang", "phrase").mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    seen = np.zeros(size >> 6, np.uint64)
    seen[made.column("slot").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(seen)


def _exact(name: str):
    return F.col(name).cast(DecimalType(15, 0))


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, explained: int = 50, top: int | None = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to ``max_n`` words that occur ``least`` times, best first.

    A phrase goes if one longer by a word occurs in ``explained`` hundredths of its places or more.  ``top`` is the length
    of each language's list; None ranks all.
    """
    spark = docs.sparkSession
    rows = by_place(docs).select(F.coalesce(F.col(place(docs, lang)).cast("string"), F.lit("und")).alias("lang"), F.col(place(docs, text)).cast("string").alias("text")).where("text is not null")
    frequent, seen = None, None
    for n in range(1, max_n + 1):
        counted = settle(_level(rows, n, seen).where((F.col("f") >= least) | (F.col("phrase") == "")).withColumn("words", F.lit(n)))
        frequent = counted if frequent is None else frequent.unionAll(counted)
        if n < max_n:
            seen = _filter(counted.where("phrase <> ''"), n)
    totals = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = frequent.where("phrase <> ''")
    split = F.split("phrase", " ", -1)
    cands = phrases.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), split.alias("w"))
    cuts = cands.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("a_", _exact("a")).withColumn("l_", _exact("l")).withColumn("r_", _exact("r"))
    cuts = cuts.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * a_ * a_ div (l_ * r_)").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = cands.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(F.array_join(F.slice("w", 2, F.size("w")), " "), F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    told = (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & (longer["longer"] * 100 >= scored["a"] * explained)
    kept = scored.join(longer, told, "left_anti").select("lang", "phrase", "a", "cut.*")
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    if top is not None:  # the best of a language are among the best of its parts
        kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", best("lang", "part")).where(F.col("rank") <= top).drop("part", "rank")
    ranked = kept.withColumn("rank", best("lang"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
