"""Mixing sources to target weights by capped water-filling.

Every source wants its weight's share of all words.  Sources whose target exceeds ``most_epochs`` times their size are
clamped there, and the excess is reshared among the others by weight until no target is above its cap.  A source with
target / size = e then takes every document floor(e) times, and once more the documents that come first in a seeded
order, up to the one that brings the words taken nearest to the target.

The order is a hash of (seed, doc_id, text), then one of all other columns.  Where a source's order is cut is found eight
bits at a time: words are added up by (source, next eight bits) inside the bin that holds the cut so far, at most 256 sums
a source and level, so no source is ever gathered or sorted in one task.  Rows that are equal throughout share their place;
if the cut falls among them, as many of them as come nearest to the target are taken once more: they are counted by
partial sums and written out again in pieces.  Water-filling runs on the sums by source.

Edge cases: null texts have size 0 and are taken floor(e) times; null is a source of its own, last in order; a source
without words has target 0; repeated rows are dealt one by one; an empty table gives an empty result; other columns, maps
and names that clash too, are carried along by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import by_place, place, settle

#: Sources up to this number are joined by broadcast; more are joined by shuffle, whose skewed partitions are split at run time.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null has none: each becomes one letter, then the blanks go; no list is made."""
    letters = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), " \t\n\x0b\f\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(source).cast("string")))


def _order(seed: int, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast up to a checked number of rows; beyond it the shuffle join's skewed keys are split at run time."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def ranked(sources: DataFrame) -> DataFrame:
    """(k, rank) by code point, null last; a sort by ranges, and each range's rows counted before it, never all in one task.

    One count for each range is added up in one task; there are as many as shuffle partitions, at most.
    """
    at = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    placed = settle(sources.orderBy(F.col("source").asc_nulls_last()).select("k", at.alias("at")))
    part = F.shiftright("at", 33).alias("part")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("ahead"))
    return placed.select("k", part, "at").join(ahead, "part").select("k", (F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def water_fill(sources: DataFrame, most_epochs: float = 3.0) -> DataFrame:
    """Rows of (.., size, weight) with ``target``: clamp, reshare by weight, repeat until none is above its cap.

    Only sums reach the driver, three in each round.
    """
    caps = settle(sources.withColumn("cap", F.col("size") * F.lit(float(most_epochs))))
    total, level = float(caps.agg(F.sum("size")).first()[0] or 0), 0.0
    while True:
        clamped = F.col("cap") < F.col("weight") * F.lit(level)
        held, weight = caps.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(~clamped, F.col("weight")).otherwise(0.0))).first()
        following = (total - held) / weight if weight else level
        if following <= level:
            return caps.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")
        level = following


def plan(sizes: DataFrame, weights: Sequence[float], most_epochs: float = 3.0) -> DataFrame:
    """k, source_size, target, whole (repetitions of each document), cut_u, cut_v (the place up to which there is one more)
    and some (how many of the rows at just that place get it; null if all).

    ``sizes`` has (k, source, size, u, v) for every document; u and v are the places in the order.
    """
    sources = settle(sizes.groupBy("k").agg(F.sum("size").alias("size"), F.min("source").alias("source")))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    filled = water_fill(sources.join(ranked(sources), "k").withColumn("weight", cycle), most_epochs)
    filled = filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size") + 1e-12)).otherwise(0))
    filled = settle(filled.select("k", "size", "target", "whole", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("size")).alias("more")))
    zero = F.lit(0).cast("long")
    state = settle(filled.where("more > 0").select("k", "more", zero.alias("bin"), zero.alias("before"), zero.alias("at_u")))
    cuts = None
    shifts = [63, 55, 47, 39, 31, 23, 15, 7, 0]
    for word, above, shift in [(w, *s) for w in "uv" for s in zip(shifts, shifts[1:], strict=False)]:
        inside = sizes.join(_small(state), "k").where(F.shiftright(word, above) == F.col("bin"))
        if word == "v":
            inside = inside.where(F.col("u") == F.col("at_u"))
        ends = [f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("first", F.min), ("last", F.max))]
        sums = inside.groupBy("k", F.shiftright(word, shift).alias("at")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("each"), F.min("before").alias("before"), F.min("more").alias("more"), *ends)
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("k").orderBy("at"))
        state = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("more")).groupBy("k").agg(F.min_by(F.struct("*"), "at").alias("s"))
        state = settle(state.select("k", "s.more", F.col("s.at").alias("bin"), (F.col("s.upto") - F.col("s.words")).alias("before"), *[f"s.{c}" for c in ("rows", "each", "first_u", "last_u", "first_v", "last_v")]))
        one = (F.col("first_u") == F.col("last_u")) & (F.col("first_v") == F.col("last_v"))
        nearest = F.greatest(F.lit(0), F.least("rows", F.floor((F.col("more") - F.col("before")) / F.col("each") + 0.5)))  # of equal rows, which have words as the sum grows there
        found = state.where(one).select("k", F.col("first_u").alias("cut_u"), F.col("first_v").alias("cut_v"), F.when(nearest < F.col("rows"), nearest).alias("some"))
        cuts = found if cuts is None else cuts.unionByName(found)
        state = state.where(~one)
        onward = zero if (word, shift) == ("u", 0) else F.col("bin")  # all of one u: its v from the top
        state = state.select("k", "more", onward.alias("bin"), "before", F.col("first_u").alias("at_u"))
        if state.isEmpty():
            break
    none = F.lit(-1).cast("long")
    return settle(filled.join(cuts, "k", "left").select("k", F.col("size").alias("source_size"), "target", F.col("whole").cast("long").alias("whole"), F.coalesce("cut_u", none).alias("cut_u"), F.coalesce("cut_v", none).alias("cut_v"), F.col("some").cast("long").alias("some")))


def dealt(rows: DataFrame, planned: DataFrame, kept: list[str]) -> DataFrame:
    """``rows`` (k, u, v and the columns kept) with source_size, target and repeats, the times that each is taken.

    Only rows at a cut that takes some of them are counted: they are equal, so one stands for all, and their repeats are
    numbered off in pieces of 1,000.
    """
    joined = rows.join(_small(planned), "k")
    at_cut = (F.col("u") == F.col("cut_u")) & (F.col("v") == F.col("cut_v"))
    before = (F.col("u") < F.col("cut_u")) | (F.col("u") == F.col("cut_u")) & (F.col("v") <= F.col("cut_v"))
    split = at_cut & F.col("some").isNotNull()
    whole = joined.where(~split).select(*kept, "source_size", "target", (F.col("whole") + before.cast("long")).alias("repeats"))
    groups = joined.where(split).groupBy("k", "u", "v").agg(*[F.any_value(c).alias(c) for c in [*kept, "source_size", "target", "whole", "some"]], F.count(F.lit(1)).alias("rows"))
    pieces = groups.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 1000)))).repartition("k", "piece")
    numbered = pieces.withColumn("number", F.explode(F.sequence(F.col("piece") * 1000 + 1, F.least(F.col("rows"), F.col("piece") * 1000 + 1000))))
    return whole.unionByName(numbered.select(*kept, "source_size", "target", (F.col("whole") + (F.col("number") <= F.col("some")).cast("long")).alias("repeats")))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target (of its source), repeats and taken (size times repeats) of every row."""
    own = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.col(place(docs, source)).cast("string").alias("source"), F.col(place(docs, text)).cast("string").alias("text"))
    sizes = settle(own.select("doc_id", _key("source").alias("k"), "source", word_count(F.col("text")).alias("size"), _order(seed, F.col("doc_id").cast("string"), F.col("text")).alias("u"), F.lit(0).cast("long").alias("v")))
    return dealt(sizes, plan(sizes, weights, most_epochs), ["doc_id", "size"]).select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, numbered from 1 in a column ``repetition``.

    Where there is such a column already, the number's name gets a number too.
    """
    own, at, body, origin = by_place(docs), place(docs, doc_id), place(docs, text), place(docs, source)
    others = [c for c in own.columns if c not in (at, body)]
    told = F.to_json(F.struct(*others)) if others else F.lit("")
    order = [_order(seed, F.col(at).cast("string"), F.col(body).cast("string")).alias("u"), _order(seed, told).alias("v")]
    key = F.when(F.col(origin).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(origin).cast("string"))).alias("k")
    sizes = settle(own.select(key, F.col(origin).cast("string").alias("source"), word_count(F.col(body).cast("string")).alias("size"), *order))
    taken = dealt(own.select(F.struct(*own.columns).alias("row"), key, *order), plan(sizes, weights, most_epochs), ["row"])
    lower, name, k = {c.lower() for c in docs.columns}, "repetition", 0
    while name in lower:
        k += 1
        name = f"repetition_{k}"
    out = taken.where("repeats > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("again"))
    return out.toDF(*docs.columns, name)
