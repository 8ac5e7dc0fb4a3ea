"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal what they protect.

Everything runs as DataFrame and SQL functions.  Pattern matches are the protected entities.  From all words of the
documents that hold an entity e, corpus co-occurrence estimates how much a term tells about it: the pointwise mutual
information PMI(e; t) = ln(n(e, t) N / (n(e) (n(t) + ``smoothing``))), set against all there is to tell, the information
content ln(N / n(e)).  n counts distinct texts over the whole corpus, so copies of one text prove nothing.  A term discloses
the entity if their ratio reaches ``threshold`` and if what it leaves open, ln((n(t) + ``smoothing``) / n(e, t)), is at most
ln(1 / ``certainty``), a bound that doesn't depend on the size of the corpus: at 0.6 two texts out of two suffice, and one never
does, as every word of a text occurs with all of its entities.  The term is a span throughout every document
that holds the entity, and ``sanitised`` removes it.  Every entity is judged; the smoothing is
what low counts cost.  Entities that occur in just the same texts have the same counts with every term, so they are judged
as one: a text with very many addresses is no reason to pair each of them with each of its words.

The patterns are possessive and anchored to the end of the last match or the start of a run, which finds the same
matches as the plain ones and takes time in proportion to the text.  Positions come from the lengths of what lies
between the matches, added up in runs of 256 whose results are joined, so that long lists are not copied at every step.

Edge cases: null counts as empty (no spans); rows with a null doc_id are scanned like others; repeated rows repeat;
empty tables give empty results; other columns are ignored, also if their names clash.  Positions are code points, ends
exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import by_place, place, settle

KINDS = ("email", "ip", "card", "phone")
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), "card": lambda t: F.rlike(t, F.lit("[0-9](?:[ -]?[0-9]){12}")), "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]"))}
_TERM = r"\p{L}{3,}+"
_IP = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _luhn(digits: Column) -> Column:
    """Luhn's sum is a multiple of ten; every second digit from the right is doubled."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    value = lambda x, k: F.when(k % 2 == 0, x.cast("int")).otherwise(F.element_at(doubled, x.cast("int") + 1))
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(match, F.lit(_IP))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], run: int = 256) -> Column:
    """What ``step(at, item) -> (at, made)`` makes of the items in order, ``at`` beginning at 0; null is left out.

    Runs of items are folded on their own and then joined, so that n items copy some n * run, not n * n, elements.
    """
    none = F.from_json(F.lit("[]"), f"array<{kind}>")
    pair = lambda at, made: F.struct(at.alias("at"), made.alias("made"))

    def one(seen: Column, item: Column) -> Column:
        at, made = step(seen["at"], item)
        return pair(at, F.when(made.isNull(), seen["made"]).otherwise(F.concat(seen["made"], F.array(made))))

    def some(seen: Column, items: Column) -> Column:
        inner = F.aggregate(items, pair(seen["at"], none), one)
        return F.transform(F.array(inner), lambda x: pair(x["at"], F.concat(seen["made"], x["made"])))[0]

    starts = lambda all_: F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / run).cast("int"))
    runs = lambda all_: F.when(F.size(all_) > run, F.transform(starts(all_), lambda k: F.slice(all_, k * run + 1, F.lit(run)))).otherwise(F.array(all_))
    return F.transform(F.array(items), lambda all_: F.aggregate(runs(all_), pair(F.lit(0), none), some)["made"])[0]


def located(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as (kind, start, end, value), by what lies between them."""
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("value"))
        return end, F.when(x["match"].isNotNull(), span)

    return running(steps, _SPAN, step)


def base_spans(text: Column) -> Column:
    """Pattern matches that hold, by kind and then start."""
    none = F.from_json(F.lit("[]"), f"array<{_SPAN}>")

    def of(kind: str) -> Column:
        return F.when(_NEEDS[kind](text), F.filter(located(text, PATTERNS[kind], kind), lambda x: _holds(kind, x["value"]))).otherwise(none)

    return F.concat(*map(of, KINDS))


def _words(held: DataFrame) -> DataFrame:
    """key, term, start and end of every term in (key, text); positions are running sums over what lies between."""
    steps = F.arrays_zip(F.split("text", _TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)).alias("match"))
    each = held.select("key", F.posexplode(steps).alias("at", "x")).select("key", "at", "x.*")
    size = F.length("match")
    end = F.sum(F.length("gap") + F.coalesce(size, F.lit(0))).over(Window.partitionBy("key").orderBy("at"))
    return each.select("key", F.lower("match").alias("term"), (end - size).cast("int").alias("start"), end.cast("int").alias("end")).where("term is not null")


def free_terms(found: DataFrame, held: DataFrame) -> DataFrame:
    """The terms (key, term, start, end) that touch no span of (key, spans), by one pass over both in order of their places."""
    base = held.join(found.select("key").distinct(), "key", "left_semi").select("key", F.lit(None).cast("string").alias("term"), F.explode("spans").alias("s")).select("key", "term", "s.start", "s.end")
    along = Window.partitionBy("key").orderBy("start", "end", "term")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    both = found.select("key", "term", "start", "end").unionByName(base)
    both = both.withColumn("past", F.max(F.when(F.col("term").isNull(), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("term").isNull(), F.col("start"))).over(after))
    return both.where(F.col("term").isNotNull() & (F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))).select("key", "term", "start", "end")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", smoothing: float = 1.0, threshold: float = 0.5, certainty: float = 0.6) -> DataFrame:
    """doc_id, spans (kind, start, end, value: base spans by kind and start, then disclosing terms) and sanitised of every row.

    ``sanitised`` is the text with entities generalised to their kind and disclosing terms removed; null if nothing was found.
    """
    rows = by_place(docs).select(F.col(place(docs, doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(place(docs, text)).cast("string"), F.lit("")).alias("text"))
    seen = rows.select("doc_id", "text", F.xxhash64("text").alias("key"), base_spans(F.col("text")).alias("spans"))
    marks = settle(seen.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")))

    total = float(marks.select("key").distinct().count())
    held = settle(marks.where(F.size("spans") > 0).groupBy("key").agg(F.min("text").alias("text"), F.any_value("spans").alias("spans")))
    names = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    entities = held.select("key", F.explode(names).alias("entity"))
    where = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"in_{k}") for k in range(2)]
    known = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *where)
    alike = ["n_e", "in_0", "in_1"]
    judged = settle(entities.join(known, "entity").where(F.col("n_e") < total).select("key", *alike).distinct())
    if judged.isEmpty():
        return marks.select("doc_id", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))
    split = F.explode(F.filter(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_TERM), F.lit(0)), F.lower)), lambda t: t != "")).alias("term")
    texts = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))
    counts = texts.select(split).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    # the ratio reaches its threshold if n_et / (n_t + smoothing) >= (n_e / N) ** (1 - threshold); as n_et <= n_t, n_e, frequent terms can't
    bar = (F.col("n_t") + smoothing) * F.greatest(F.lit(certainty), F.pow(F.col("n_e") / total, F.lit(1 - threshold))) - 1e-9
    most = held.select("key", split).join(counts, "term")
    told = settle(judged.join(most, "key").where(F.least("n_e", "n_t") >= bar))
    disclosing = told.groupBy(*alike, "term", "n_t").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= bar).select(*alike, "term")
    wanted = told.select("key", *alike, "term").join(disclosing, [*alike, "term"]).select("key", "term").distinct()
    found = free_terms(_words(held.select("key", "text")).join(wanted, ["key", "term"]), held)
    added = found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value")))).alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))
    out = marks.join(added, "key", "left").select("doc_id", "text", spans.alias("spans"))
    return out.select("doc_id", "spans", sanitised(F.col("text"), F.col("spans")).alias("sanitised"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities generalised to their kind and disclosing terms removed; spans that overlap go as one, by the
    kind of the first.  Null without spans.  Pieces are cut from UTF-32, where a code point's place needs no search."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    ends = F.array_append(order, F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("kind")))

    def step(wide: Column) -> Callable[[Column, Column], tuple[Column, Column]]:
        def cut(at: Column, s: Column) -> tuple[Column, Column]:
            between = F.decode(F.substring(wide, at * 4 + 1, (s["start"] - at) * 4), "UTF-32")
            mark = F.when(s["kind"].isin("term", ""), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.concat(between, mark))

        return cut

    wide = F.encode(text, "UTF-32")
    pieces = F.transform(F.array(F.struct(wide.alias("wide"), ends.alias("ends"))), lambda x: running(x["ends"], "string", step(x["wide"])))[0]
    return F.when(F.size(spans) > 0, F.array_join(pieces, ""))
