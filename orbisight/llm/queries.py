"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat_format, collocations, decontamination, divergence, html_extraction, lm_scoring, nearest_neighbours, pii, secret_scans, simhash, source_mixing, token_counts, toxicity
from ._common import table


def tokenizer_path() -> str:
    """The public byte-level BPE file; another can be named by TOKENIZER_FILE."""
    if path := os.environ.get("TOKENIZER_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scans.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_told(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1)).select("doc_id", "size", "source_size", "target", "taken")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_told(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"), "sanitised")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20, factor=1.1)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, best=10)


#: A conversation that says marks of the usual templates.
SPOKEN = r"\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPOKEN).alias("text"))
    made = chat_format.format_conversations(rows.unionByName(own))
    read = made.select("conv_id", "formatted", chat_format.turns_of(F.col("formatted")).alias("turns"), F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss")), "").alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    size = lambda c: F.length(c).cast("long")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), size("learned").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), size("formatted").alias("formatted_chars"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_n=3, least=10, explained=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_benchmark_decontamination, op3_lm_scoring, op4_token_counts, op5_secret_scans, op6_source_mixing, op7_personal_data, op8_nearest_neighbours, op9_simhash, op10_toxicity, op11_source_divergence, op12_chat_formatting, op13_collocations)
    return {f.__name__: f for f in own}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(n.c, 0)::HUGEINT AS c, kept.whole::HUGEINT AS whole FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
sums AS (SELECT *, count(*) OVER s AS v, sum(c) OVER s AS total, sum(whole) OVER s AS total_of_lang FROM cell WINDOW s AS (PARTITION BY lang, source)),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (total + 2 * v) AS p, 1 + (1000000000 * (whole + 2)) // (total_of_lang + 2 * v) AS q FROM sums),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP12_SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{SPOKEN}' FROM range(2) t(k)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)(/?turn|next)', '<\\\1\2', 'g')) AS size, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(size + CASE WHEN opens THEN length('<turn ' || role || '></turn>') + 1 ELSE length('<next>') END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM p, range(1, 4) t(n) WHERE len(w) >= n),
f AS (SELECT lang, n AS words, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
cut AS (SELECT lang, words, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM cand, range(1, 3) t(k) WHERE k < words),
scored AS (SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f)) AS score FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = head AND x.words = k JOIN f y ON y.lang = c.lang AND y.phrase = rest AND y.words = c.words - k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS part FROM cand, range(1, 3) t(i) WHERE words = 3) o WHERE b.words = 2 AND o.lang = b.lang AND o.part = b.phrase AND 100 * o.a >= 50 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_collocations": OP13_SQL}
