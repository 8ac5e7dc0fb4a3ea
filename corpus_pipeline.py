"""Cleaning a corpus in five stages; each takes (spark, docs, sf_dir), is written as Parquet and read by the next.

All stages find ``doc_id``, ``text`` and ``source`` by the exact name first, carry every other column along unread, maps and
names that clash with the stage's own too, and give an empty table for an empty one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbisight.llm import decontamination, near_copies, secret_scans, source_mixing, toxicity
from orbisight.llm._common import table
from orbisight.sources.lineage import shared_folder


#: Arrow batches of the stages hold this much text, unless the session says otherwise: rows wait in memory for each batch.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def bounded(spark: SparkSession) -> None:
    """Set the size of Arrow batches where the session leaves it open."""
    told = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in told:
            spark.conf.set(key, value)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null text counts as empty and stays unless empty texts are toxic; rows are judged one by one, so repeated rows share
    their fate; a null doc_id is never learned from; without labels of both kinds no row goes below a base rate of one half.
    """
    bounded(spark)
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by five-word shingles at similarity 0.8: one of the smallest doc_id.

    Null and empty texts are copies of one another; rows without a doc_id come last; repeated rows leave one; texts of any
    length are compared whole.
    """
    bounded(spark)
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows share their fate; an item without an id counts like others.
    """
    bounded(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars, where there is such a column, follows.

    A null text stays null and keeps its n_chars; no row goes or comes.
    """
    bounded(spark)
    return secret_scans.redact_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often as it is taken, numbered by ``repetition`` (by ``repetition_1`` where there is such a column).

    Null texts have size 0; null is a source of its own; repeated rows are dealt one by one.
    """
    return source_mixing.mixed(docs, weights=(5, 2, 1))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret_scans", redact_secrets), ("source_mixing", mix_sources)]

#: The stages learn, hash and walk trees; SQL can't express them.  Tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder."""
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = os.path.join(shared, f"pipeline-{uuid.uuid4().hex}", f"{k}-{name}.parquet")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
