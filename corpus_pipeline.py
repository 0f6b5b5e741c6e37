"""A corpus pipeline: reject toxic documents, drop copies and near copies, hide secrets, pack what is left.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. A null or empty text,
a repeated row or an extra column is handled as its operator says; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import exact, packing, secrets, simhash, toxicity
from rillflow.llm.common import keep, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, learnt from ``labels`` outside the held-out fold, rejects."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text."""
    return exact.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints."""
    return simhash.keep_one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces the secrets in its text."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens; one row per piece."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("secret_scan", hide_secrets), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier, XXH64 and BPE are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None
