"""A corpus from documents to batches: quality rules, near-duplicates, repeated passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. Stages but the last return the columns of documents; the last adds the batch of each row to them.

Defined results: a null or empty text fails the quality rules; repeated rows are one document from the second stage on, which
keeps the one of least doc_id (null last), of equal ids that of least hash; rows without a doc_id stay documents of their own
in the later stages; texts of any length go whole; an empty table gives an empty result; other columns pass through, but for
those named as the last stage's own (n_tokens, bucket, bound, batch, slot, padding).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import packing, quality, secrets, session, simhash, substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps; rejected ones go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the one of least doc_id."""
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start earlier elsewhere; documents with nothing else go."""
    return substrings.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, with its bucket, batch and slot."""
    return packing.pack_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secret scan", secret_scan),
    ("length buckets", length_buckets),
]

#: Expectation-maximisation, components of near-duplicates and the forest are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with Parquet between them in the shared checkpoint folder; only the last stage's stays there."""
    place = f"{session.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            session.remove(spark, f"{place}/{k - 1}")
    return docs
