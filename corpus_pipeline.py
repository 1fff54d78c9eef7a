"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

quality    documents that the importance-resampling classifier rejects go
dedup      one document of each group of near-duplicates stays, that of the least doc_id
secrets    found secrets are masked in the text
mixing     documents are repeated or left out to meet the target weights of their sources
packing    word counts are packed into optimal length buckets and token-budget batches

All but the last return the columns of `documents`; packing returns one row a piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import minhash, mixing, packing, quality, secrets
from graphloom.llm.common import materialize, table

#: A stage can't be expressed in SQL (models, minima); tests hold the rows against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_mixed(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs)


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
