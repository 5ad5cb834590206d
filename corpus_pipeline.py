"""A corpus pipeline of the training-data operators: each stage works on all that the one before it kept.

All stages but the last return the columns of ``documents``; each result is written as Parquet and reread as the next
stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigstab.llm import mixing, packing, pii, rules, simhash_tables
from sigstab.llm.common import ensure_checkpoint_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the standard policy."""
    return rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share 80 % of their five-word shingles, directly or by others."""
    return simhash_tables.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each copy."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins and texts."""
    return packing.pack_documents(docs, with_text=True)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can't express SimHash components, the trained span scores or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; the stages' tables lie in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
