"""A corpus pipeline: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as
Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, secret_scan, simhash, toxicity
from tessera.llm.common import read, shared_folder
from tessera.operators.lineage import remove


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic."""
    return toxicity.drop_toxic(docs, toxicity.low_quality_labels(read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-equal texts."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark, and n_chars counted again."""
    clean = secret_scan.redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write the mix's blocks of text to ``path``, or to a new shared folder; per document what the mix takes of it."""
    return mixing.written_mix(docs, path=path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages train a model, search a latent space and draw blocks; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result, and the mix, written to the shared folder and read again.

    What a stage has read is removed once its own result is written; the last two, which the result
    is made from, stay for the caller to remove.
    """
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir, f"{folder}/{name}")
