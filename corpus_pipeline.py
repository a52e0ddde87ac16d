"""A training-data pipeline over `documents`: quality rules, near-duplicate removal, redaction of
secrets, mixing of sources, and packing into sequences.

Every stage but the last returns the columns of documents. Each is written as Parquet and read
again as the input of the next.

* quality: documents that a rule rejects go.
* near_duplicates: of each group of near-duplicates (shingles of five words, similarity of 0.8 or
  more) the document with the smallest id stays.
* secrets: every reported span is replaced by a mark in the text; n_chars follows the text.
* mixing: documents are dropped, kept or repeated so that the sources meet their target weights;
  a repeated document is a repeated row.
* packing: the token pieces of all rows with their sequence and offset.

Python workers get texts in small batches, as executor and worker hold a batch several times over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.llm import credentials, mixing, neardup, packing, quality
from shirabe.llm.encoding import public_path
from shirabe.llm.storage import new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a batch for Python workers. Spark's own limit lets all texts of a split be one batch, which
#: executor and worker hold several times over, for each core.
BATCH_BYTES = 1 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Small batches for Python workers from here on; rows don't depend on it. `run` puts the setting back."""
    spark.conf.set(_BYTES, str(BATCH_BYTES))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.keep_first(docs, shingle=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return credentials.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.repeat(docs, weights=(1, 2, 3), cap=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_digests(docs, public_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing and packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BYTES)
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BYTES, before)
    return docs
