"""Audits as JSON documents, a file for each: saved with retention, listed, loaded, and what can't be read reported.

A file is named audit-<id>.json, and an id begins with its time, so names are in order of time. Tasks write and remove
files through the file system of the folder's address; a file is written aside and moved, so a lost task
leaves none half written. Only the newest `kept` documents of a batch are written at all, as the others would go at
once. Listing reads the newest names alone; a file that is no document keeps its place and says so.

Ids of another form are refused on saving and find nothing on loading; a repeated id is one file, whichever row comes
last; an empty batch writes nothing, an empty or missing folder lists nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.config import SETTINGS
from shirabe.operators.store import AUDIT_ID

CORRUPT = "_corrupt"


def _place(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names of a folder's documents, the newest first. Retention bounds them by `kept` and one batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted((n for n in found if n.startswith("audit-") and n.endswith(".json")), reverse=True)


def save(documents: DataFrame, path: str, kept: int = SETTINGS.documents_kept, body: str | None = None) -> None:
    """Write documents (id and more) and remove all but the newest `kept` of the folder. body: a column that has the
    document's text; without it, the row's other columns are the document."""
    spark = documents.sparkSession
    text = F.col(body) if body else F.to_json(F.struct(*[c for c in documents.columns if c != "id"]))
    named = F.when(F.col("id").rlike(AUDIT_ID), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no document id: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    rows = documents.select(named.alias("id"), text.alias("body")).orderBy(F.col("id").desc()).limit(kept)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        for batch in batches:
            system.create_dir(folder, recursive=True)
            for id_, text_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                aside = f"{folder}/_{id_}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write((text_ or "").encode())
                system.move(aside, f"{folder}/audit-{id_}.json")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    old = _names(spark, path)[kept:]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _place(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if system.get_file_info(f"{folder}/{name}").is_file:  # a repeated task finds it gone
                    system.delete_file(f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    if old:
        spark.createDataFrame([(n,) for n in old], "name string").mapInArrow(remove, "n bigint").agg(F.sum("n")).collect()


def _read(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", True).json(files)
    id_ = F.substring(F.col("_metadata.file_name"), len("audit-") + 1, 24)
    # A file without a character has no row of its own; a list at the root has one for each element.
    return rows.select(id_.alias("id"), "*").dropDuplicates(["id"])


def listed(spark: SparkSession, path: str, schema: str, most: int = 20) -> DataFrame:
    """The newest documents of a folder: id, the columns of schema, and _corrupt (the text of what is no document, empty for
    an empty file; null for documents)."""
    names = _names(spark, path)[:most]
    every = spark.createDataFrame([(n[6:-5],) for n in names], "id string")
    if not names:
        return every.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (x.strip().split(" ", 1) for x in f"{schema}, {CORRUPT} string".split(","))])
    rows = _read(spark, [f"{path}/{n}" for n in names], schema)
    found = every.join(rows.withColumn("there", F.lit(True)), "id", "left")
    return found.withColumn(CORRUPT, F.when(F.col("there").isNull(), "").otherwise(F.col(CORRUPT))).drop("there")


def load(spark: SparkSession, path: str, id_: str, schema: str) -> DataFrame:
    """The document with an id, or none: of the folder only its file is read."""
    import re

    name = f"audit-{id_}.json"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not re.match(AUDIT_ID, id_) or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"id string, {schema}")
    return _read(spark, [f"{path}/{name}"], schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
