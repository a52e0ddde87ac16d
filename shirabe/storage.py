"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Narrow rows up to which a counted table is broadcast; about 4 MB.
MOST_BROADCAST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one that all sessions of
    the application use, in local mode only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"shirabe-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors, and lets
    later reads pick columns. Adaptive execution joins small partitions into fewer files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again (others are left alone)."""
    for df in tables:
        if path := df.__dict__.pop("_stored", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: Sequence[Column], name: str, number: str = "number") -> DataFrame:
    """df, written in order, with each row's number from 0: one range shuffle, and the counts of its
    partitions (a row each) before them. No task holds more than its partition."""
    at = unused(("at_",), df.columns)["at_"]
    rows = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    parts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright(at, 33).alias("p")).count().collect())
    before, starts = 0, []
    for p, n in parts:
        starts.append((p, before))
        before += n
    # As many rows as partitions of the shuffle, whatever the input.
    first = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "p_ bigint, first_ bigint"))
    rows = rows.join(first, F.shiftright(at, 33) == F.col("p_")).withColumn(number, F.col("first_") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.drop("p_", "first_", at)


def numbered_within(df: DataFrame, key: str, order: Sequence[Column], name: str, number: str = "number") -> DataFrame:
    """df, a stored table, with each row's number from 0 within its key. Up to MOST_BROADCAST rows in all, a window
    finds it. More are written again in order of key and order: one range shuffle, and a count for each key and
    partition, so a key with very many rows fills as many partitions as they need."""
    at, part = unused(("at_", "part_"), df.columns).values()
    if df.count() <= MOST_BROADCAST:
        return df.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)
    rows = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).withColumn(at, F.monotonically_increasing_id())
    rows = store(rows, name).withColumn(part, F.shiftright(at, 33))
    runs = rows.groupBy(F.col(key).alias("k_"), F.col(part).alias("p_")).agg(F.min(at).alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("k_").orderBy("p_").rowsBetween(Window.unboundedPreceding, -1))
    runs = store(runs.select("k_", "p_", (F.col("first_") - F.coalesce(before, F.lit(0))).alias("base_")), f"{name}-runs")
    found = rows.join(counted_small(runs)(runs), F.col(key).eqNullSafe(F.col("k_")) & (F.col(part) == F.col("p_")))
    return found.withColumn(number, F.col(at) - F.col("base_")).drop("k_", "p_", "base_", at, part)


def counted_small(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to join tables of as many narrow rows as df has: broadcast up to MOST_BROADCAST rows, else shuffled."""
    return F.broadcast if df.count() <= MOST_BROADCAST else (lambda other: other)


def unused(names: Iterable[str], columns: Sequence[str]) -> dict[str, str]:
    """For each name one that no column bears (regardless of case): itself, or with marks behind it."""
    taken, out = {c.lower() for c in columns}, {}
    for name in names:
        found = name
        while found.lower() in taken:
            found += "_"
        taken.add(found.lower())
        out[name] = found
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
