"""Usage counted as it happens: a stateful stream into a keyed sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "id string, owner string, kind string, at timestamp"


def count_usage(spark: SparkSession, landing: str, sink: str, checkpoint: str, late: str = "3 days", files: int = 100) -> StreamingQuery:
    """Count events (EVENTS, as Parquet below landing) by owner, kind and day, each id once.

    Ids and counts are kept in the state store, spread by id and by key, until the watermark has passed them: an event that
    comes again within `late` counts once, one that comes later than that is dropped. Counts that change are
    written, whole, in a folder for each micro-batch; a batch that is run again overwrites its own, and `usage_counts`
    takes the newest of each key. A day is what the state of a window can be given up for; months are sums of days."""
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(landing)
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    counts = once.groupBy("owner", "kind", F.window("at", "1 day")).agg(F.count("*").alias("used"))
    rows = counts.select("owner", "kind", F.to_date("window.start").alias("day"), "used")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("month", F.date_format("day", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(f"{sink}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_counts(spark: SparkSession, sink: str, month: str | None = None) -> DataFrame:
    """owner, kind, month (first day) and used, from the newest count of each day; one month's folders only, if given."""
    rows = spark.read.schema("owner string, kind string, day date, used bigint, batch bigint, month string").parquet(sink)
    rows = rows if month is None else rows.filter(F.col("month") == month)
    days = rows.groupBy("owner", "kind", "day").agg(F.max_by("used", "batch").alias("used"))
    return days.groupBy("owner", "kind", F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.sum("used").alias("used"))


def compact(spark: SparkSession, sink: str, into: str) -> None:
    """The newest count of each day as one batch in a new sink, numbered as the last that it holds, so that the
    stream's later batches follow it."""
    rows = spark.read.schema("owner string, kind string, day date, used bigint, batch bigint, month string").parquet(sink)
    last = rows.agg(F.max("batch")).first()[0] or 0
    days = rows.groupBy("owner", "kind", "day", "month").agg(F.max_by("used", "batch").alias("used"))
    days.write.mode("overwrite").partitionBy("month").parquet(f"{into}/batch={last}")
