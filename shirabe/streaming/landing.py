"""Audits of pages as they land: each micro-batch is audited by the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shirabe.operators import rules
from shirabe.sources import fetch, html


def audit_landing(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Findings of every fetch that lands as Parquet below `landing`, one folder below `out` for each
    micro-batch; a batch that is run again overwrites its own folder, so each lands once."""

    def audit(batch: DataFrame, number: int) -> None:
        facts = html.rule_facts(html.extract(fetch.landed_pages(batch)))
        rules.findings(facts, ["audit_id", "seq", "url"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(fetch.FETCH_LOG).parquet(landing)
    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
