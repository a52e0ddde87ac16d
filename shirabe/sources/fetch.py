"""Landed fetches: one row for each page, error pages left aside, bodies decoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.config import SETTINGS

#: Columns of a landed fetch.
FETCH_LOG = "audit_id string, seq int, url string, final_url string, status int, elapsed double, content_type string, redirect_chain array<string>, body binary, error string"


def decode(body: bytes, content_type: str) -> str:
    """Text of a body: the header's charset, else a meta tag's in the first 4096 bytes, else UTF-8;
    what isn't UTF-8 is tried as Shift_JIS and EUC-JP."""
    import re

    body = body[: SETTINGS.body_bytes]
    found = re.search(r"charset=[\"']?([A-Za-z0-9_-]+)", content_type or "", re.IGNORECASE)
    found = found or re.search(r"charset=[\"']?([A-Za-z0-9_-]+)", body[:4096].decode("latin-1"), re.IGNORECASE)
    names = [found[1]] if found else []
    for name in [*names, "utf-8", "cp932", "euc_jp"]:
        try:
            return body.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", "replace")


def landed_pages(fetches: DataFrame) -> DataFrame:
    """audit_id, seq, url, html, status, elapsed and chain of the HTML pages without an error."""
    rows = fetches.filter((F.coalesce("error", F.lit("")) == "") & F.lower(F.coalesce("content_type", F.lit(""))).contains("html"))
    rows = rows.select("audit_id", "seq", F.coalesce("final_url", "url").alias("url"), "status", "elapsed", F.coalesce("redirect_chain", F.array().cast("array<string>")).alias("chain"), "content_type", "body")
    names = ["audit_id", "seq", "url", "status", "elapsed", "chain", "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [decode(b or b"", t or "") for t, b in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(html, pa.string())], names)

    return rows.mapInArrow(run, "audit_id string, seq int, url string, status int, elapsed double, chain array<string>, html string")


def failed_audits(fetches: DataFrame) -> DataFrame:
    """Audits of which every page failed: they have an error and no score."""
    return fetches.groupBy("audit_id").agg(F.bool_and(F.coalesce("error", F.lit("")) != "").alias("failed"), F.count("*").alias("page_count"))
