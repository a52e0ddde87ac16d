"""Tables in the shared folder, and which of them are small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.storage import discard, new_path, numbered, numbered_within, shared_dir, store, table, unused

__all__ = ["discard", "new_path", "numbered", "numbered_within", "shared_dir", "small", "store", "table", "unused"]

#: Narrow rows (two numbers) up to which a counted table is broadcast; about 4 MB.
MOST_BROADCAST = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where its count of narrow rows is low; else joins shuffle it."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df
