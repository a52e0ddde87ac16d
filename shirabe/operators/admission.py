"""Admission of requests under monthly quotas, request by request.

A request that starts while its owner has used up the month's quota is refused. Usage is recorded when a request
ends well: one that fails, or is refused, uses nothing, and one that is still running hasn't used anything yet. What is
recorded counts for the month it ends in; what is asked for is held against the month it starts in.

No fold over an owner's requests is needed. Within a month only the moment matters at which the quota is used up:
the limit-th smallest end of requests that ended well (of equal ends, that of the request that started first). Whether those after it were accepted or not doesn't move it, as a
refused request can't end before it started. So each (owner, kind, month) has one cutoff, found with a limit of
as many rows in every task, and a request is refused if it starts after its cutoff. Only a request that starts in one
month and ends in another can be refused in the first and must then not count in the second: those
few are settled by repeating the search until it doesn't change, at most once a month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.operators.store import is_admin
from shirabe.storage import counted_small
from shirabe.storage import store as keep

BY = ("owner", "kind", "month")


def month(at: Column) -> Column:
    return F.to_date(F.date_trunc("month", at))


def cutoffs(recorded: DataFrame, limits: dict[str, int]) -> DataFrame:
    """of_owner, of_kind, of_month and cutoff (end, start, id): what uses up the quota of recorded (owner, kind, month
    and these)."""
    rank = F.row_number().over(Window.partitionBy(*BY).orderBy("end", "start", "id"))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("kind"))
    rows = recorded.withColumn("rank", rank).filter(F.col("rank") <= max(limits.values())).filter(F.col("rank") == limit)
    return rows.select(*[F.col(c).alias(f"of_{c}") for c in BY], F.struct("end", "start", "id").alias("cutoff"))


def _held(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """rows (owner, kind, start) with the cutoff of the month they start in."""
    same = F.col("owner").eqNullSafe(F.col("of_owner")) & (F.col("kind") == F.col("of_kind")) & (month(F.col("start")) == F.col("of_month"))
    return rows.join(counted_small(cut)(cut), same, "left").drop("of_owner", "of_kind", "of_month")


def _after() -> Column:
    """A request comes after what was recorded at an earlier time, or at the same time for a request before it."""
    return F.col("cutoff") < F.struct(F.col("start").alias("end"), F.col("start"), F.col("id"))


def admit(requests: DataFrame, limits: dict[str, int], admins: Sequence[str] = ()) -> DataFrame:
    """requests (id, owner, kind, start, end: null if it failed, and more) with accepted.

    Kinds without a limit and admins are never refused; a limit of 0 refuses all. Null owners are one owner.
    Ids are unique, and order requests that start at the same time; a request that ends before it starts counts as
    ending when it starts. Requests without a start are refused."""
    free = ~F.col("kind").isin(*limits) | F.col("kind").isNull() | F.coalesce(is_admin(F.col("owner"), admins), F.lit(False))
    closed = F.col("kind").isin(*[k for k, n in limits.items() if n <= 0])
    open_ = {k: n for k, n in limits.items() if n > 0}
    accepted = F.when(F.col("start").isNull(), False).when(free, True).when(closed, False)
    if not open_:
        return requests.withColumn("accepted", accepted.otherwise(True))
    ended = requests.filter(~free & ~closed & F.col("start").isNotNull() & F.col("end").isNotNull())
    end = F.greatest("start", "end")
    ended = keep(ended.select("id", "owner", "kind", "start", end.alias("end"), month(end).alias("month")), "ended")
    over = F.col("month") != month(F.col("start"))
    across = keep(ended.filter(over), "across")
    refused, before = across.select("id").limit(0), (0, 0)
    while True:
        counts = ended.filter(~over).unionByName(across.join(counted_small(refused)(refused), "id", "left_anti"))
        cut = keep(cutoffs(counts, open_), "cutoffs")
        refused = keep(_held(across, cut).filter(_after()).select("id"), "refused")
        now = refused.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("id").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return _held(requests, cut).withColumn("accepted", accepted.otherwise(F.col("cutoff").isNull() | ~_after())).drop("cutoff")


def usage(admitted: DataFrame) -> DataFrame:
    """What admitted requests record: owner, kind and created_at of those that were accepted and ended well."""
    return admitted.filter(F.col("accepted") & F.col("end").isNotNull()).select("owner", "kind", F.greatest("start", "end").alias("created_at"))
