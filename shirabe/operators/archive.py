"""The store: tables in partitions by period and slot, appended to, read by partition, and really deleted from.

Ids are 16 hexadecimal digits, of which the first ones name a slot: as many as a store's `digits`. Its period is the month
unless it is told another format of dates; larger stores take more slots, smaller ones fewer partitions. A site's id begins with any; an audit's
begins with its site's, and findings, statuses and advice lie in the period and slot of their audit. So an id
alone tells the one slot that a point read opens, all rows of a site lie in its slot, and what is joined by
audit is joined by partition: Spark prunes partitions by the constant slot, and by those that the other side of
a join turns out to have.

Rows are never updated in place; a status is the newest of its rows. Deleting sites rewrites only partitions that hold
rows of theirs (dynamic overwrite; each is swapped when its job commits) and removes those that nothing is left in.
Children go before audits and audits before sites, so a deletion that is cut off can be repeated.

Null or malformed ids, children without an audit and audits that don't begin with their site's slot are refused
with an error when they are appended. Reading a table that nothing was appended to gives no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.storage import counted_small
from shirabe.storage import store as keep

PERIOD, SLOT = "period", "slot"
#: Fixed value: the form of an id.
ID = r"\A[a-f0-9]{16}\z"

TABLES: dict[str, str] = {
    "sites": "id string, owner string, name string, url string, created_at timestamp",
    "audits": "id string, site_id string, owner string, created_at timestamp",
    "statuses": "audit_id string, status string, overall int, page_count int, categories string, counts string, error string, at timestamp",
    "findings": "audit_id string, seq int, rule_ord int, rule string, category string, severity string, url string, evidence string",
    "advice": "id string, audit_id string, owner string, provider string, model string, body string, created_at timestamp",
    "usage": "id string, owner string, kind string, created_at timestamp",
}
#: What a table is partitioned by, and the column whose first digits are its slot.
LAYOUT: dict[str, tuple[str, ...]] = {"sites": (SLOT,), "audits": (PERIOD, SLOT), "statuses": (PERIOD, SLOT), "findings": (PERIOD, SLOT), "advice": (PERIOD, SLOT), "usage": (PERIOD,)}
KEYS = {"sites": "id", "audits": "site_id", "statuses": "audit_id", "findings": "audit_id", "advice": "audit_id"}
CHILDREN = ("findings", "statuses", "advice")


def schema(kind: str) -> T.StructType:
    """A table's columns, and what it is partitioned by."""
    if kind not in TABLES:
        raise ValueError(f"no table {kind}")
    return T.StructType([*T.StructType.fromDDL(TABLES[kind]), *(T.StructField(c, T.StringType()) for c in LAYOUT[kind])])


@dataclass(frozen=True)
class Archive:
    """A store in a folder. digits: of an id, that name its slot (one gives 16 slots, two 256); period: the format of the
    dates that are kept together."""

    spark: SparkSession
    path: str
    period: str = "yyyy-MM"
    digits: int = 1

    def slot(self, id_: Column) -> Column:
        return F.substring(id_, 1, self.digits)

    def new_id(self, near: Column | None = None) -> Column:
        """A random id, in the slot of the one that it belongs to."""
        random = F.replace(F.uuid(), F.lit("-"), F.lit(""))
        return F.substring(random, 1, 16) if near is None else F.concat(self.slot(near), F.substring(random, 1, 16 - self.digits))

    def issued(self, number: Column, near: Column | None = None) -> Column:
        """An id for a number, the same each time: for rows that were numbered elsewhere."""
        head = F.substring(F.md5(number.cast("string").cast("binary")), 1, self.digits) if near is None else self.slot(near)
        return F.concat(head, F.lpad(F.lower(F.hex(number.cast("long"))), 16 - self.digits, "0"))

    def number_of(self, id_: Column) -> Column:
        """The number of an issued id."""
        return F.conv(F.substring(id_, self.digits + 1, 16), 16, 10).cast("long")

    def _files(self, place: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, place: str) -> bool:
        files, at = self._files(place)
        return files.exists(at)

    def read(self, kind: str) -> DataFrame:
        """A table with its partition columns."""
        own = schema(kind)
        return self.spark.read.schema(own).parquet(f"{self.path}/{kind}") if self._exists(kind) else self.spark.createDataFrame([], own)

    def append(self, rows: DataFrame, kind: str, /, **fixed: str) -> None:
        """Append rows to a table of the store, with a new id and the time where they have none. Columns that rows
        lack are null; `fixed` sets some."""
        own = schema(kind)
        for name, value in fixed.items():
            rows = rows.withColumn(name, F.lit(value))
        if "id" in own.names and "id" not in rows.columns:
            rows = rows.withColumn("id", self.new_id(F.col(KEYS[kind]) if KEYS.get(kind, "id") != "id" else None))
        if "created_at" in own.names and "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.date_trunc("second", F.current_timestamp()))
        if SLOT in own.names:
            key = F.col(KEYS[kind])
            rows = rows.withColumn(SLOT, F.when(key.rlike(ID), self.slot(key)).otherwise(_refuse(f"{kind}: no id: ", key)))
        if kind in CHILDREN:
            audits = self.read("audits").select(F.col("id").alias("audit_id"), PERIOD, SLOT)
            rows = rows.drop(PERIOD).join(audits, ["audit_id", SLOT], "left")
            rows = rows.withColumn(PERIOD, F.coalesce(PERIOD, _refuse(f"{kind}: no audit ", F.col("audit_id"))))
        elif PERIOD in own.names:
            rows = rows.withColumn(PERIOD, F.coalesce(F.date_format("created_at", self.period), _refuse(f"{kind}: no time: ", F.col("id"))))
        if kind == "audits":
            rows = rows.withColumn("id", F.when(F.col("id").rlike(ID) & (self.slot(F.col("id")) == F.col(SLOT)), F.col("id")).otherwise(_refuse("audits: not in its site's slot: ", F.col("id"))))
        for field in own:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
            elif field.dataType == T.StringType() and rows.schema[field.name].dataType.typeName() in ("struct", "array", "map"):
                rows = rows.withColumn(field.name, F.to_json(field.name))
        self._write(rows.select(*[F.col(f.name).cast(f.dataType) for f in own]), kind, "append")

    def _write(self, rows: DataFrame, kind: str, mode: str) -> None:
        # A file for each partition, and more where one is large: adaptive execution splits it.
        rows.hint("rebalance", *LAYOUT[kind]).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT[kind]).parquet(f"{self.path}/{kind}")

    def start(self, audits: DataFrame) -> None:
        """New audits (id, site_id, owner, created_at), running."""
        self.append(audits, "audits")
        self.append(audits.select(F.col("id").alias("audit_id"), F.lit("running").alias("status"), F.col("created_at").alias("at")), "statuses")

    def finish(self, scored: DataFrame) -> None:
        """Audits that are done: audit_id, overall, page_count, categories and counts (nested), at."""
        self.append(scored, "statuses", status="done")

    def fail(self, failed: DataFrame) -> None:
        """Audits that failed: audit_id, error (cut to 500 characters), at."""
        self.append(failed.withColumn("error", F.substring("error", 1, 500)), "statuses", status="failed")

    def get(self, kind: str, id_: str) -> DataFrame:
        """The row with an id, or none: of all partitions only those of the id's slot are read."""
        rows = self.read(kind).filter(F.col("id") == id_)
        return rows.filter(F.col(SLOT) == id_[: self.digits]) if SLOT in rows.columns else rows

    def audits_of(self, site: str, since: str | None = None) -> DataFrame:
        """A site's audits, from a period on."""
        rows = self.read("audits").filter((F.col(SLOT) == site[: self.digits]) & (F.col("site_id") == site))
        return rows if since is None else rows.filter(F.col(PERIOD) >= since)

    def children_of(self, kind: str, audits: DataFrame) -> DataFrame:
        """The rows of a table that belong to audits (id, period and slot as they are read), with site_id. Only the
        partitions that the audits lie in are read, where they are few enough to be known before the scan."""
        own = counted_small(audits)(audits.select(F.col("id").alias("audit_id"), PERIOD, SLOT, "site_id"))
        return self.read(kind).join(own, [PERIOD, SLOT, "audit_id"])

    def delete_sites(self, gone: DataFrame) -> None:
        """Delete sites (id), their audits and what belongs to these; unknown ids delete nothing."""
        gone = keep(gone.filter(F.col("id").isNotNull()).select("id", self.slot(F.col("id")).alias(SLOT)).distinct(), "gone")
        slots = [r[0] for r in gone.select(SLOT).distinct().collect()]  # as many as there are slots, at most
        held = self.read("audits").filter(F.col(SLOT).isin(slots))
        lost = held.join(counted_small(gone)(gone.select(F.col("id").alias("site_id"))), "site_id", "left_semi")
        lost = keep(lost.select(F.col("id").alias("key"), PERIOD, SLOT), "lost")
        for kind in CHILDREN:
            self._rewrite(kind, "audit_id", lost)
        self._rewrite("audits", "id", lost)
        self._rewrite("sites", "id", gone.select(F.col("id").alias("key"), SLOT))

    def _rewrite(self, kind: str, key: str, gone: DataFrame) -> None:
        """Take the rows with a key of gone (key and partition columns) out of a table."""
        if not self._exists(kind):
            return
        where = list(LAYOUT[kind])
        touched = gone.select(*where).distinct()  # as many rows as the table has partitions, at most
        rows = self.read(kind).join(F.broadcast(touched), where, "left_semi")
        left = rows.join(counted_small(gone)(gone.select(F.col("key").alias(key))), key, "left_anti")
        # The partitions that will have rows, before they are swapped.
        some = {tuple(r) for r in left.select(*where).distinct().collect()}
        self._write(left.select(*schema(kind).names), kind, "overwrite")
        for part in {tuple(r) for r in touched.collect()} - some:
            files, at = self._files(f"{kind}/" + "/".join(f"{c}={v}" for c, v in zip(where, part, strict=True)))
            if files.exists(at):
                files.delete(at, True)


def _refuse(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(what), F.coalesce(value.cast("string"), F.lit("null"))))
