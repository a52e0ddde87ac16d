"""Operators over the tables of the audit store (`archive` keeps them): latest, quota, lists, retention and status."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.config import SETTINGS
from shirabe.storage import counted_small, unused


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order; the limit also holds before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def latest_done(audits: DataFrame, site: str, audit: str, status: str, created: str, listed: int = SETTINGS.audits_listed, done: str = "done") -> DataFrame:
    """The newest finished audit among the newest `listed` audits of each site; an older one behind
    that many others is not seen."""
    order = [F.col(created).desc(), F.col(audit).desc()]
    head = newest(audits, [site], order, listed).filter(F.col(status) == done).drop("rank")
    return newest(head, [site], order).drop("rank")


def usage_by_month(events: DataFrame, owner: str, kind: str, at: str) -> DataFrame:
    """owner, kind, month (first day, UTC) and used."""
    return events.groupBy(F.col(owner).alias("owner"), F.col(kind).alias("kind"), F.to_date(F.date_trunc("month", at)).alias("month")).agg(F.count("*").alias("used"))


def over_quota(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    """usage with the kind's limit (null: none) and whether it is reached."""
    limit: Column = F.lit(None).cast("int")
    for kind, n in limits.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    return usage.withColumn("limit", limit).withColumn("exceeded", F.coalesce(F.col("used") >= F.col("limit"), F.lit(False)))


def current_status(log: DataFrame) -> DataFrame:
    """The newest row of each audit in a log of status rows (audit_id, status, error, at)."""
    rows = newest(log, ["audit_id"], [F.col("at").desc(), F.col("status").asc()]).drop("rank")
    return rows.withColumn("error", F.substring("error", 1, 500))


def listed(rows: DataFrame, owner: str, most: int | None = None) -> DataFrame:
    """An owner's rows with their place, the newest first; of equal times the greater id."""
    order = Window.partitionBy("owner").orderBy(F.col("created_at").desc(), F.col("id").desc())
    out = visible(rows, owner).withColumn("place", F.row_number().over(order))
    return out if most is None else out.filter(F.col("place") <= most)


def visible(rows: DataFrame, owner: str, admins: Sequence[str] = ()) -> DataFrame:
    """Rows of an owner alone; an admin sees all."""
    me = F.lit(owner)
    return rows.filter(is_admin(me, admins) | (F.col("owner") == me))


#: Pairs of a viewer and a row that a task makes, about.
MOST_PAIRS = 10_000_000


def visible_to(rows: DataFrame, viewers: DataFrame, name: str, admins: Sequence[str]) -> DataFrame:
    """The rows that each viewer (name: the owner they are) sees: one join by owner; an admin sees all. The result has
    a row for each pair, so it grows with rows times viewers and the file sizes of the tables don't tell the work:
    pairs are counted first, by owner, and dealt to as many tasks as they need."""
    admin = is_admin(F.col(name), admins)
    own, all_ = viewers.filter(~admin), viewers.filter(admin)
    sizes = own.groupBy(F.col(name).alias("by_")).agg(F.count("*").alias("m_")).join(rows.groupBy("owner").agg(F.count("*").alias("n_")), F.col("by_") == F.col("owner"))
    pairs = sizes.agg(F.sum(F.col("m_").cast("double") * F.col("n_"))).first()[0] or 0.0
    return _met(own, rows, pairs, [(name, "owner")]).unionByName(_met(all_, rows, float(all_.count()) * rows.count(), []))


def _met(viewers: DataFrame, rows: DataFrame, pairs: float, on: Sequence[tuple[str, str]]) -> DataFrame:
    """viewers and rows with equal columns, in tasks of about MOST_PAIRS of their pairs: rows are dealt to parts, and each
    part meets the viewers, who are broadcast where their count is low, else sent once to each part."""
    parts = max(1, math.ceil(pairs / MOST_PAIRS))
    few = counted_small(viewers)
    cells = 1 if few is F.broadcast else parts
    at, part = unused(("at", "part"), [*rows.columns, *viewers.columns]).values()
    dealt = rows.withColumn(at, F.pmod(F.xxhash64(*rows.columns), F.lit(cells)))
    every = viewers.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    if few is not F.broadcast:
        dealt, every = dealt.repartition(parts, *[r for _, r in on], at), every.repartition(parts, *[v for v, _ in on], part)
    elif parts > 1:
        dealt = dealt.repartition(parts)
    return few(every).join(dealt, [*[F.col(v) == F.col(r) for v, r in on], F.col(part) == F.col(at)]).drop(at, part)


def is_admin(owner: Column, admins: Sequence[str]) -> Column:
    return F.lower(F.regexp_replace(F.trim(owner), "^@+", "")).isin(*admins)


def nested_audits(audits: DataFrame, findings: DataFrame, columns: Sequence[str] = ("rule", "category", "severity", "evidence")) -> DataFrame:
    """audits (id and more) with findings, an array in order of severity, category, rule and place; empty
    without one. An audit's findings are bounded by its pages."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    rows = findings.select("audit_id", F.struct(rank.alias("rank"), "category", "rule", "seq", F.struct(*columns).alias("f")).alias("s"))
    nested = rows.groupBy("audit_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"]).alias("findings"))
    none = F.array().cast(nested.schema["findings"].dataType)
    out = audits.join(nested, audits["id"] == nested["audit_id"], "left").drop("audit_id")
    return out.withColumn("findings", F.coalesce("findings", none))


def latest_advice(advice: DataFrame) -> DataFrame:
    """The newest advice of each audit; of equal times that with the greater id."""
    return newest(advice, ["audit_id"], [F.col("created_at").desc(), F.col("id").desc()]).drop("rank")


def audit_view(audits: DataFrame, sites: DataFrame, advice: DataFrame) -> DataFrame:
    """audits with the name and address of their site, and their latest advice (null: none)."""
    last = latest_advice(advice).select(F.col("audit_id").alias("id"), F.col("body").alias("advice"), F.col("model").alias("advice_model"))
    named = sites.select(F.col("id").alias("site_id"), F.col("name").alias("site_name"), F.col("url").alias("site_url"))
    return audits.join(named, "site_id", "left").join(last, "id", "left")


def usage_status(owners: DataFrame, usage: DataFrame, sites: DataFrame, admins: Sequence[str], most_sites: int = SETTINGS.sites) -> DataFrame:
    """For each owner (owner): plan, audits and advice used of the month (usage: owner, kind, used), their
    limits (null: none), sites (owner) and their limit."""
    used = usage.groupBy("owner").agg(*[F.sum(F.when(F.col("kind") == k, F.col("used"))).alias(f"{n}_used") for k, n in (("audit", "audits"), ("advice", "advice"))])
    own = sites.groupBy("owner").agg(F.count("*").alias("sites"))
    admin = is_admin(F.col("owner"), admins)
    rows = owners.join(used, "owner", "left").join(own, "owner", "left")
    limit = lambda n: F.when(~admin, F.lit(n))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "owner", F.when(admin, "admin").otherwise("free").alias("plan"), count("audits_used"), limit(SETTINGS.free_audits).alias("audits_limit"), count("advice_used"),
        limit(SETTINGS.free_advice).alias("advice_limit"), count("sites"), F.lit(most_sites).alias("sites_limit"),
    )


#: What the gateway lets through; everything else is refused.
ROUTES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("/health|/api/usage", ("GET",)),
    ("/api/sites", ("GET", "POST")),
    ("/api/sites/[a-f0-9]{16}", ("DELETE",)),
    ("/api/sites/[a-f0-9]{16}/audits", ("GET", "POST")),
    ("/api/audits/[a-f0-9]{16}", ("GET",)),
    ("/api/audits/[a-f0-9]{16}/advice", ("POST",)),
    (r"/api/audits/[a-f0-9]{16}/report\.md", ("GET",)),
)


def route_allowed(path: Column, method: Column) -> Column:
    allowed: Column = F.lit(False)
    for pattern, methods in ROUTES:
        allowed = allowed | (path.rlike(rf"\A(?:{pattern})\z") & method.isin(*methods))
    return allowed


def provider(owner: Column, admins: Sequence[str], paid: Column, local: str = "local", remote: str = "paid") -> Column:
    """Which provider writes an owner's advice: admins' and unpaid ones go to the local one."""
    return F.when(is_admin(owner, admins) | ~paid, local).otherwise(remote)


def page_budget(requested: Column, admin: Column) -> Column:
    """Pages that an audit may read: what is asked for, at most the plan's ceiling, at least 1."""
    return F.greatest(F.lit(1), F.least(requested, F.when(admin, SETTINGS.max_pages_admin).otherwise(SETTINGS.max_pages)))


def key_value(lines: DataFrame, name: str) -> DataFrame:
    """value of the first line `name=value` in lines (pos, value) of a key file; comments and lines without
    = are skipped, quotes around the value dropped."""
    line = F.trim("value")
    rows = lines.filter(~line.startswith("#") & line.contains("=")).select("pos", F.trim(F.regexp_extract(line, "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract(line, "^[^=]*=(.*)$", 1)).alias("value"))
    rows = rows.filter(F.col("key") == name)
    return rows.groupBy().agg(F.min_by(F.regexp_replace(F.regexp_replace("value", '^"+|"+$', ""), "^'+|'+$", ""), "pos").alias("value"))


def mask_lite(details: DataFrame, lite: Column) -> DataFrame:
    """Empty findings and pages where lite."""
    empty = lambda c: F.when(lite, F.array().cast(details.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return details.select(*[empty(c) if c in ("findings", "pages") else F.col(c) for c in details.columns])


def write_documents(documents: DataFrame, path: str, kept: int = SETTINGS.documents_kept) -> None:
    """JSON documents, the newest `kept` by id."""
    documents.orderBy(F.col("id").desc()).limit(kept).write.mode("overwrite").json(path)


def read_documents(spark, path: str, schema: str, listed: int = 20) -> DataFrame:  # noqa: ANN001
    """The newest documents with a valid id; what can't be read is skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("id").rlike(AUDIT_ID)).orderBy(F.col("id").desc()).limit(listed)


#: Fixed value: the form of a document's id.
AUDIT_ID = r"^[0-9]{8}-[0-9]{6}-[a-f0-9]{8}$"


def to_jst(x: Column) -> Column:
    """A UTC time in text as Japanese time; null: -, what can't be read stays."""
    at = F.date_format(F.from_utc_timestamp(F.try_to_timestamp(x), "Asia/Tokyo"), "yyyy-MM-dd HH:mm 'JST'")
    return F.when(x.isNull(), "-").otherwise(F.coalesce(at, x))
