"""Which addresses may be fetched: literals by expression, names by a table of resolved addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.functions import dual as D
from shirabe.functions import urls as U


def validate(urls: DataFrame, resolved: DataFrame) -> DataFrame:
    """raw, url and accepted for urls (raw). resolved: host, ip. A name is accepted only if it has
    addresses and all are public. Every address that is fetched goes through this: seeds, sitemaps that
    robots.txt names, targets of redirects and probes."""
    rows = urls.select("raw", U.with_scheme(D.name("raw")).col.alias("url"))
    rows = rows.withColumn("host", F.regexp_replace(U.host(D.name("url")).col, r"\.+$", "")).withColumn("literal", U.public_literal(D.name("url")))
    ip = F.when(F.contains("ip", F.lit(":")), F.concat(F.lit("["), F.lower("ip"), F.lit("]"))).otherwise(F.col("ip"))
    # A name that passes as public is no answer of a resolver: only addresses count here.
    checked = resolved.groupBy("host").agg(F.bool_and(ip.rlike(r"^(?:[0-9.]+|\[.*\])$") & U.public_host(ip)).alias("public"))
    is_ip = F.col("host").rlike(r"^(?:[0-9.]+|\[.*\])$")
    return rows.join(checked, "host", "left").select("raw", "url", (F.col("literal") & (is_ip | F.coalesce("public", F.lit(False)))).alias("accepted"))
