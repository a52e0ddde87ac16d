"""robots.txt and sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.functions import dual as D
from shirabe.functions import urls as U


def parse_robots(bodies: DataFrame) -> DataFrame:
    """site, blocks_all and sitemap from (site, body). A line is what stands before #, split at its
    first colon; the last user-agent line rules the lines after it; the first sitemap counts.
    A null body (not fetched) gives no row. Lines of one site are bounded by its file."""
    lines = bodies.select("site", F.posexplode(F.split(F.regexp_replace("body", "\r\n?", "\n"), "\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("site", "pos", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"))
    run = Window.partitionBy("site").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    star = F.last(F.when(F.col("key") == "user-agent", F.col("value") == "*"), ignorenulls=True).over(run)
    lines = lines.withColumn("star", F.coalesce(star, F.lit(False)))
    blocks = (F.col("key") == "disallow") & F.col("star") & (F.col("value") == "/")
    named = (F.col("key") == "sitemap") & (F.col("value") != "")
    return lines.groupBy("site").agg(F.bool_or(blocks).alias("blocks_all"), F.coalesce(F.min_by(F.when(named, F.col("value")), F.when(named, F.col("pos"))), F.lit("")).alias("sitemap"))


_LOC = r"(?is)<(?:[A-Za-z0-9]+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:[A-Za-z0-9]+:)?loc\s*>"


#: The entities of XML.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _decoded(x: Column) -> Column:
    """Entities of XML, also numbers of printable ASCII, decoded; & last, so that nothing is decoded twice."""
    for code in (*range(0x21, 0x26), *range(0x27, 0x7F)):
        if not chr(code).isalnum():
            x = F.replace(F.replace(x, F.lit(f"&#{code};"), F.lit(chr(code))), F.lit(f"&#x{code:X};"), F.lit(chr(code)))
    for text, by in _ENTITIES[:-1]:
        x = F.replace(x, F.lit(text), F.lit(by))
    return F.replace(F.replace(x, F.lit("&#38;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """site, pos, loc and is_index from (site, body): every <loc> in any namespace, CDATA or not.
    In an index the locs are further sitemaps."""
    rows = bodies.select("site", F.col("body").rlike(r"(?i)<(?:[A-Za-z0-9]+:)?sitemapindex\b").alias("is_index"), F.posexplode(F.regexp_extract_all("body", F.lit(_LOC), F.lit(1))).alias("pos", "loc"))
    return rows.filter("loc != ''").select("site", "pos", _decoded(F.col("loc")).alias("loc"), "is_index")


def candidates(sites: DataFrame, parsed: DataFrame) -> DataFrame:
    """site, pos and url of the files to try for each site (site, base_url): the one that its robots.txt
    names (parsed: site, sitemap), then the usual one."""
    named = parsed.filter("sitemap != ''").select("site", F.lit(0).alias("pos"), F.col("sitemap").alias("url"))
    usual = sites.select("site", F.lit(1).alias("pos"), F.concat(F.regexp_extract("base_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/sitemap.xml")).alias("url"))
    return named.unionByName(usual)


def first_sitemap(tried: DataFrame, files: DataFrame) -> DataFrame:
    """site, pos, url and body of the first of the files tried (site, pos, url) that was fetched (files:
    url, body; null: not) and has a loc."""
    rows = tried.join(files.filter("body IS NOT NULL"), "url").filter(F.col("body").rlike(_LOC))
    return rows.groupBy("site").agg(F.min(F.struct("pos", "url", "body")).alias("f")).select("site", "f.*")


def sitemap_urls(bodies: DataFrame, children: DataFrame, most_children: int = 5) -> DataFrame:
    """site, pos and url (normal form): locs of the sites' own sitemaps and of the first children of an
    index (children: url, body of further sitemaps), each at its first place; addresses of sitemap files
    themselves are left out."""
    top = parse_sitemaps(bodies)
    own = top.filter("NOT is_index").select("site", F.lit(0).alias("child"), "pos", F.col("loc").alias("url"))
    inner = top.filter(F.col("is_index") & (F.col("pos") < most_children)).select(F.col("site").alias("parent"), F.col("loc").alias("file"), F.col("pos").alias("child"))
    deep = parse_sitemaps(children.withColumnRenamed("url", "site")).filter("NOT is_index")
    deep = deep.join(inner, deep["site"] == inner["file"]).select(F.col("parent").alias("site"), "child", "pos", F.col("loc").alias("url"))
    rows = own.unionByName(deep).filter(~F.col("url").rlike(r"(?i)\.xml(?:\.gz)?$")).withColumn("url", U.normalize(D.name("url")).col)
    first = rows.groupBy("site", "url").agg(F.min(F.struct("child", "pos")).alias("at"))
    return first.select("site", (F.row_number().over(Window.partitionBy("site").orderBy("at", "url")) - 1).alias("pos"), "url")
