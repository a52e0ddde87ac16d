"""Site rules: robots, sitemap, duplicates and broken links. One row of facts for each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.operators.rules import Rule

C, W, I = "critical", "warning", "info"  # noqa: E741
#: Over site facts: base_url, robots_txt (null: not fetched), robots_blocks_all, robots_sitemap,
#: sitemap_found, broken (text of the first broken links).
SITE_RULES: tuple[Rule, ...] = (
    Rule("crawl.robots.missing", I, "robots_txt IS NULL", "concat(base_url, '/robots.txt')", "There is no robots.txt", "Add one"),
    Rule("crawl.robots.disallow_all", C, "robots_txt IS NOT NULL AND robots_blocks_all", "'Disallow: /'", "All crawlers are shut out", "Allow crawling"),
    Rule("crawl.robots.no_sitemap", I, "robots_txt IS NOT NULL AND robots_sitemap = ''", "'no Sitemap line'", "robots.txt names no sitemap", "Name it"),
    Rule("crawl.sitemap.missing", W, "NOT sitemap_found", "concat(base_url, '/sitemap.xml')", "There is no sitemap", "Add one"),
    Rule("content.broken_link", W, "broken <> ''", "broken", "Links lead nowhere", "Repair them"),
)


def _head(rows: DataFrame, keys: list[str], order: str, shown: int) -> DataFrame:
    """The first rows of each group; the rank's limit is applied before the shuffle as well, so a
    hot group sends no more than that from each task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= shown)


def duplicates(pages: DataFrame, site: str, value: str, url: str, seq: str, shown: int = 3) -> DataFrame:
    """Values that several pages of a site share: site, value, n, first_url, first_seq and first_urls
    (the first few). Counts are combined before the shuffle; no group is gathered."""
    rows = pages.filter(F.col(value) != "").select(F.col(site).alias("site"), F.col(value).alias("value"), F.col(url).alias("url"), F.col(seq).alias("seq"))
    counts = rows.groupBy("site", "value").agg(F.count("*").alias("n"), F.min_by("url", "seq").alias("first_url"), F.min("seq").alias("first_seq")).filter("n > 1")
    first = _head(rows, ["site", "value"], "seq", shown).groupBy("site", "value").agg(F.array_sort(F.collect_list(F.struct("rank", "url"))).alias("firsts"))
    urls = F.array_join(F.transform("firsts", lambda s: s["url"]), ", ")
    return counts.join(first, ["site", "value"]).select("site", "value", "n", "first_url", "first_seq", urls.alias("first_urls"))


def duplicate_findings(groups: DataFrame, rule: str, shown: int = 3) -> DataFrame:
    more = F.when(F.col("n") > shown, F.lit(" and more")).otherwise(F.lit(""))
    evidence = F.concat(F.substring("value", 1, 50), F.lit(": "), F.col("first_urls"), more)
    return groups.select("site", F.lit(rule).alias("rule"), F.lit(rule.split(".")[0]).alias("category"), F.lit("warning").alias("severity"), F.col("first_url").alias("url"), evidence.alias("evidence"), "first_seq")


def probe_status(probes: DataFrame) -> DataFrame:
    """probes (head, get: statuses, 0 or null without an answer) with status: the answer to HEAD, or to GET
    where HEAD is not allowed (405)."""
    head, get = (F.coalesce(F.col(c), F.lit(0)) for c in ("head", "get"))
    return probes.withColumn("status", F.when(head == 405, get).otherwise(head))


def facts(sites: DataFrame, robots: DataFrame, parsed: DataFrame, sitemaps: DataFrame, broken: DataFrame) -> DataFrame:
    """Facts of each site (site, base_url) as SITE_RULES read them. robots: site, body; parsed: of
    parse_robots; sitemaps: of first_sitemap; broken: of broken_links."""
    rows = sites.join(robots.select("site", F.col("body").alias("robots_txt")), "site", "left").join(parsed, "site", "left")
    rows = rows.join(sitemaps.select("site", F.lit(True).alias("has_sitemap")), "site", "left").join(broken, "site", "left")
    return rows.select(
        "site", "base_url", "robots_txt", F.coalesce("blocks_all", F.lit(False)).alias("robots_blocks_all"), F.coalesce("sitemap", F.lit("")).alias("robots_sitemap"),
        F.coalesce("has_sitemap", F.lit(False)).alias("sitemap_found"), F.coalesce("broken", F.lit("")).alias("broken"), F.coalesce("n", F.lit(0)).cast("long").alias("broken_count"),
    )


def broken_links(probes: DataFrame, shown: int = 3) -> DataFrame:
    """site, n and broken (the first as url(status)) from probes (site, pos, url, status). A probe
    that failed has status 0."""
    bad = probes.filter("status = 0 OR status >= 400")
    text = F.concat("url", F.lit("("), F.col("status").cast("string"), F.lit(")"))
    counts = bad.groupBy("site").agg(F.count("*").alias("n"))
    first = _head(bad.withColumn("t", text), ["site"], "pos", shown).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("firsts"))
    return counts.join(first, "site").select("site", "n", F.array_join(F.transform("firsts", lambda s: s["t"]), ", ").alias("broken"))
