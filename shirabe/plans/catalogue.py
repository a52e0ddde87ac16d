"""The catalogue of registered queries: each with the SQL its result is held against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shirabe import sql
from shirabe.config import CATEGORIES, SETTINGS
from shirabe.functions import dual as D
from shirabe.functions import jsonld
from shirabe.functions.entities import unescape
from shirabe.functions.resolve import resolve
from shirabe.functions import text as T
from shirabe.functions import urls as U
from shirabe.operators import admission, archive, compare, crawl, dialects, documents, report, robots, rules, safety, scoring, site, store
from shirabe.plans import mutations as M
from shirabe.plans import oracle as O
from shirabe.plans.mutations import mutated, mutated_sql
from shirabe.sources import facts as X
from shirabe.sources import html
from shirabe.streaming import usage
from shirabe.storage import counted_small, new_path, numbered_within, table
from shirabe.storage import store as keep


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = Query(run, sql)
        return run

    return add


def facts_of(pages: DataFrame) -> DataFrame:
    """Facts as the parser reads them."""
    return html.rule_facts(html.extract(pages))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(mutated(spark, sf_dir))


PAGES = f"pages_facts AS MATERIALIZED ({X.facts_sql(mutated_sql())})"
RAW = "(SELECT page_id, url, html FROM pages)"


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# --- extraction ------------------------------------------------------------------------------

_EXTRACT = "page_id, title, title_width, charset, lang, h1_count, h1_first, text_length, html_bytes, link_count, internal_link_count, url_scheme, url_host"


@query("q_page_extract", f"SELECT {_EXTRACT} FROM ({X.facts_sql(RAW)})")
def q_page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_pages(spark, sf_dir).selectExpr(*_EXTRACT.split(", "))


_META = "page_id, description, description_width, robots_meta, viewport, canonical, canonical_conflict, noindex, nofollow, fullwidth, heading_jumps, blocking_scripts, mixed_content, images_total, images_without_alt"


@query("q_page_meta", f"WITH {PAGES} SELECT {_META} FROM pages_facts")
def q_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).selectExpr(*_META.split(", "))


@query("q_title_width", f"WITH {PAGES} SELECT page_id, title, title_width FROM pages_facts")
def q_title_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "title", "title_width")


@query("q_has_japanese", f"WITH {PAGES} SELECT page_id, has_ja, lang FROM pages_facts")
def q_has_japanese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "has_ja", "lang")


@query("q_mojibake", f"WITH {PAGES} SELECT page_id, mojibake FROM pages_facts WHERE mojibake <> ''")
def q_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter("mojibake <> ''").select("page_id", "mojibake")


@query("q_fullwidth_title", f"WITH {PAGES} SELECT page_id, fullwidth FROM pages_facts WHERE fullwidth <> ''")
def q_fullwidth_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter("fullwidth <> ''").select("page_id", "fullwidth")


@query("q_heading_jumps", f"WITH {PAGES} SELECT page_id, heading_jumps FROM pages_facts WHERE heading_jumps <> ''")
def q_heading_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).filter("heading_jumps <> ''").select("page_id", "heading_jumps")


@query("q_jsonld_types", f"WITH {PAGES} SELECT page_id, jsonld_list, jsonld_count, jsonld_invalid, has_breadcrumb FROM pages_facts")
def q_jsonld_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "jsonld_list", "jsonld_count", "jsonld_invalid", "has_breadcrumb")


@query("q_jsonld_variant", f"WITH {PAGES} SELECT page_id, jsonld_list, jsonld_count, jsonld_invalid FROM pages_facts")
def q_jsonld_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts without the parser, from documents as VARIANT."""
    found = mutated(spark, sf_dir).select("page_id", jsonld.types(F.col("html")).alias("types"), jsonld.invalid(F.col("html")).alias("jsonld_invalid"))
    return found.select("page_id", F.array_join("types", ", ").alias("jsonld_list"), F.size("types").alias("jsonld_count"), "jsonld_invalid")


_UNESCAPED = "html"
for _name, _char in (("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("nbsp", "chr(160)"), ("amp", "'&'")):
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '&{_name};?', {_char}, 'g')"


@query("q_entities", f"SELECT page_id, md5(u) AS digest, (length(html) - length(u))::INT AS shorter FROM (SELECT page_id, html, {_UNESCAPED} AS u FROM {mutated_sql()})")
def q_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages with all character references replaced; the SQL knows those that the tables have."""
    rows = mutated(spark, sf_dir).select("page_id", "html", unescape(F.col("html")).alias("u"))
    return rows.select("page_id", F.md5("u").alias("digest"), (F.char_length("html") - F.char_length("u")).alias("shorter"))


@query("q_og_missing", f"WITH {PAGES} SELECT page_id, og_missing FROM pages_facts")
def q_og_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "og_missing")


@query("q_og_tags", f"WITH {PAGES} SELECT page_id, COALESCE(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?i)<meta\\s+property=\"(og:[a-z:_]+)\"', 1), lambda k: lower(k)))), ', '), '') AS og_keys FROM pages_facts")
def q_og_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(F.map_keys("og")), ", ").alias("og_keys"))


@query("q_h1_texts", f"WITH {PAGES} SELECT page_id, len(list_filter(levels, lambda v: v = '1'))::INT AS h1_count, array_to_string(h1_texts, ' / ') AS h1_texts FROM pages_facts")
def q_h1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", "h1_count", F.array_join("h1_texts", " / ").alias("h1_texts"))


@query("q_page_summary", f"WITH {PAGES} SELECT page_id, url, status, floor(elapsed * 1000 + 0.5) / 1000 AS elapsed, title, title_width, description_width, h1_count, text_length, jsonld_list, images_total, images_without_alt, link_count, internal_link_count, viewport, lang, charset FROM pages_facts")
def q_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "page_id url status title title_width description_width h1_count text_length jsonld_list images_total images_without_alt link_count internal_link_count viewport lang charset"
    return pages(spark, sf_dir).select(*names.split(), F.expr("floor(elapsed * 1000 + 0.5) / 1000").alias("elapsed"))


# --- rules ------------------------------------------------------------------------------------

_KEYS = ["url_host", "page_id", "url"]


def _category_query(category: str) -> None:
    @query(f"q_rules_{category}", f"WITH {PAGES} {O.findings('pages_facts', 'page_id', O.PAGE_RULES, category)}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.findings(pages(spark, sf_dir), ["page_id"], rules.by_category(category))


for _c, _ in CATEGORIES:
    _category_query(_c)


_TABLE_RULES = tuple(
    (r, "critical", w, e) if r == "content.thin" else (r, s, w, e) for r, s, w, e in O.PAGE_RULES if r != "social.og.partial"
) + (("content.no_image", "info", "images_total = 0", "length(title) || ' characters of title'"),)


@query("q_rules_table", f"WITH {PAGES} SELECT page_id, rule, category, severity, evidence FROM ({O.findings('pages_facts', 'page_id', _TABLE_RULES)})")
def q_rules_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules kept as a table: one is made graver from a day on, one is given up, an own one is new, a later one doesn't
    hold yet."""
    path = new_path(spark, "rules")
    rules.to_table(spark, rules.PAGE_RULES, date(2024, 1, 1)).write.parquet(path)
    thin = next(r for r in rules.PAGE_RULES if r.id == "content.thin")
    later = [
        (21, thin.id, "critical", thin.when, thin.evidence, thin.message, thin.action, date(2024, 5, 1)),
        (20, "social.og.partial", None, None, None, None, None, date(2024, 5, 1)),
        (99, "content.no_image", "info", "images_total = 0", "concat(char_length(title), ' characters of title')", None, None, date(2024, 5, 1)),
        (99, "content.later", "info", "true", "''", None, None, date(2030, 1, 1)),
    ]
    spark.createDataFrame(later, rules.TABLE).write.mode("append").parquet(path)
    held = rules.from_table(spark.read.parquet(path), date(2024, 6, 1))
    return rules.findings(pages(spark, sf_dir), ["page_id"], held).drop("rule_ord")


def _dup_sql(value: str, facts: str = "pages_facts") -> str:
    return f"""SELECT url_host AS site, {value} AS value, COUNT(*) AS n, min_by(url, page_id) AS first_url, array_to_string((list(url ORDER BY page_id))[1:3], ', ') AS first_urls
      FROM {facts} WHERE {value} <> '' GROUP BY ALL HAVING COUNT(*) > 1"""


@query("q_dup_titles", f"WITH {PAGES} {_dup_sql('title')}")
def q_dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = keep(pages(spark, sf_dir).select("url_host", "page_id", "url", "title"), "facts")  # read twice, parsed once
    return site.duplicates(facts, "url_host", "title", "url", "page_id").drop("first_seq")


@query("q_dup_descriptions", f"WITH {PAGES} {_dup_sql('description')}")
def q_dup_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = keep(pages(spark, sf_dir).select("url_host", "page_id", "url", "description"), "facts")  # read twice, parsed once
    return site.duplicates(facts, "url_host", "description", "url", "page_id").drop("first_seq")


_SHARED = (("title", "meta.title.duplicate"), ("description", "meta.description.duplicate"))
_EVIDENCE = "substring(value, 1, 50) || ': ' || first_urls || CASE WHEN n > 3 THEN ' and more' ELSE '' END"


@query("q_dup_findings", f"WITH {PAGES} " + " UNION ALL ".join(f"SELECT site, '{r}' AS rule, 'meta' AS category, 'warning' AS severity, first_url AS url, {_EVIDENCE} AS evidence FROM ({_dup_sql(v)})" for v, r in _SHARED))
def q_dup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = keep(pages(spark, sf_dir).select("url_host", "page_id", "url", "title", "description"), "facts")
    found = [site.duplicate_findings(site.duplicates(facts, "url_host", v, "url", "page_id"), r).drop("first_seq") for v, r in _SHARED]
    return found[0].unionByName(found[1])


# --- what sites answer: robots.txt, sitemaps, links that lead nowhere ---------------------------------


def _answers(hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(robots, files): site and body; url and body (null: not there), of the sites in hosts (site)."""
    files = None
    for url, body in M.sitemap_files(duck=False):
        one = hosts.selectExpr(f"{url} AS url", f"{body} AS body")
        files = one if files is None else files.unionByName(one)
    assert files is not None
    return hosts.selectExpr("site", f"{M.robots_bodies(duck=False)} AS body"), files


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(U.host(D.name("url")).col.alias("site")).distinct().withColumn("base_url", F.concat(F.lit("https://"), "site"))


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"
_ANSWERS = f"""hosts AS (SELECT DISTINCT {_HOST_SQL} AS site FROM pages), r AS MATERIALIZED (SELECT site, {M.robots_bodies(duck=True)} AS body FROM hosts),
 files AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {u} AS url, {b} AS body FROM hosts" for u, b in M.sitemap_files(duck=True))})"""
_ROBOTS = f"""{_ANSWERS},
 l AS (SELECT site, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS raw FROM (SELECT site, string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)) AS x FROM r WHERE body IS NOT NULL)),
 k AS (SELECT site, pos, lower(trim(regexp_extract(s, '^([^:]*):', 1), ' ')) AS key, trim(regexp_extract(s, '^[^:]*:(.*)$', 1), ' ') AS value FROM (SELECT site, pos, trim(regexp_replace(raw, '#.*$', ''), ' ') AS s FROM l)),
 u AS (SELECT *, COALESCE(last_value(CASE WHEN key = 'user-agent' THEN value = '*' END IGNORE NULLS) OVER (PARTITION BY site ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS star FROM k),
 p AS MATERIALIZED (SELECT site, bool_or(key = 'disallow' AND star AND value = '/') AS blocks_all, COALESCE(min_by(value, pos) FILTER (key = 'sitemap' AND value <> ''), '') AS sitemap FROM u GROUP BY site)"""


@query("q_robots_parse", f"WITH {_ROBOTS} SELECT * FROM p")
def q_robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.parse_robots(_answers(_hosts(spark, sf_dir))[0])


_LOC_SQL = "regexp_extract_all(body, '(?is)<(?:[a-z0-9]+:)?loc\\b[^>]*>(.*?)</(?:[a-z0-9]+:)?loc\\s*>', 1)"
_LOCS = f"list_filter(list_transform({_LOC_SQL}, lambda x: replace(trim(regexp_replace(trim(x), '^<!\\[CDATA\\[|\\]\\]>$', '', 'g')), '&amp;', '&')), lambda x: x <> '')"
_NORMAL = "(lower(regexp_extract({0}, '^[^:]+://[^/?#]*')) || COALESCE(NULLIF(rtrim(regexp_replace(regexp_replace(regexp_extract(regexp_replace({0}, '^[^:]+://[^/?#]*', ''), '^[^?#]*'), ';[^/]*$', ''), '/(index\\.(html|htm|php)|default\\.html)$', '/'), '/'), ''), '/') || regexp_extract(regexp_replace({0}, '#.*$', ''), '\\?.+$'))"
_SITEMAPS = f"""{_ROBOTS},
 tried AS (SELECT site, 0 AS pos, sitemap AS url FROM p WHERE sitemap <> '' UNION ALL SELECT site, 1, 'https://' || site || '/sitemap.xml' FROM hosts),
 got AS MATERIALIZED (SELECT site, arg_min(body, pos) AS body FROM (SELECT t.site, t.pos, f.body FROM tried t JOIN files f ON f.url = t.url WHERE f.body IS NOT NULL AND len({_LOC_SQL.replace('body', 'f.body')}) > 0) GROUP BY site),
 a AS (SELECT site, regexp_matches(body, '(?i)<(?:[a-z0-9]+:)?sitemapindex\\b') AS idx, {_LOCS} AS locs FROM got),
 own AS (SELECT site, 0 AS child, unnest(range(0, len(locs))) AS pos, unnest(locs) AS url FROM a WHERE NOT idx), kids AS (SELECT site, unnest(range(0, len(locs[1:5]))) AS child, unnest(locs[1:5]) AS file FROM a WHERE idx),
 deep AS (SELECT k.site, k.child, unnest(range(0, len(d.locs))) AS pos, unnest(d.locs) AS url FROM kids k JOIN (SELECT url, {_LOCS} AS locs FROM files WHERE body IS NOT NULL) d ON d.url = k.file),
 listed AS MATERIALIZED (SELECT site, (row_number() OVER (PARTITION BY site ORDER BY place_, url) - 1)::INT AS pos, url FROM (
   SELECT site, {_NORMAL.format('url')} AS url, MIN((child, pos)) AS place_ FROM (SELECT * FROM own UNION ALL SELECT * FROM deep) WHERE NOT regexp_matches(url, '(?i)\\.xml(\\.gz)?$') GROUP BY ALL))"""


def _sitemaps(spark: SparkSession, sf_dir: str, hosts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(robots, parsed, first, listed): what the sites' robots.txt and sitemaps say."""
    bodies, files = _answers(hosts)
    parsed = robots.parse_robots(bodies)
    first = robots.first_sitemap(robots.candidates(hosts, parsed), files)
    return bodies, parsed, first, robots.sitemap_urls(first.select("site", "body"), files.filter("body IS NOT NULL"))


@query("q_sitemap_urls", f"WITH {_SITEMAPS} SELECT site, pos, url FROM listed")
def q_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemaps(spark, sf_dir, _hosts(spark, sf_dir))[3]


@query(
    "q_crawl_seeds",
    f"""WITH {_SITEMAPS} SELECT site, node, (row_number() OVER (PARTITION BY site ORDER BY place_, node) - 1)::INT AS pos FROM (
 SELECT site, node, MIN(place_) AS place_ FROM (SELECT site, 'https://' || site || '/' AS node, -1 AS place_ FROM hosts UNION ALL SELECT site, url, pos FROM listed WHERE {_HOST_SQL} = site) GROUP BY ALL)""",
)
def q_crawl_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    return crawl.seeds(hosts, _sitemaps(spark, sf_dir, hosts)[3])


# --- links and crawling ----------------------------------------------------------------------

_EDGES = f"""edge AS MATERIALIZED (
  SELECT page_id, url_host, pos, {_NORMAL.format('target')} AS target FROM (
    SELECT page_id, url_host, unnest(range(0, len(whole)))::INT AS pos, unnest(whole) AS target FROM (
      SELECT page_id, url_host, list_filter(list_transform(links, lambda href: {O.dots(O.ABSOLUTE)}), lambda x: regexp_matches(x, '(?i)^https?://')) AS whole FROM pages_facts))
  WHERE lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) = url_host)"""


@query("q_url_normalize", f"SELECT page_id, {_NORMAL.format('url')} AS normal, {_HOST_SQL} AS host, lower(regexp_extract(url, '^[^:]*')) AS scheme FROM pages")
def q_url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = D.name("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalize(u).col.alias("normal"), U.host(u).col.alias("host"), U.scheme(u).col.alias("scheme"))


_URLS = "SELECT CASE page_id % 4 WHEN 0 THEN url || '/index.html' WHEN 1 THEN url || ';v=1' WHEN 2 THEN url || '%20x+y' ELSE url END AS url FROM pages UNION ALL SELECT * FROM (VALUES ('https://a.jp/x/#top'), ('https://A.jp'), ('https://a.jp/'), ('https://a.jp/index.html'), ('https://a.jp/sub/index.php?q=1#f'), ('https://a.jp//'), ('https://a.jp/a;v=1'), ('https://a.jp/default.html'), ('https://a.jp/my-index.html'), ('http://u:p@b.jp:8080/c/'), ('https://a.jp/%E3%81%82+b'), ('https://a.jp/%zz')) v(url)"


@query("q_url_cases", f"SELECT url, {_NORMAL.format('url')} AS normal, {U.host(D.name('url')).sql} AS host, {U.port(D.name('url')).sql} AS port, {U.percent_decode(D.name('url')).sql} AS decoded FROM ({_URLS})")
def q_url_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = D.name("url")
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(_URLS).select("url", U.normalize(u).col.alias("normal"), U.host(u).col.alias("host"), U.port(u).col.alias("port"), U.percent_decode(u).col.alias("decoded"))


@query("q_host_groups", f"SELECT {U.host(D.name('url')).sql} AS host, COUNT(*) AS pages, COUNT(*) FILTER ({U.scheme(D.name('url')).sql} = 'https') AS https FROM pages GROUP BY 1")
def q_host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = D.name("url")
    return table(spark, sf_dir, "pages").groupBy(U.host(u).col.alias("host")).agg(F.count("*").alias("pages"), F.count_if(U.scheme(u).col == "https").alias("https"))


@query("q_links_edges", f"WITH {PAGES}, {_EDGES} SELECT page_id, pos, target FROM edge")
def q_links_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.edges(pages(spark, sf_dir)).select("page_id", "pos", "target")


@query("q_links_resolved", f"WITH {PAGES}, {_EDGES} SELECT page_id, pos, target FROM edge")
def q_links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges without the parser: links as pages spell them, resolved in columns."""
    found = X.facts(mutated(spark, sf_dir))
    whole = F.filter(F.transform("links", lambda x: resolve(F.col("url"), x)), lambda x: x.rlike("(?i)^https?://"))
    return crawl.edges(found.withColumn("links", whole)).select("page_id", "pos", "target")


@query("q_internal_links", f"WITH {PAGES}, {_EDGES} SELECT url_host, COUNT(*) AS links, COUNT(DISTINCT target) AS targets FROM edge GROUP BY url_host")
def q_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.edges(pages(spark, sf_dir)).groupBy("url_host").agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


@query("q_sql_links", f"WITH pages_facts AS MATERIALIZED ({X.facts_sql(RAW)}), {_EDGES} SELECT page_id, pos, target, title_width FROM edge JOIN (SELECT page_id, title_width FROM pages_facts) USING (page_id)")
def q_sql_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and widths by SQL alone."""
    sql.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("sql_pages")
    return spark.sql("""
      SELECT t.page_id, l.pos, normal_url(l.target) AS target, t.title_width
      FROM (SELECT p.*, display_width(norm_text(f.value)) AS title_width FROM sql_pages p, LATERAL page_facts(p.url, p.html) f WHERE f.name = 'title') t,
        LATERAL page_links(t.url, t.html) l
      WHERE url_host(l.target) = url_host(t.url)""")


_CANDIDATES = f"""fresh AS (
  SELECT url_host, target, MIN((page_id, pos)) AS first_at FROM edge e WHERE NOT EXISTS (SELECT 1 FROM pages_facts p WHERE {_NORMAL.format('p.url')} = e.target) GROUP BY ALL),
 probe AS MATERIALIZED (SELECT * FROM (SELECT url_host, target, row_number() OVER (PARTITION BY url_host ORDER BY first_at, target)::INT AS pos FROM fresh) WHERE pos <= {SETTINGS.probes})"""
_BROKEN = f"""{_CANDIDATES}, bad AS (SELECT * FROM (SELECT url_host AS site, pos, target AS url, CASE WHEN head = 405 THEN "get" ELSE head END AS status FROM (
   SELECT *, {', '.join(f'{e} AS "{n}"' for n, e in M.probed(duck=True).items())} FROM probe)) WHERE status = 0 OR status >= 400),
 broken AS MATERIALIZED (SELECT site, COUNT(*) AS n, array_to_string((list(url || '(' || status || ')' ORDER BY pos))[1:3], ', ') AS broken FROM bad GROUP BY site)"""


def _candidates(facts: DataFrame) -> DataFrame:
    return crawl.candidates(crawl.edges(facts), facts.select(F.col("url_normal").alias("url")), "url_host", ["page_id", "pos"], SETTINGS.probes)


def _broken(facts: DataFrame) -> DataFrame:
    probes = _candidates(facts).selectExpr("url_host AS site", "pos", "target", *[f"{e} AS `{n}`" for n, e in M.probed(duck=False).items()])
    return site.broken_links(site.probe_status(probes).withColumnRenamed("target", "url"))


@query("q_broken_candidates", f"WITH {PAGES}, {_EDGES}, {_CANDIDATES} SELECT url_host, target, pos FROM probe")
def q_broken_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(keep(pages(spark, sf_dir).select("page_id", "url_host", "url_normal", "links"), "facts"))


@query("q_broken_links", f"WITH {PAGES}, {_EDGES}, {_BROKEN} SELECT * FROM broken")
def q_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(keep(pages(spark, sf_dir).select("page_id", "url_host", "url_normal", "links"), "facts"))


# A crawl's web: an address of a host answers with one of the host's pages, chosen by the address's digest, or with
# something other than a page. Seeds, links, and so the graph, are those that the parser finds.
_CRAWL_SEEDS = """seed AS (SELECT site, node, row_number() OVER (PARTITION BY site ORDER BY place_, node) AS pos FROM (
   SELECT site, node, MIN(place_) AS place_ FROM (SELECT site, 'https://' || site || '/' AS node, -1 AS place_ FROM hosts UNION ALL SELECT site, url, pos FROM listed WHERE {0} = site) GROUP BY ALL))""".format(_HOST_SQL)


def _crawl_sql(budget: str, columns: str) -> str:
    """The queue itself, taken from the front one address at a time: a list for each host."""
    digit = lambda at: f"CAST('0x' || substring(md5(w.queue[w.i]), {at}, 6) AS BIGINT)"
    return f"""WITH RECURSIVE {PAGES}, {_EDGES}, {_SITEMAPS}, {_CRAWL_SEEDS},
 mine AS (SELECT page_id, url_host AS site, error, row_number() OVER (PARTITION BY url_host ORDER BY page_id) - 1 AS k, COUNT(*) OVER (PARTITION BY url_host) AS n FROM pages_facts),
 content AS MATERIALIZED (SELECT o.*, COALESCE(l.links, []) AS links FROM mine o LEFT JOIN (SELECT page_id, list(target ORDER BY pos) AS links FROM edge GROUP BY page_id) l USING (page_id)),
 start AS (SELECT site, list(node ORDER BY pos) AS queue, {budget} AS budget, (SELECT any_value(n) FROM mine o WHERE o.site = seed.site) AS n,
   NOT EXISTS (SELECT 1 FROM listed WHERE listed.site = seed.site) AS expand FROM seed GROUP BY site),
 walk(site, n, budget, expand, queue, depths, i, taken, node, depth, kind) AS (
  SELECT site, n, budget, expand, queue, list_transform(queue, lambda x: 0), 1, 0, NULL::VARCHAR, NULL::INT, NULL::VARCHAR FROM start
  UNION ALL
  SELECT site, n, budget, expand, list_concat(queue, fresh), list_concat(depths, list_transform(fresh, lambda x: depths[i] + 1)), i + 1, taken + CASE kind WHEN 'other' THEN 0 ELSE 1 END, queue[i], depths[i], kind
  FROM (SELECT *, CASE WHEN expand AND kind = 'page' THEN list_filter(links, lambda x, j: NOT list_contains(queue, x) AND list_position(links, x) = j) ELSE [] END AS fresh
   FROM (SELECT w.site, w.n, w.budget, w.expand, w.queue, w.depths, w.i, w.taken, c.links, CASE WHEN {digit(7)} % 7 = 0 THEN 'other' WHEN c.error <> '' THEN 'failed' ELSE 'page' END AS kind
    FROM walk w JOIN content c ON c.site = w.site AND c.k = {digit(1)} % w.n WHERE w.i <= len(w.queue) AND (w.budget IS NULL OR w.taken < w.budget))))
SELECT {columns} FROM walk WHERE node IS NOT NULL"""


def _crawled(spark: SparkSession, sf_dir: str, budget: Column) -> DataFrame:
    hosts = _hosts(spark, sf_dir)
    listed = keep(_sitemaps(spark, sf_dir, hosts)[3], "listed")
    facts = keep(pages(spark, sf_dir).select("page_id", "url_host", "error", "links"), "facts")
    links = crawl.edges(facts).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("links"))
    # Never broadcast: lists of like addresses are packed so well that Spark, which goes by the size of files, takes them for small.
    content = keep(numbered_within(facts.select("page_id", "url_host", "error"), "url_host", [F.col("page_id")], "content", "k").join(links.hint("merge"), "page_id", "left"), "content")
    content = content.select(F.col("url_host").alias("of"), "k", F.col("error") != "", F.coalesce("links", F.array().cast("array<string>")).alias("links")).toDF("of", "k", "down", "links")
    sizes = keep(facts.groupBy(F.col("url_host").alias("host")).agg(F.count("*").alias("n")), "sizes")
    few = counted_small(sizes)

    def fetch(asked: DataFrame) -> DataFrame:
        digit = lambda at: F.conv(F.substring(F.md5("node"), at, 6), 16, 10).cast("long")
        at = asked.join(few(sizes), F.col("site") == F.col("host")).withColumn("which", digit(1) % F.col("n"))
        got = counted_small(asked)(at).join(content.hint("merge"), (F.col("site") == F.col("of")) & (F.col("which") == F.col("k")))
        kind = F.when(digit(7) % 7 == 0, crawl.OTHER).when(F.col("down"), crawl.FAILED).otherwise(crawl.PAGE)
        return got.select("site", "node", kind.alias("kind"), "links")

    # A site whose sitemap lists addresses is read by those alone.
    mapped = listed.select("site").distinct().withColumn("mapped", F.lit(True))
    audits = hosts.join(mapped, "site", "left").select("site", budget.alias("budget"), F.col("mapped").isNull().alias("expand"))
    return crawl.breadth_first(crawl.seeds(hosts, listed), fetch, audits)


@query("q_crawl_bfs", _crawl_sql("NULL::BIGINT", "site, node, depth, kind"))
def q_crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each host's links lead to."""
    return _crawled(spark, sf_dir, F.lit(None).cast("long")).select("site", "node", "depth", "kind")


_ASKED = "length(site) * 7 % 60"
_BUDGET_SQL = f"greatest(1, least({_ASKED}, CASE WHEN length(site) % 3 = 0 THEN {SETTINGS.max_pages_admin} ELSE {SETTINGS.max_pages} END))"


@query("q_crawl_budget", _crawl_sql(_BUDGET_SQL, "site, node, depth, kind, CASE WHEN kind <> 'other' THEN taken END AS place"))
def q_crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each host's audit visits under its own page budget, in the order of its queue."""
    return _crawled(spark, sf_dir, store.page_budget(F.expr(_ASKED), F.expr("length(site) % 3 = 0")))


_LITERALS = (
    "http://127.0.0.1:8000/", "http://localhost/", "https://192.168.1.1:22/", "http://169.254.169.254/x", "https://10.0.0.1", "file:///etc/passwd", "ftp://example.com/", "example.com", "https://8.8.8.8/",
    "https://example.com:6379/", "https://172.20.1.1/", "https://172.32.1.1/", "http://224.0.0.1/", "http://0.0.0.0/", "https://a.jp:443/x", "http://2130706433/", "http://127.1/", "http://127.0.0.1./",
    "http://198.18.0.1/", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://localhost./", "http://0x7f.0.0.1/", "http://0177.0.0.1/", "https://[2606:4700:4700::1111]/", "http://[2001:db8::1]/",
    "http://[fe80::1]:80/", "http://[2002:a00:1::]/", "http://u:p@[2606:4700::1]:6379/", "http://a.b.0x1f/", "http://user@10.0.0.1/", "http://192.0.2.7/", "http://203.0.113.9/", "http://a.localhost/", "http://[::]/",
    "http://127.0.0.①/", "http://127.0.0.¹/", "http://ｌｏｃａｌｈｏｓｔ/", "http://ⓛocalhost/", "http://loc\u00adalhost/", "http://127.0.0.1\\@example.com/", "http://127。0。0。1/", "https://日本語.jp/", "http://Éa.example/",
    "http://a_b.example/", "http://exa mple.com/", "http://a.example/x\\y", "http://ĳ.example/", "http://a\u200bb.example/", "http://10.0.0.1%2f.example/",
)
_ADDRESSES = "(" + "SELECT * FROM (VALUES " + ", ".join("('" + x.replace(chr(92), "' || chr(92) || '") + "')" for x in _LITERALS) + ") v(raw)"
_ADDRESSES += " UNION ALL SELECT 'http://' || (c_custkey * 37 % 256) || '.' || (c_custkey * 101 % 256) || '.' || (c_custkey % 256) || '.' || (c_nationkey + 1) || '/' FROM customer"
_ADDRESSES += " UNION ALL SELECT 'http://' || o_orderkey * 2861 || CASE WHEN o_custkey % 3 = 0 THEN '.1/' ELSE '.example:' || o_custkey || '/' END FROM orders)"
_SCHEMED = f"(SELECT raw, CASE WHEN regexp_matches(trim(raw), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN trim(raw) ELSE 'https://' || trim(raw) END AS url FROM {_ADDRESSES})"


@query("q_ssrf_literals", O.public(_SCHEMED)[1:-1])
def q_ssrf_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    u = U.with_scheme(D.name("raw"))
    return spark.sql(_ADDRESSES[1:-1]).select("raw", u.col.alias("url")).select("raw", "url", U.public_literal(D.name("url")).alias("accepted"))


@query(
    "q_validate_urls",
    f"""WITH h AS (SELECT DISTINCT {_HOST_SQL} AS site FROM pages), d AS (SELECT site, unnest(range(1 + length(site) % 3)) AS i FROM h),
 ips AS (SELECT site, 'http://' || (length(site) * 7 + i * 83) % 256 || '.' || (ascii(site) * 3 + i) % 256 || '.1.1/' AS url, '' AS raw FROM d WHERE NOT starts_with(site, 'm.')),
 ok AS (SELECT site, bool_and(accepted) AS public FROM (SELECT i.site, p.accepted FROM ips i JOIN {O.public('(SELECT DISTINCT raw, url FROM ips)')} p ON p.url = i.url) GROUP BY site)
SELECT site AS raw, 'https://' || site AS url, COALESCE(public, false) AS accepted FROM h LEFT JOIN ok USING (site)""",
)
def q_validate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _hosts(spark, sf_dir).select("site")
    ips = hosts.filter("NOT startswith(site, 'm.')").selectExpr("site AS host", "explode(sequence(0, length(site) % 3)) AS i")
    ips = ips.selectExpr("host", "concat((length(host) * 7 + i * 83) % 256, '.', (ascii(host) * 3 + i) % 256, '.1.1') AS ip")
    return safety.validate(hosts.select(F.col("site").alias("raw")), ips)


# --- whole audits: findings about pages and, after them, about their host; scores -----------------------

#: Order of the findings about a host.
_SITE_ORDER = ("crawl.robots.missing", "crawl.robots.disallow_all", "crawl.robots.no_sitemap", "crawl.sitemap.missing", "meta.title.duplicate", "meta.description.duplicate", "content.broken_link")
_WHOLE = f"""WITH {PAGES}, {_EDGES.replace('FROM pages_facts', "FROM pages_facts WHERE error = ''")}, {_BROKEN.replace('FROM pages_facts p WHERE', "FROM pages_facts p WHERE p.error = '' AND")}, {_SITEMAPS},
 ok AS MATERIALIZED (SELECT * FROM pages_facts WHERE error = ''),
 audits AS MATERIALIZED (SELECT url_host, COUNT(*) FILTER (error = '') AS pages, COUNT(*) AS page_count FROM pages_facts GROUP BY url_host),
 site_facts AS MATERIALIZED (SELECT r.site AS url_host, 'https://' || r.site AS base_url, r.body AS robots_txt, COALESCE(p.blocks_all, false) AS robots_blocks_all, COALESCE(p.sitemap, '') AS robots_sitemap,
   g.site IS NOT NULL AS sitemap_found, COALESCE(b.broken, '') AS broken FROM r LEFT JOIN p USING (site) LEFT JOIN got g USING (site) LEFT JOIN broken b USING (site)
   WHERE r.site IN (SELECT url_host FROM audits WHERE pages > 0)),
 about AS ({O.findings('site_facts', 'url_host, base_url', O.SITE_RULES)} UNION ALL
   {" UNION ALL ".join(f"SELECT site, first_url, 0, '{r}', 'meta', 'warning', {_EVIDENCE} FROM ({_dup_sql(v, 'ok')})" for v, r in _SHARED)}),
 found AS MATERIALIZED (SELECT 0 AS part, url_host, page_id, url, rule_ord, rule, category, severity, evidence FROM ({O.findings('ok', 'url_host, page_id, url', O.PAGE_RULES)})
   UNION ALL SELECT 1, url_host, NULL, base_url, list_position({list(_SITE_ORDER)}, rule) - 1, rule, category, severity, evidence FROM about)"""
_TIES = ["part", "page_id", "rule_ord", "url", "evidence"]
_CATS = f"""cats AS (SELECT * FROM (VALUES {O.CATEGORIES}) v(place, category, label)), points AS (SELECT url_host, category, SUM({O.WEIGHT}) AS p FROM found GROUP BY ALL),
 scores AS (SELECT a.url_host, c.place, c.category, c.label, {O.SCORE.format('p.p', 'a.pages')} AS score FROM audits a CROSS JOIN cats c LEFT JOIN points p ON p.url_host = a.url_host AND p.category = c.category WHERE a.pages > 0)"""
_OVERALL = f"""overall AS (SELECT a.url_host, {O.SCORE.format(f'SUM({O.WEIGHT})', 'any_value(a.pages)')} AS overall, COUNT(*) FILTER (severity = 'critical') AS critical,
   COUNT(*) FILTER (severity = 'warning') AS warning, COUNT(*) FILTER (severity = 'info') AS info, COUNT(severity) AS total, any_value(a.pages) AS pages
 FROM audits a LEFT JOIN found f ON f.url_host = a.url_host WHERE a.pages > 0 GROUP BY a.url_host)"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_TIES_SQL = "part, page_id NULLS FIRST, rule_ord, url, evidence"
_ORDERED = f"ordered AS (SELECT *, row_number() OVER (PARTITION BY url_host ORDER BY {_RANK}, category, rule, {_TIES_SQL}) AS number FROM found)"
_TOP = f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_host ORDER BY {_RANK}, {_TIES_SQL}) AS number FROM found) WHERE number <= {SETTINGS.prompt_findings})"


class Audits:
    """Audits of the hosts of `pages`; each table is written when it is first asked for, and once.

    facts: of all pages; audits: pages (read without an error, what scores divide by) and page_count of each host;
    sites: facts of hosts; findings: of pages and hosts."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def facts(self) -> DataFrame:
        return keep(pages(self.spark, self.sf_dir), "facts")

    @cached_property
    def read(self) -> DataFrame:
        return self.facts.filter("error = ''")

    @cached_property
    def audits(self) -> DataFrame:
        return keep(self._counted(self.facts), "audits")

    @staticmethod
    def _counted(facts: DataFrame) -> DataFrame:
        return facts.groupBy("url_host").agg(F.count_if(F.col("error") == "").alias("pages"), F.count("*").alias("page_count"))

    @cached_property
    def outcomes(self) -> DataFrame:
        """audits, without the parser: hosts and errors are known before it."""
        fetched = mutated(self.spark, self.sf_dir).select(U.host(D.name("url")).col.alias("url_host"), "error")
        return self._counted(fetched)

    @property
    def scored(self) -> DataFrame:
        """Audits with a page; one whose pages all failed has no score."""
        return self.audits.filter("pages > 0")

    @cached_property
    def sites(self) -> DataFrame:
        hosts = self.scored.select(F.col("url_host").alias("site"), F.concat(F.lit("https://"), "url_host").alias("base_url"))
        bodies, parsed, first, _ = _sitemaps(self.spark, self.sf_dir, hosts)
        return keep(site.facts(hosts, bodies, parsed, first, _broken(self.read)), "sites")

    @cached_property
    def findings(self) -> DataFrame:
        every = rules.findings(self.read, _KEYS).select(F.lit(0).alias("part"), "*")
        place = F.array_position(F.array(*[F.lit(r) for r in _SITE_ORDER]), F.col("rule")) - 1
        columns = [F.lit(1).alias("part"), F.col("site").alias("url_host"), F.lit(None).cast("long").alias("page_id")]
        about = rules.findings(self.sites, ["site", "base_url"], site.SITE_RULES).withColumnRenamed("base_url", "url").drop("rule_ord")
        for value, rule in _SHARED:
            about = about.unionByName(site.duplicate_findings(site.duplicates(self.read, "url_host", value, "url", "page_id"), rule).drop("first_seq"))
        every = every.unionByName(about.select(*columns, "url", place.cast("int").alias("rule_ord"), "rule", "category", "severity", "evidence"))
        return keep(every, "findings")


def audited(spark: SparkSession, sf_dir: str) -> Audits:
    """An audit is a host of `pages`."""
    return Audits(spark, sf_dir)


@query("q_rules_site", f"{_WHOLE} SELECT url_host AS site, rule, category, severity, evidence FROM about WHERE rule NOT LIKE '%.duplicate'")
def q_rules_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.findings(audited(spark, sf_dir).sites, ["site"], site.SITE_RULES).drop("rule_ord")


@query("q_site_summary", f"{_WHOLE} SELECT f.url_host AS site, robots_txt IS NOT NULL AS has_robots, robots_blocks_all, sitemap_found, COALESCE(b.n, 0)::BIGINT AS broken_count, f.broken FROM site_facts f LEFT JOIN broken b ON b.site = f.url_host")
def q_site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).sites.select("site", F.col("robots_txt").isNotNull().alias("has_robots"), "robots_blocks_all", "sitemap_found", "broken_count", "broken")


@query("q_findings_all", f"{_WHOLE} SELECT url_host, page_id, url, rule_ord, rule, category, severity, evidence FROM found")
def q_findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).findings.drop("part")


@query("q_score_category", f"{_WHOLE}, {_CATS} SELECT url_host, category, label, score FROM scores")
def q_score_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audited(spark, sf_dir)
    return scoring.category_scores(a.findings, a.scored, ["url_host"])


@query("q_score_overall", f"{_WHOLE}, {_OVERALL} SELECT * FROM overall")
def q_score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audited(spark, sf_dir)
    return scoring.overall_scores(a.findings, a.scored, ["url_host"])


@query("q_audit_status", f"{_WHOLE} SELECT url_host, page_count, pages, CASE WHEN pages = 0 THEN 'failed' ELSE 'done' END AS status FROM audits")
def q_audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).outcomes.select("url_host", "page_count", "pages", F.when(F.col("pages") == 0, "failed").otherwise("done").alias("status"))


@query("q_severity_counts", f"{_WHOLE} SELECT severity, CASE severity WHEN 'critical' THEN 'Critical' WHEN 'warning' THEN 'Warning' ELSE 'Info' END AS label, category, COUNT(*) AS n FROM found GROUP BY ALL")
def q_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = audited(spark, sf_dir).findings.groupBy("severity", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("label", scoring.severity_label(F.col("severity")))


@query("q_verdict_bands", f"{_WHOLE}, {_OVERALL} SELECT url_host, overall, {O.VERDICT.format('overall')} AS verdict, CASE WHEN overall >= 90 THEN 'good' WHEN overall >= 70 THEN 'mid' ELSE 'bad' END AS band FROM overall")
def q_verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = q_score_overall(spark, sf_dir)
    return o.select("url_host", "overall", scoring.verdict(F.col("overall")).alias("verdict"), scoring.score_class(F.col("overall")).alias("band"))


@query("q_findings_ordered", f"{_WHOLE}, {_ORDERED} SELECT url_host, number, page_id, rule, severity FROM ordered")
def q_findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ordered(audited(spark, sf_dir).findings, ["url_host"], _TIES).select("url_host", "number", "page_id", "rule", "severity")


@query("q_top_findings", f"{_WHOLE}, {_TOP} SELECT url_host, number, page_id, rule, severity FROM top")
def q_top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top(audited(spark, sf_dir).findings, ["url_host"], _TIES).select("url_host", "number", "page_id", "rule", "severity")


# --- store -----------------------------------------------------------------------------------

_AUDIT_LOG = "(SELECT o_custkey AS site_id, o_orderkey AS audit_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS created_at, o_totalprice AS total FROM orders)"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS site_id", "o_orderkey AS audit_id", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status", "o_orderdate AS created_at", "o_totalprice AS total")


@query(
    "q_latest_done_audit",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, audit_id DESC) AS r FROM {_AUDIT_LOG}),
 d AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, audit_id DESC) AS r2 FROM h WHERE r <= 50 AND status = 'done')
SELECT site_id, audit_id, total FROM d WHERE r2 = 1""",
)
def q_latest_done_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_done(audit_log(spark, sf_dir), "site_id", "audit_id", "status", "created_at").select("site_id", "audit_id", "total")


@query(
    "q_sites_with_latest",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, audit_id DESC) AS r FROM {_AUDIT_LOG} WHERE status = 'done')
SELECT c_custkey AS site_id, c_name AS name, audit_id AS latest_audit, total AS latest_total FROM customer LEFT JOIN h ON site_id = c_custkey AND r = 1""",
)
def q_sites_with_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = store.latest_done(audit_log(spark, sf_dir), "site_id", "audit_id", "status", "created_at")
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS site_id", "c_name AS name")
    return sites.join(last, "site_id", "left").select("site_id", "name", F.col("audit_id").alias("latest_audit"), F.col("total").alias("latest_total"))


@query("q_site_list", "SELECT c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS place FROM customer WHERE c_nationkey = 7")
def q_site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one owner, the newest first (the balance stands for the time)."""
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "CAST(c_nationkey AS STRING) AS owner", "c_acctbal AS created_at")
    return store.listed(sites, "7").select("id", "name", F.col("place").cast("long").alias("place"))


@query("q_audit_history", f"SELECT site_id, audit_id, number FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, audit_id DESC) AS number FROM {_AUDIT_LOG}) WHERE number <= 5")
def q_audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(audit_log(spark, sf_dir), ["site_id"], [F.col("created_at").desc(), F.col("audit_id").desc()], 5).select("site_id", "audit_id", F.col("rank").alias("number"))


_USAGE = "SELECT user_id AS owner, event_type AS kind, date_trunc('month', ts)::DATE AS month, COUNT(*) AS used FROM events GROUP BY ALL"
_LIMITS = {"view": SETTINGS.free_audits, "click": SETTINGS.free_advice}


@query("q_usage_month", _USAGE)
def q_usage_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.usage_by_month(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


@query("q_quota_exceeded", f"SELECT owner, kind, month, used, lim AS \"limit\", COALESCE(used >= lim, false) AS exceeded FROM (SELECT *, CASE kind WHEN 'view' THEN {SETTINGS.free_audits} WHEN 'click' THEN {SETTINGS.free_advice} END AS lim FROM ({_USAGE}))")
def q_quota_exceeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.over_quota(q_usage_month(spark, sf_dir), _LIMITS)


#: Requests: an event asks at its time, runs for a while told by its id, and every fifth fails.
_REQUESTS = 'event_id AS id, user_id::VARCHAR AS owner, event_type AS kind, ts AS start, CASE WHEN event_id % 5 <> 0 THEN ts + to_hours(event_id * 37 % 120) END AS "end"'
_QUOTA = {"view": SETTINGS.free_audits, "click": SETTINGS.free_advice, "purchase": 1}
_LIMIT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in _QUOTA.items()) + " END"
_ADMIT = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, {_LIMIT_SQL} AS lim, row_number() OVER (PARTITION BY owner, kind ORDER BY start, id) AS i FROM (SELECT {_REQUESTS} FROM events)),
 walk(id, owner, kind, i, used, accepted) AS (
  SELECT NULL::BIGINT, owner, kind, 0::BIGINT, []::TIMESTAMP[], false FROM (SELECT DISTINCT owner, kind FROM e)
  UNION ALL
  SELECT id, owner, kind, i, CASE WHEN ok AND "end" IS NOT NULL THEN list_append(used, "end") ELSE used END, ok FROM (
   SELECT e.*, w.used, e.lim IS NULL OR e.owner IN ('7', '13') OR len(list_filter(w.used, lambda x: x <= e.start AND date_trunc('month', x) = date_trunc('month', e.start))) < e.lim AS ok
   FROM walk w JOIN e ON e.owner = w.owner AND e.kind = w.kind AND e.i = w.i + 1))
"""


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = "CASE WHEN event_id % 5 <> 0 THEN ts + make_interval(0, 0, 0, 0, CAST(event_id * 37 % 120 AS INT)) END"
    asked = table(spark, sf_dir, "events").selectExpr("event_id AS id", "CAST(user_id AS STRING) AS owner", "event_type AS kind", "ts AS start", f"{end} AS end")
    return admission.admit(asked, _QUOTA, _ADMINS)


@query("q_admission", _ADMIT + "SELECT id, owner, kind, accepted FROM walk WHERE i > 0")
def q_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a monthly quota lets through; the SQL takes them one by one."""
    return _admitted(spark, sf_dir).select("id", "owner", "kind", "accepted")


@query("q_admission_usage", _ADMIT + """SELECT w.owner, w.kind, date_trunc('month', "end")::DATE AS month, COUNT(*) AS used FROM walk w JOIN e USING (id) WHERE w.i > 0 AND w.accepted AND "end" IS NOT NULL GROUP BY ALL""")
def q_admission_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the admitted requests use, appended to the store and counted from it."""
    to = _archive(spark)
    to.append(admission.usage(_admitted(spark, sf_dir)), "usage")
    return store.usage_by_month(to.read("usage"), "owner", "kind", "created_at")


@query("q_usage_stream", "SELECT user_id::VARCHAR AS owner, event_type AS kind, date_trunc('month', ts)::DATE AS month, COUNT(*) AS used FROM events GROUP BY ALL")
def q_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly usage from a stream that gets the events in no order, in several files, a tenth of them twice."""
    landing, sink, state = (new_path(spark, f"usage-{n}") for n in ("landing", "sink", "state"))
    events = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", "CAST(user_id AS STRING) AS owner", "event_type AS kind", "ts AS at")
    twice = events.unionByName(events.filter("xxhash64(id) % 10 = 0")).withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(4)))
    twice.repartition("part").drop("part").write.parquet(landing)
    usage.count_usage(spark, landing, sink, state, late="1000 days", files=2).awaitTermination()
    return usage.usage_counts(spark, sink)


@query("q_site_counts", "SELECT c_mktsegment AS owner, COUNT(*) AS sites FROM customer GROUP BY 1")
def q_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("owner")).agg(F.count("*").alias("sites"))


def _archive(spark: SparkSession) -> archive.Archive:
    return archive.Archive(spark, new_path(spark, "archive"), period="yyyy")


def _ids(to: archive.Archive):  # noqa: ANN202
    """Ids of rows with a site's and an audit's number."""
    site_ = to.issued(F.col("site"))
    return site_, to.issued(F.col("audit"), site_)


def _stored(spark: SparkSession, sf_dir: str) -> archive.Archive:
    """A store: customers are sites, orders their audits, line items findings; every fourth audit has advice."""
    to = _archive(spark)
    site_, audit = _ids(to)
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS site", "c_name AS name", "CAST(c_nationkey AS STRING) AS owner", "TIMESTAMP'2024-01-01' AS created_at")
    to.append(sites.withColumn("id", site_), "sites")
    audits = table(spark, sf_dir, "orders").selectExpr("o_custkey AS site", "o_orderkey AS audit", "o_orderpriority AS owner", "o_orderdate AS created_at")
    to.start(audits.select(audit.alias("id"), site_.alias("site_id"), "owner", "created_at"))
    found = table(spark, sf_dir, "lineitem").join(audits.selectExpr("audit AS l_orderkey", "site"), "l_orderkey").withColumnRenamed("l_orderkey", "audit")
    to.append(found.select(audit.alias("audit_id"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("r"), "l_suppkey").alias("rule")), "findings")
    told = audits.filter("audit % 4 = 0").select(audit.alias("audit_id"), "owner", F.col("audit").cast("string").alias("body"), "created_at")
    to.append(told, "advice", provider="local")
    return to


@query(
    "q_cascade_delete",
    "WITH a AS (SELECT * FROM orders WHERE o_custkey % 10 <> 3) SELECT 'sites' AS name, COUNT(*) AS rows_left FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'audits', COUNT(*) FROM a UNION ALL SELECT 'statuses', COUNT(*) FROM a"
    " UNION ALL SELECT 'advice', COUNT(*) FROM a WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'findings', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)",
)
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the sites is deleted from a store, which is then read again."""
    to = _stored(spark, sf_dir)
    to.delete_sites(table(spark, sf_dir, "customer").filter("c_custkey % 10 = 3").selectExpr("c_custkey AS site").select(to.issued(F.col("site")).alias("id")))
    one = [to.read(n).agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("name"), "rows_left") for n in ("sites", "audits", "statuses", "advice", "findings")]
    return reduce(DataFrame.unionByName, one)


@query(
    "q_store_lookup",
    """WITH s AS (SELECT MAX(o_custkey) AS site FROM orders), a AS (SELECT o_orderkey FROM orders, s WHERE o_custkey = site AND o_orderdate >= DATE '1995-01-01')
SELECT 'site' AS kind, c_custkey AS number, c_name AS name FROM customer, s WHERE c_custkey = site UNION ALL SELECT 'audit', o_orderkey, NULL FROM a
UNION ALL SELECT 'finding', l_orderkey, l_linenumber::VARCHAR FROM lineitem JOIN a ON l_orderkey = o_orderkey UNION ALL SELECT 'advice', o_orderkey, o_orderkey::VARCHAR FROM a WHERE o_orderkey % 4 = 0""",
)
def q_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site by its id, its audits since a month, and what belongs to them."""
    to = _stored(spark, sf_dir)
    id_ = table(spark, sf_dir, "orders").agg(F.max("o_custkey").alias("site")).select(to.issued(F.col("site"))).first()[0]
    audits = to.audits_of(id_, "1995")
    number = lambda c: to.number_of(F.col(c)).alias("number")
    found = [to.get("sites", id_).select(F.lit("site").alias("kind"), number("id"), "name"), audits.select(F.lit("audit"), number("id"), F.lit(None).cast("string"))]
    for kind, name, told in (("findings", "finding", "seq"), ("advice", "advice", "body")):
        found.append(to.children_of(kind, audits).select(F.lit(name), number("audit_id"), F.col(told).cast("string")))
    return reduce(DataFrame.union, found)


_DOC_ID = "strftime(o_orderdate, '%Y%m%d-%H%M%S-') || CASE WHEN o_orderkey % 3 = 0 THEN 'XYZ' ELSE substring(md5(o_orderkey::VARCHAR), 1, 8) END"


@query("q_retention_newest_n", f"SELECT id, o_custkey AS site_id, o_totalprice AS total FROM (SELECT *, {_DOC_ID} AS id FROM orders ORDER BY id DESC LIMIT {SETTINGS.documents_kept}) WHERE NOT ends_with(id, 'XYZ') ORDER BY id DESC LIMIT 20")
def q_retention_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as JSON, of which the newest are kept, and the list of them is read back."""
    path = new_path(spark, "documents")
    rows = table(spark, sf_dir, "orders").select(_document_id().alias("id"), F.col("o_custkey").alias("site_id"), F.col("o_totalprice").alias("total"))
    store.write_documents(rows, path)
    return store.read_documents(spark, path, "id string, site_id bigint, total double")


@query(
    "q_documents",
    f"""SELECT id, CASE WHEN ok THEN o_custkey END AS site_id, CASE WHEN ok THEN o_totalprice::DOUBLE END AS total, ok AS readable
 FROM (SELECT *, {_DOC_ID} AS id, o_orderkey % 7 <> 0 AS ok FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY id DESC LIMIT 20)""",
)
def q_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents saved as a file each in two batches, some of them broken, and the list that is read back."""
    path = new_path(spark, "documents")
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", _document_id().alias("id"), F.col("o_custkey").alias("site_id"), F.col("o_totalprice").cast("double").alias("total"))
    told = F.when(F.col("o_orderkey") % 7 == 0, '{"total": ').otherwise(F.to_json(F.struct("site_id", "total")))
    for half in (0, 1):
        documents.save(rows.filter(F.col("o_orderkey") % 2 == half).select("id", told.alias("body")), path, body="body")
    found = documents.listed(spark, path, "site_id bigint, total double")
    return found.select("id", "site_id", "total", F.col("_corrupt").isNull().alias("readable"))


def _document_id():  # noqa: ANN202
    tail = F.when(F.col("o_orderkey") % 3 == 0, "XYZ").otherwise(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 8))
    return F.concat(F.date_format("o_orderdate", "yyyyMMdd-HHmmss-"), tail)


@query(
    "q_status_log",
    "SELECT o_orderkey AS audit_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CASE WHEN o_orderstatus = 'F' THEN (floor(o_totalprice) % 100)::INT END AS overall,"
    " CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN substring(repeat('no answer ', 60), 1, 500) END AS error, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 END AS critical FROM orders",
)
def q_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits are started, then finished or failed by appended rows; the newest row of each counts."""
    to = _archive(spark)
    site_, audit = _ids(to)
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS site", "o_orderkey AS audit", "o_orderpriority AS owner", "o_orderdate AS created_at", "o_orderstatus", "o_totalprice")
    rows = rows.withColumn("id", audit)
    later = rows.selectExpr("id AS audit_id", "o_orderstatus", "o_totalprice", "audit", "created_at + INTERVAL 1 MINUTE AS at")
    to.start(rows.select("id", site_.alias("site_id"), "owner", "created_at"))
    to.finish(later.filter("o_orderstatus = 'F'").selectExpr("audit_id", "CAST(floor(o_totalprice) % 100 AS INT) AS overall", "1 AS page_count", "named_struct('critical', audit % 5) AS counts", "at"))
    to.fail(later.filter("o_orderstatus NOT IN ('F', 'O')").selectExpr("audit_id", "repeat('no answer ', 60) AS error", "at"))
    counts = F.from_json("counts", "critical bigint")
    last = store.current_status(to.read("statuses"))
    return last.select(to.number_of(F.col("audit_id")).alias("audit_id"), "status", "overall", "error", counts["critical"].alias("critical"))


_FOUND = "l_orderkey AS audit_id, l_linenumber AS seq, 'r' || l_suppkey AS rule, l_linestatus AS category, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity, CAST(l_partkey AS STRING) AS evidence"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = audit_log(spark, sf_dir).withColumnRenamed("audit_id", "id").select("id", "site_id")
    return store.nested_audits(audits, table(spark, sf_dir, "lineitem").selectExpr(*_FOUND.split(", ")))


@query(
    "q_audit_nested",
    f"""WITH f AS (SELECT {_FOUND} FROM lineitem), n AS (SELECT audit_id, COUNT(*) AS n, string_agg(severity || '/' || rule || '/' || evidence, ';' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, category, rule, seq, evidence) AS findings FROM f GROUP BY audit_id)
SELECT o_orderkey AS id, COALESCE(n, 0)::INT AS n, COALESCE(findings, '') AS findings FROM orders LEFT JOIN n ON audit_id = o_orderkey""",
)
def q_audit_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.transform("findings", lambda f: F.concat_ws("/", f["severity"], f["rule"], f["evidence"]))
    return _nested(spark, sf_dir).select("id", F.size("findings").alias("n"), F.array_join(told, ";").alias("findings"))


@query("q_lite_mask", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN COALESCE(n, 0) ELSE 0 END::INT AS n FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def q_lite_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.mask_lite(_nested(spark, sf_dir), F.col("site_id") % 4 != 0).select("id", F.size("findings").alias("n"))


@query(
    "q_audit_view",
    "WITH a AS (SELECT user_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)"
    " SELECT o_orderkey AS id, c_name AS site_name, 'https://' || c_custkey AS site_url, props AS advice, event_type AS advice_model FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN a ON user_id = o_orderkey AND r = 1",
)
def q_audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits = audit_log(spark, sf_dir).selectExpr("audit_id AS id", "site_id")
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "concat('https://', c_custkey) AS url")
    advice = table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id AS audit_id", "props AS body", "event_type AS model", "ts AS created_at")
    return store.audit_view(audits, sites, advice).select("id", "site_name", "site_url", "advice", "advice_model")


_ADMINS = ("7", "13")


@query(
    "q_usage_status",
    f"""WITH o AS (SELECT DISTINCT user_id::VARCHAR AS owner FROM events), u AS (SELECT user_id::VARCHAR AS owner, COUNT(*) FILTER (event_type = 'view') AS a, COUNT(*) FILTER (event_type = 'click') AS b FROM events WHERE year(ts) = 2024 AND month(ts) = 1 GROUP BY 1),
 s AS (SELECT (c_custkey % 50)::VARCHAR AS owner, COUNT(*) AS sites FROM customer GROUP BY 1)
SELECT owner, CASE WHEN owner IN ('7', '13') THEN 'admin' ELSE 'free' END AS plan, COALESCE(a, 0) AS audits_used, CASE WHEN owner NOT IN ('7', '13') THEN {SETTINGS.free_audits} END AS audits_limit, COALESCE(b, 0) AS advice_used,
 CASE WHEN owner NOT IN ('7', '13') THEN {SETTINGS.free_advice} END AS advice_limit, COALESCE(sites, 0) AS sites, {SETTINGS.sites} AS sites_limit FROM o LEFT JOIN u USING (owner) LEFT JOIN s USING (owner)""",
)
def q_usage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS owner", "CASE event_type WHEN 'view' THEN 'audit' WHEN 'click' THEN 'advice' ELSE event_type END AS kind", "ts")
    usage = store.usage_by_month(events, "owner", "kind", "ts").filter("month = DATE'2024-01-01'")
    sites = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey % 50 AS STRING) AS owner")
    return store.usage_status(events.select("owner").distinct(), usage, sites, _ADMINS)


@query("q_visible_sites", "SELECT s_suppkey AS viewer, c_custkey AS id FROM supplier JOIN customer ON s_nationkey = c_nationkey OR s_nationkey = 7 WHERE s_suppkey % 5 = 2")
def q_visible_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites that each of some viewers sees: own ones, or all for an admin (nation 7)."""
    sites = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CAST(c_nationkey AS STRING) AS owner")
    own = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 2").selectExpr("s_suppkey AS viewer", "CAST(s_nationkey AS STRING) AS me")
    seen = store.visible_to(sites, own, "me", ("7",))
    return seen.select("viewer", "id")


_PATHS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '/health' WHEN 1 THEN '/api/usage' WHEN 2 THEN '/api/sites' WHEN 3 THEN '/api/sites/' || h WHEN 4 THEN '/api/sites/' || h || '/audits' WHEN 5 THEN '/api/audits/' || h
 WHEN 6 THEN '/api/audits/' || h || '/advice' WHEN 7 THEN '/api/audits/' || h || '/report.md' ELSE '/api/admin' END || CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE '' END AS path,
 CASE o_custkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'PUT' END AS method FROM (SELECT *, substring(md5(CAST(o_orderkey AS STRING)), 1, 16) AS h FROM orders)"""


@query(
    "q_routes",
    f"""SELECT id, CASE WHEN path IN ('/health', '/api/usage') THEN method = 'GET' WHEN path = '/api/sites' THEN method = 'GET' OR method = 'POST' WHEN len(p) = 4 AND p[3] = 'sites' AND length(p[4]) = 16 AND p[4] NOT LIKE '%x%' THEN method = 'DELETE'
 WHEN len(p) = 5 AND p[3] = 'sites' AND p[5] = 'audits' THEN method IN ('GET', 'POST') WHEN len(p) = 4 AND p[3] = 'audits' AND length(p[4]) = 16 THEN method = 'GET' WHEN len(p) = 5 AND p[5] = 'advice' THEN method = 'POST'
 WHEN len(p) = 5 AND p[5] = 'report.md' THEN method = 'GET' ELSE false END AS allowed FROM (SELECT *, string_split(path, '/') AS p FROM ({_PATHS}))""",
)
def q_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_PATHS).select("id", store.route_allowed(F.col("path"), F.col("method")).alias("allowed"))


@query(
    "q_plans",
    f"SELECT c_custkey AS id, CASE WHEN c_nationkey IN (7, 13) OR c_custkey % 2 = 1 THEN 'local' ELSE 'paid' END AS provider, greatest(1, least(c_custkey % 70, CASE WHEN c_nationkey IN (7, 13) THEN {SETTINGS.max_pages_admin} ELSE {SETTINGS.max_pages} END)) AS budget FROM customer",
)
def q_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.concat(F.lit(" @"), F.col("c_nationkey").cast("string"))
    provider = store.provider(owner, _ADMINS, F.col("c_custkey") % 2 == 0)
    budget = store.page_budget(F.col("c_custkey") % 70, store.is_admin(owner, _ADMINS))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), provider.alias("provider"), budget.alias("budget"))


@query(
    "q_key_file",
    "SELECT trim(trim(trim(split_part(v, '=', 2)), chr(34)), chr(39)) AS value FROM (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN '# ' || p_brand || '=none' WHEN p_partkey % 3 = 1 THEN p_brand ELSE '  ' || p_brand || ' = \"' || p_type || '\" ' END AS v FROM part)"
    " WHERE NOT starts_with(trim(v), '#') AND contains(v, '=') AND trim(split_part(v, '=', 1)) = 'Brand#13' ORDER BY pos LIMIT 1",
)
def q_key_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "CASE WHEN p_partkey % 3 = 0 THEN concat('# ', p_brand, '=none') WHEN p_partkey % 3 = 1 THEN p_brand ELSE concat('  ', p_brand, ' = \"', p_type, '\" ') END"
    return store.key_value(table(spark, sf_dir, "part").selectExpr("p_partkey AS pos", f"{line} AS value"), "Brand#13")


_TIMES = "SELECT CAST(o_orderdate AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN 'Z' ELSE '' END AS raw FROM orders UNION ALL SELECT * FROM (VALUES ('2024-01-31T15:00:00+00:00'), ('2024-02-29T23:59:59'), ('soon'), (NULL), ('2023-12-31T14:59:00Z')) v(raw)"


@query("q_jst_format", f"SELECT raw, CASE WHEN raw IS NULL THEN '-' ELSE COALESCE(strftime(TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC' + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M JST'), raw) END AS jst FROM ({_TIMES})")
def q_jst_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_TIMES).select("raw", store.to_jst(F.col("raw")).alias("jst"))


_NAMES = "SELECT CASE c_custkey % 3 WHEN 0 THEN ' @' WHEN 1 THEN '@@' ELSE '' END || c_name || CASE c_custkey % 2 WHEN 0 THEN '@ ' ELSE '' END AS raw FROM customer UNION ALL SELECT * FROM (VALUES (' @Taro '), ('@@JIRO'), ('hana@ko'), (''), ('@')) v(raw)"


@query("q_username_norm", f"SELECT raw, {T.username(D.name('raw')).sql} AS name FROM ({_NAMES})")
def q_username_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_NAMES).select("raw", T.username(D.name("raw")).col.alias("name"))


_WIDTHS = "SELECT CAST(doc_id AS STRING) AS name, COALESCE(text, '') AS raw FROM documents UNION ALL SELECT raw, raw FROM (VALUES ('ＡＢＣＤＥ'), ('abcdefghij'), ('AI活用'), (''), ('ｱｲｳ é①'), ('𠮷野家 — …')) v(raw)"


@query("q_width_cases", f"SELECT name, {T.visible_length(D.name('raw')).sql} AS width, {T.has_japanese(D.name('raw')).sql} AS ja FROM ({_WIDTHS})")
def q_width_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.name("raw")
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_WIDTHS).select("name", T.visible_length(r).col.alias("width"), T.has_japanese(r).col.alias("ja"))


@query("q_audit_id_format", f"SELECT o_orderkey AS id, length(raw) = 24 AND substring(raw, 9, 1) = '-' AND substring(raw, 16, 1) = '-' AND NOT contains(raw, 'X') AS valid FROM (SELECT o_orderkey, {_DOC_ID} AS raw FROM orders)")
def q_audit_id_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _document_id().rlike(store.AUDIT_ID).alias("valid"))


# --- reports ---------------------------------------------------------------------------------

_LINES = (
    "SELECT url_host, string_agg(line, chr(10) ORDER BY section, place) AS body FROM lines GROUP BY url_host"
)
_HEAD = f"{_WHOLE}, {_OVERALL}, {_CATS}, {_ORDERED}, {_TOP}, advised AS ({M.advice_sql()}), seqs AS (SELECT url_host, url, title_width, text_length, row_number() OVER (PARTITION BY url_host ORDER BY page_id) AS seq, error FROM pages_facts WHERE url_host IN (SELECT url_host FROM overall))"
_NL = "chr(10)"
_MARKDOWN = f"""{_HEAD}, lines AS (
 SELECT url_host, 0 AS section, 0 AS place, '# Audit of ' || url_host || {_NL} || {_NL} || '- Pages: ' || pages || {_NL} || '- Score: **' || overall || '** / 100' || {_NL} || {_NL} || {O.VERDICT.format('overall')} || {_NL} AS line FROM overall
 UNION ALL SELECT url_host, 1, 0, '## Findings by severity' || {_NL} || {_NL} || '- Critical: ' || critical || {_NL} || '- Warning: ' || warning || {_NL} || '- Info: ' || info || {_NL} FROM overall
 UNION ALL SELECT url_host, 2, 0, '## Scores by category' || {_NL} FROM overall
 UNION ALL SELECT url_host, 3, place, '- ' || label || ': ' || score FROM scores
 UNION ALL SELECT url_host, 4, number, CASE WHEN number = 1 THEN {_NL} || '## Findings' || {_NL} || {_NL} ELSE '' END || '### ' || number || '. [' || severity || '] ' || rule || {_NL} || {_NL} || '- Page: ' || url || {_NL} || '- Measured: ' || evidence || {_NL} FROM ordered
 UNION ALL SELECT url_host, 5, seq, '### ' || url || {_NL} || {_NL} || '- Title: ' || title_width || ' cells' || {_NL} || '- Text: ' || text_length || ' characters' || {_NL} FROM seqs WHERE error = ''
 UNION ALL SELECT o.url_host, 6, 0, '## Advice' || {_NL} || {_NL} || body || {_NL} FROM overall o JOIN advised USING (url_host)
 UNION ALL SELECT url_host, 7, 0, '---' || {_NL} || {_NL} || 'Every finding is a measured value; nothing is guessed.' FROM overall) {_LINES}"""
_PROMPT = f"""{_HEAD}, lines AS (
 SELECT url_host, 0 AS section, 0 AS place, 'Site: ' || url_host || {_NL} || 'Score: ' || overall || ' / pages: ' || pages || {_NL} || {_NL} || 'Scores:' AS line FROM overall
 UNION ALL SELECT url_host, 1, place, '- ' || label || ': ' || score FROM scores
 UNION ALL SELECT url_host, 2, 0, {_NL} || 'Findings:' FROM overall
 UNION ALL SELECT url_host, 3, number, '- [' || severity || '] ' || rule || ' / ' || substring(evidence, 1, {SETTINGS.evidence_chars}) FROM top
 UNION ALL SELECT url_host, 4, 0, {_NL} || 'Pages:' FROM overall
 UNION ALL SELECT url_host, 5, seq, '- ' || url || ' (' || title_width || ' cells, ' || text_length || ' characters)' FROM seqs WHERE seq <= {SETTINGS.prompt_pages} AND error = '') {_LINES}"""


def _report_parts(a: Audits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audits, categories, pages) as reports read them; each is read several times."""
    o = scoring.overall_scores(a.findings, a.scored, ["url_host"])
    heads = o.select("url_host", F.col("url_host").alias("name"), "overall", F.col("pages").alias("page_count"), "critical", "warning", "info", scoring.verdict(F.col("overall")).alias("verdict"))
    places = F.element_at(F.create_map(*[F.lit(x) for i, (c, _) in enumerate(CATEGORIES) for x in (c, i)]), F.col("category"))
    cats = scoring.category_scores(a.findings, a.scored, ["url_host"]).withColumn("place", places)
    seq = F.row_number().over(Window.partitionBy("url_host").orderBy("page_id"))
    own = a.facts.select("url_host", "url", "title_width", "text_length", seq.alias("seq"), "error").join(a.scored.select("url_host"), "url_host", "left_semi")
    return keep(heads, "heads"), cats, own


@query("q_report_markdown", _MARKDOWN)
def q_report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audited(spark, sf_dir)
    heads, cats, own = _report_parts(a)
    advice = store.latest_advice(M.advice(spark, heads)).select(F.col("audit_id").alias("url_host"), "body")
    return report.markdown(heads, cats, report.ordered(a.findings, ["url_host"], _TIES), own, "url_host", advice)


@query("q_prompt_text", _PROMPT)
def q_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audited(spark, sf_dir)
    heads, cats, own = _report_parts(a)
    return report.prompt(heads, cats, report.top(a.findings, ["url_host"], _TIES), own, "url_host")


# --- differences and documents ---------------------------------------------------------------


@query("q_impl_diff", f"WITH {PAGES} SELECT 'rows' AS side, COUNT(*) AS n FROM pages_facts")
def q_impl_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser against the expressions: rows that differ (expected none) and the count of rows."""
    names = ["page_id", "title", "description", "viewport", "charset", "canonical", "h1_count", "text_length", "images_total", "images_without_alt", "link_count", "internal_link_count", "blocking_scripts", "jsonld_invalid"]
    base = mutated(spark, sf_dir)
    parsed, told = html.extract(base).select(*names), X.facts(base).select(*[F.col(n).cast(t) for n, t in html.extract(base).select(*names).dtypes])
    diff = compare.both_ways(parsed, told).groupBy("side").agg(F.count("*").alias("n"))
    return diff.unionByName(told.agg(F.count("*").alias("n")).select(F.lit("rows").alias("side"), "n"))


# The two implementations as dialects: facts of each as the SQL tells them.
_OTHER_RULES = tuple(r for r in O.PAGE_RULES if r[0] != "crawl.redirect_chain")
_CELLS = {c: f"ceil((length({c}) + len(regexp_extract_all({c}, '{T.wide('WF')}'))) / 2.0)::INT" for c in ("title", "description")}
_JA = "len(regexp_extract_all(text_sample, '[\\x{3041}-\\x{309F}\\x{30A1}-\\x{30FA}\\x{4E00}-\\x{9FFF}]'))"
_DIALECTS = f"""WITH {PAGES}, ok AS MATERIALIZED (SELECT * FROM pages_facts WHERE error = ''),
 one AS (SELECT * REPLACE ({_CELLS['title']} AS title_width, {_CELLS['description']} AS description_width, {_JA} >= 40 AND {_JA} >= 0.08::DOUBLE * length(text_sample) AS has_ja, round(elapsed, 3) AS elapsed) FROM ok),
 two AS (SELECT * REPLACE (0 AS blocking_scripts, {_NORMAL.format('canonical')} AS canonical_normal, {_NORMAL.format('url')} AS url_normal) FROM ok),
 found AS MATERIALIZED (SELECT 'left' AS side, url_host, rule, category, severity FROM ({O.findings('two', 'url_host', O.PAGE_RULES)}) UNION ALL SELECT 'right', url_host, rule, category, severity FROM ({O.findings('one', 'url_host', _OTHER_RULES)})),
 audits AS (SELECT url_host, COUNT(*) AS pages FROM ok GROUP BY 1), sides AS (SELECT unnest(['left', 'right']) AS side),
 lists AS (SELECT url_host, rule, COUNT(*) FILTER (side = 'left') AS left_n, COUNT(*) FILTER (side = 'right') AS right_n FROM found GROUP BY ALL HAVING left_n <> right_n)"""
_SIDES = f"""o AS (SELECT a.url_host, s.side, {O.SCORE.format(f'SUM({O.WEIGHT})', 'any_value(a.pages)')} AS overall, COUNT(*) FILTER (severity = 'critical') || '/' || COUNT(*) FILTER (severity = 'warning') || '/' || COUNT(*) FILTER (severity = 'info') AS counts
   FROM audits a CROSS JOIN sides s LEFT JOIN found f ON f.url_host = a.url_host AND f.side = s.side GROUP BY ALL),
 k AS (SELECT a.url_host, s.side, c.category, {O.SCORE.format(f'SUM({O.WEIGHT})', 'any_value(a.pages)')} AS score FROM audits a CROSS JOIN sides s CROSS JOIN (SELECT * FROM (VALUES {O.CATEGORIES}) v(place, category, label)) c
   LEFT JOIN found f ON f.url_host = a.url_host AND f.side = s.side AND f.category = c.category GROUP BY ALL),
 m AS (SELECT url_host, side, string_agg(category || score, ',' ORDER BY category) AS parts FROM k GROUP BY ALL)"""


def _dialect_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = Audits(spark, sf_dir).read
    left, right = (keep(dialects.findings(facts, d, ["url_host"]), d.name) for d in (dialects.SERVICE, dialects.SINGLE_FILE))
    return left, right, facts.groupBy("url_host").agg(F.count("*").alias("pages"))


@query("q_dialect_rules", f"{_DIALECTS} SELECT url_host, rule, left_n, right_n FROM lists")
def q_dialect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the two implementations find differently often in an audit."""
    left, right, _ = _dialect_findings(spark, sf_dir)
    return dialects.rule_differences(left, right, "url_host")


@query(
    "q_dialect_verdicts",
    f"""{_DIALECTS}, {_SIDES} SELECT l.url_host, l.overall AS left_overall, r.overall AS right_overall, l.overall = r.overall AS same_overall, l.counts = r.counts AS same_counts, p.parts = q.parts AS same_categories,
 NOT EXISTS (SELECT 1 FROM lists x WHERE x.url_host = l.url_host) AS same_rules FROM o l JOIN o r ON r.url_host = l.url_host AND r.side = 'right' JOIN m p ON p.url_host = l.url_host AND p.side = 'left' JOIN m q ON q.url_host = l.url_host AND q.side = 'right' WHERE l.side = 'left'""",
)
def q_dialect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the two implementations agree on each audit."""
    left, right, audits = _dialect_findings(spark, sf_dir)
    return dialects.verdicts(left, right, audits, "url_host")


@query("q_doc_thin", f"SELECT doc_id, length(regexp_replace(text, '{T.SPACE}+', '', 'g'))::INT AS text_length FROM documents WHERE length(regexp_replace(text, '{T.SPACE}+', '', 'g')) < 300")
def q_doc_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.length(D.sub(D.name("text"), T.SPACE + "+", "")).col
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("text_length")).filter("text_length < 300")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall score, counts and verdict of each host."""
    return q_score_overall(spark, sf_dir).withColumn("verdict", scoring.verdict(F.col("overall")))
