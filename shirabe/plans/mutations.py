"""A deterministic view over `pages` in which every rule finds something: literal replacements
chosen by page_id, and transport columns derived from it. Only for queries over test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shirabe.functions import dual as D

KANA = "これはにほんごのぶんしょうです。" * 5
HEAD, BODY, H1 = "<head>", "<body>", "</h1>"


def _meta(name: str, content: str) -> str:
    return f'{HEAD}<meta name="{name}" content="{content}">'


def _ld(*blocks: str) -> str:
    return HEAD + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def _og(*keys: str) -> str:
    return HEAD + "".join(f'<meta property="og:{k}" content="x">' for k in keys)


ORG, CRUMB = '{"@type": "Organization", "name": "x"}', '[{"@type": "BreadcrumbList"}, {"@type": "Article"}]'
#: (every, remainder, text, replacement)
MUTATIONS: tuple[tuple[int, int, str, str], ...] = (
    (11, 1, HEAD, _meta("robots", "noindex, nofollow")),
    (7, 2, HEAD, f'{HEAD}<link rel="canonical" href="https://other.example/x/index.html">'),
    (5, 0, HEAD, _meta("viewport", "width=device-width, initial-scale=1")),
    (5, 1, HEAD, _meta("viewport", "width=device-width, user-scalable = no")),
    (6, 0, HEAD, _og("title", "description", "image")),
    (6, 1, HEAD, _og("title")),
    (8, 0, HEAD, _ld(ORG)),
    (8, 1, HEAD, _ld(ORG, CRUMB)),
    (8, 2, HEAD, _ld('{"@type": "Organization"')),
    (8, 3, HEAD, _ld(ORG, '{"@type": ')),
    (9, 0, HEAD, _meta("description", "A description of a fair length that tells what the page is about, in a few words more.")),
    (9, 1, HEAD, _meta("description", "Too &amp; short")),
    (9, 2, HEAD, _meta("description", "long description " * 20)),
    (9, 3, HEAD, _meta("description", KANA)),
    (10, 4, BODY, f"{BODY}<p>{KANA}</p>"),
    (10, 5, BODY, f"{BODY}<p>{KANA}</p>"),
    (10, 5, "<html lang=", "<html data-lang="),
    (12, 1, BODY, f'{BODY}<img src="/a.png"><img src="/b.png" alt="">'),
    (13, 1, H1, f"{H1}<h3>deep</h3><h6>deeper</h6>"),
    (14, 2, H1, f"{H1}<h1>A second one</h1>"),
    (15, 3, BODY, BODY + '<a href="/l">x</a>' * 201),
    (16, 4, BODY, f"{BODY}<p>cafÃ© {chr(0xFFFD) * 2}</p>"),
    (17, 5, "<title>", "<title>１２３ ＡＢ "),
    (18, 6, '<meta charset="utf-8">', ""),
    (19, 7, HEAD, HEAD + '<script src="/a.js"></script>' * 4 + '<script src="/b.js" defer></script>'),
    (21, 8, BODY, f'{BODY}<img src="http://cdn.example/x.png" alt="x"><a href="http://Cdn.example/">c</a>'),
)


def _changed() -> D.Dual:
    """html after all mutations. Where one doesn't apply, its text is replaced by itself, so that html
    stands once in the expression."""
    x = D.name("html")
    for every, rest, text, by in MUTATIONS:
        x = D.swap(x, text, D.case((D.expr(f"page_id % {every} = {rest}"), D.lit(by)), other=D.lit(text)))
    own = D.join(D.lit(f'{HEAD}<link rel="canonical" href="'), D.name("url"), D.lit('">'))
    return D.swap(x, HEAD, D.case((D.expr("page_id % 7 = 3"), own), other=D.lit(HEAD)))


#: Values that a fetch has, told by page_id: Spark's expression and DuckDB's, where they differ.
_CHAIN = ", ".join(["url", *(f"url || '?hop={i}'" for i in range(1, 6))])
TRANSPORT = {
    "status": ("CASE WHEN page_id % 20 = 0 THEN 404 ELSE 200 END",) * 2,
    "elapsed": ("CAST(page_id % 40 AS DOUBLE) / 10",) * 2,
    "chain": (f"slice(array({_CHAIN}), 1, CAST(page_id % 6 AS INT))", f"[{_CHAIN}][1:page_id % 6]"),
    "error": ("CASE WHEN page_id % 25 = 24 OR contains(url, '.org/') THEN 'timeout' ELSE '' END",) * 2,
}


def mutated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html, status, elapsed, chain (of redirects) and error (of the fetch)."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return df.select("page_id", "url", _changed().col.alias("html")).selectExpr("*", *[f"{e} AS {n}" for n, (e, _) in TRANSPORT.items()])


def mutated_sql() -> str:
    return "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, (_, e) in TRANSPORT.items()) + f" FROM (SELECT page_id, url, {_changed().sql} AS html FROM pages))"


# --- what hosts answer -----------------------------------------------------------------------------

_N = " || chr(10) || "
#: Bodies of robots.txt, sitemap files and statuses of probes, chosen by a digest of the host or link.
_ROBOTS = (
    "NULL",
    f"'User-agent: *'{_N}'Disallow: /'{_N}'Sitemap: https://' || site || '/s.xml # x'",
    f"'User-agent: bot'{_N}'Disallow: /'{_N}'sitemap:https://' || site || '/1.xml'{_N}'SITEMAP: https://' || site || '/2.xml'",
    "'user-agent: *' || chr(13) || chr(10) || 'User-Agent: bot' || chr(13) || chr(10) || 'disallow: /'",
    "''",
    f"'# none'{_N}'User-agent: bot'{_N}'User-agent : *'{_N}' Disallow : / # all'{_N}'no colon'",
)
_HOME = (
    "NULL",
    "'<urlset xmlns=\"x\"><url><loc> https://' || site || '/1 </loc></url><url><loc><![CDATA[https://' || site || '/2?a=1&b=2]]></loc></url></urlset>'",
    "'<sm:urlset><sm:url><sm:loc>https://' || site || '/x&amp;y</sm:loc></sm:url><sm:url><sm:loc>https://' || site || '/old.xml</sm:loc></sm:url></sm:urlset>'",
    "'<sitemapindex><sitemap><loc>https://' || site || '/a.xml</loc></sitemap><sitemap><loc>https://' || site || '/b.xml.gz</loc></sitemap></sitemapindex>'",
    "'<urlset><url><loc>https://' || site || '/1'",
)
_NAMED = ("NULL", "'<urlset><url><loc>https://' || site || '/named/index.html</loc></url></urlset>'", "'not xml'")
_CHILD = ("'<urlset><url><loc>https://' || site || '/deep</loc></url><url><loc>https://elsewhere.example/</loc></url></urlset>'", "''")


def _digit(x: str, n: int, duck: bool, start: int = 1) -> str:
    part = f"substring(md5({x}), {start}, 6)"
    return f"CAST('0x' || {part} AS INT) % {n}" if duck else f"CAST(conv({part}, 16, 10) AS INT) % {n}"


def _chosen(bodies: tuple[str, ...], start: int, duck: bool) -> str:
    return f"CASE {_digit('site', len(bodies), duck, start)} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bodies)) + " END"


def robots_bodies(duck: bool) -> str:
    """An expression over site."""
    return _chosen(_ROBOTS, 1, duck)


def sitemap_files(duck: bool) -> tuple[tuple[str, str], ...]:
    """(address, body) over site: the usual file, those that robots.txt may name, and an index's child."""
    home, named, child = (_chosen(b, at, duck) for b, at in ((_HOME, 7), (_NAMED, 13), (_CHILD, 19)))
    at = lambda name: f"'https://' || site || '/{name}'"
    return (at("sitemap.xml"), home), (at("s.xml"), named), (at("1.xml"), named), (at("a.xml"), child)


def probed(duck: bool) -> dict[str, str]:
    """head and get (0: no answer) over target."""
    digit = _digit("target", 6, duck)
    return {"head": f"CASE {digit} WHEN 0 THEN 404 WHEN 1 THEN 405 WHEN 2 THEN 0 ELSE 200 END", "get": f"CASE {_digit('target', 2, duck, 7)} WHEN 0 THEN 200 ELSE 500 END"}


def advice(spark: SparkSession, audits: DataFrame) -> DataFrame:
    """Two pieces of advice for audits (url_host) whose name has an even number of letters."""
    rows = audits.filter("length(url_host) % 2 = 0").selectExpr("url_host AS audit_id", "explode(array(1, 2)) AS n")
    return rows.selectExpr("audit_id", "concat(audit_id, n) AS id", "timestamp('2024-01-01 00:00:00') + make_interval(0, 0, 0, n % 2) AS created_at", "concat('Advice ', n, ' for ', audit_id) AS body")


def advice_sql() -> str:
    """url_host and body of the newest of these."""
    return "SELECT url_host, 'Advice 1 for ' || url_host AS body FROM overall WHERE length(url_host) % 2 = 0"
