"""Page facts by expressions alone: the columnar form of extraction.

One pass of built-in functions over html gives one row of facts for each page. It reads the common
spelling of tags (attributes in double quotes, name before content); `sources.html` parses any.
Facts are told as stages of named expressions, each stage using the names before it. The SQL of the
stages is what DuckDB runs against the parser's facts, on pages whose spelling both read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from shirabe.functions.lazy import F

from shirabe.config import SETTINGS
from shirabe.functions import dual as D
from shirabe.functions import text as T
from shirabe.functions import urls as U
from shirabe.functions.dual import Dual

Stage = dict[str, Dual]

html, url = D.name("html"), D.name("url")


def _meta(key: str) -> Dual:
    return D.extract(html, rf'(?is)<meta\s+name="{key}"\s+content="([^"]*)"', 1)


def _og(key: str) -> Dual:
    return D.like(html, rf'(?i)<meta\s+property="og:{key}"\s')


def _clean(x: Dual) -> Dual:
    """Without the contents of script, style, noscript and template, and without comments."""
    for tag in ("script", "style", "noscript", "template"):
        x = D.sub(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return D.sub(x, r"(?s)<!--.*?-->", " ")


def _strip(x: Dual) -> Dual:
    return T.norm(T.decode_entities(D.sub(x, r"(?s)<[^>]*>", " ")))


RAW: Stage = {
    "html_bytes": Dual(F.octet_length("html").cast("bigint"), "strlen(html)::BIGINT"),
    "plain": _clean(html),
    "head": D.extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1),
    "title_raw": D.extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
    "description": T.norm(T.decode_entities(_meta("description"))),
    "robots_meta": T.norm(_meta("robots")),
    "viewport": T.norm(_meta("viewport")),
    "og_title": _og("title"),
    "og_description": _og("description"),
    "og_image": _og("image"),
    "charset": D.extract(html, r'(?i)<meta\s+charset="([^"]*)"', 1),
    "canonical": D.extract(html, r'(?is)<link\s+rel="canonical"\s+href="([^"]*)"', 1),
    "lang": D.extract(html, r'(?is)<html[^>]*?\slang="([^"]*)"', 1),
    "levels": D.extract_all(html, r"(?i)<h([1-6])\b", 1),
    "blocks": D.extract_all(html, r'(?is)<script\s+type="application/ld\+json"[^>]*>(.*?)</script>', 1),
    "url_scheme": U.scheme(url),
    "url_host": U.host(url),
}

plain, head = D.name("plain"), D.name("head")
_sources = D.extract_all(head, r'(?is)<script\b[^>]*\ssrc="[^"]*"[^>]*>', 0)
_ASYNC = r"(?i)\s(?:async|defer)\b"
_jump = "concat('H', levels[i], ' -> H', levels[i + 1])"

SHAPED: Stage = {
    "title": _strip(D.name("title_raw")),
    "text": _strip(plain),
    "h1_inner": D.extract_all(plain, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1),
    "jumps": Dual(
        F.expr("filter(transform(slice(levels, 1, greatest(size(levels) - 1, 0)), (v, i) -> CASE WHEN int(levels[i + 1]) - int(v) >= 2 THEN concat('H', v, ' -> H', levels[i + 1]) END), x -> x IS NOT NULL)"),
        f"list_transform(list_filter(range(1, len(levels)), lambda i: levels[i + 1]::INT - levels[i]::INT >= 2), lambda i: {_jump})",
    ),
    "jsonld": Dual(
        F.expr("transform(blocks, b -> from_json(b, 'array<struct<`@type`:string>>'))"),
        "list_transform(blocks, lambda b: CASE WHEN json_valid(b) THEN CASE WHEN json_type(b) = 'ARRAY' THEN json_extract_string(b, '$[*].\"@type\"') ELSE [json_extract_string(b, '$.\"@type\"')] END END)",
    ),
    "images_total": D.count(plain, r"(?i)<img\b"),
    "images_with_alt": D.count(plain, r"(?is)<img\b[^>]*\salt="),
    "hrefs": D.extract_all(plain, r'(?is)<a\b[^>]*?\shref="([^"]*)"', 1),
    "blocking_scripts": Dual(
        F.size(F.filter(_sources.col, lambda s: ~s.rlike(_ASYNC))), f"len(list_filter({_sources.sql}, lambda s: NOT regexp_matches(s, {D.quote(_ASYNC)})))::INT"
    ),
    "mixed_content": Dual(
        F.when(F.col("url_scheme") == "https", D.count(html, '(?:src|href)="http://').col).otherwise(0),
        f"CASE WHEN url_scheme = 'https' THEN {D.count(html, '(?:src|href)=\"http://').sql} ELSE 0 END",
    ),
    "canonical_normal": U.normalize(D.name("canonical")),
    "url_normal": U.normalize(url),
}

_text = D.name("text")
_title, _description = D.name("title"), D.name("description")
_skip = r"(?i)^(?:mailto:|tel:|javascript:|#)"

FACTS: Stage = {
    "title_width": T.visible_length(_title),
    "description_width": T.visible_length(_description),
    "fullwidth": T.first_matches(_title, T.FULLWIDTH),
    "noindex": D.like(D.lower(D.name("robots_meta")), "noindex"),
    "nofollow": D.like(D.lower(D.name("robots_meta")), "nofollow"),
    "canonical_conflict": Dual((F.col("canonical") != "") & (F.col("canonical_normal") != F.col("url_normal")), "(canonical <> '' AND canonical_normal <> url_normal)"),
    "h1_count": Dual(F.size(F.filter("levels", lambda v: v == "1")), "len(list_filter(levels, lambda v: v = '1'))::INT"),
    "h1_first": Dual(_strip(Dual(F.coalesce(F.get("h1_inner", 0), F.lit("")), "")).col, _strip(Dual(F.lit(""), "COALESCE(h1_inner[1], '')")).sql),
    "h1_texts": Dual(
        F.filter(F.transform("h1_inner", lambda h: _strip(Dual(h, "h")).col), lambda t: t != ""), f"list_filter(list_transform(h1_inner, lambda h: {_strip(Dual(F.lit(''), 'h')).sql}), lambda t: t <> '')"
    ),
    "heading_jumps": Dual(F.array_join(F.slice("jumps", 1, 3), ", "), "COALESCE(array_to_string(jumps[1:3], ', '), '')"),
    "jsonld_types": Dual(
        F.expr("array_sort(array_distinct(filter(flatten(filter(transform(jsonld, a -> transform(a, o -> o.`@type`)), a -> a IS NOT NULL)), t -> t IS NOT NULL)))"),
        "list_sort(list_distinct(flatten(list_filter(jsonld, lambda a: a IS NOT NULL))))",
    ),
    "jsonld_invalid": Dual(F.expr("size(filter(jsonld, a -> a IS NULL))"), "len(list_filter(jsonld, lambda a: a IS NULL))::INT"),
    "og_missing": Dual(
        F.expr("concat_ws(', ', CASE WHEN NOT og_title THEN 'og:title' END, CASE WHEN NOT og_description THEN 'og:description' END, CASE WHEN NOT og_image THEN 'og:image' END)"),
        "concat_ws(', ', CASE WHEN NOT og_title THEN 'og:title' END, CASE WHEN NOT og_description THEN 'og:description' END, CASE WHEN NOT og_image THEN 'og:image' END)",
    ),
    "text_length": D.length(D.sub(_text, T.SPACE + "+", "")),
    "text_sample": Dual(F.substring("text", 1, SETTINGS.text_sample), f"substring(text, 1, {SETTINGS.text_sample})"),
    "images_without_alt": D.expr("images_total - images_with_alt"),
    "links": Dual(F.filter("hrefs", lambda h: (h != "") & ~h.rlike(_skip)), f"list_filter(hrefs, lambda h: h <> '' AND NOT regexp_matches(h, {D.quote(_skip)}))"),
}

#: Links: those to a path are the host's own; others count by their host.
LINKED: Stage = {
    "link_count": Dual(F.size("links"), "len(links)::INT"),
    "internal_link_count": Dual(
        F.size(F.filter("links", lambda h: ~h.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//") | (F.lower(F.regexp_extract(h, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/:?#]*)", 1)) == F.col("url_host")))),
        r"len(list_filter(links, lambda h: NOT regexp_matches(h, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') OR lower(regexp_extract(h, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/:?#]*)', 1)) = url_host))::INT",
    ),
    "has_ja": T.has_japanese(D.name("text_sample")),
    "mojibake": T.mojibake(D.name("text_sample")),
    "jsonld_list": Dual(F.array_join("jsonld_types", ", "), "COALESCE(array_to_string(jsonld_types, ', '), '')"),
    "jsonld_count": Dual(F.size("jsonld_types"), "COALESCE(len(jsonld_types), 0)::INT"),
    "has_breadcrumb": Dual(F.array_contains("jsonld_types", "BreadcrumbList"), "COALESCE(list_contains(jsonld_types, 'BreadcrumbList'), false)"),
}

STAGES = (RAW, SHAPED, FACTS, LINKED)


def facts(pages: DataFrame) -> DataFrame:
    """pages (url, html and any other columns) with the facts as columns."""
    for stage in STAGES:
        pages = pages.withColumns({n: d.col for n, d in stage.items()})
    return pages


def facts_sql(pages: str) -> str:
    """The same as a SELECT over the relation pages."""
    for stage in STAGES:
        pages = "(SELECT *, " + ", ".join(f"{d.sql} AS {n}" for n, d in stage.items()) + f" FROM {pages})"
    return f"SELECT * FROM {pages}"
