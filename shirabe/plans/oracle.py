"""SQL for DuckDB, written by hand from the definitions: what the registered queries are held against.

Nothing here is made from the operators' code: rules, weights, address checks and the parsing of robots
and sitemaps are told a second time, so that a mistake in one of the two shows."""

from __future__ import annotations

#: (rule, severity, when, evidence) in the order of findings, over facts of pages.
PAGE_RULES = (
    ("crawl.noindex", "critical", "contains(lower(robots_meta), 'noindex')", "robots_meta"),
    ("crawl.nofollow", "warning", "contains(lower(robots_meta), 'nofollow')", "robots_meta"),
    ("crawl.error_status", "critical", "status >= 400", "status::VARCHAR"),
    ("crawl.redirect_chain", "warning", "len(chain) >= 2", "array_to_string(chain[:4], ' -> ')"),
    ("meta.title.missing", "critical", "length(title) = 0", "'no title'"),
    ("meta.title.too_long", "warning", "title_width >= 33", "title_width || ': ' || title"),
    ("meta.title.too_short", "warning", "title_width BETWEEN 1 AND 9", "title_width || ': ' || title"),
    ("meta.description.missing", "warning", "length(description) = 0", "'no description'"),
    ("meta.description.too_long", "info", "description_width >= 121", "description_width::VARCHAR"),
    ("meta.description.too_short", "info", "length(description) > 0 AND description_width <= 49", "description_width || ': ' || description"),
    ("meta.canonical.missing", "info", "length(canonical) = 0", "'no canonical'"),
    ("meta.canonical.conflict", "warning", "length(canonical) > 0 AND canonical_normal IS DISTINCT FROM url_normal", "canonical"),
    ("heading.h1.missing", "warning", "len(list_filter(levels, lambda v: v = '1')) = 0", "'0'"),
    ("heading.h1.multiple", "info", "len(list_filter(levels, lambda v: v = '1')) >= 2", "len(list_filter(levels, lambda v: v = '1')) || ': ' || array_to_string(h1_texts[:3], ' / ')"),
    ("heading.level_jump", "info", "len(jumps) > 0", "array_to_string(jumps[:3], ', ')"),
    ("heading.h1_equals_title", "info", "len(h1_texts) > 0 AND h1_texts[1] = title", "substring(title, 1, 60)"),
    ("structured.missing", "warning", "COALESCE(len(jsonld_types), 0) = 0", "'no structured data'"),
    ("structured.invalid", "warning", "len(jsonld_types) > 0 AND jsonld_invalid >= 1", "jsonld_invalid::VARCHAR"),
    ("structured.breadcrumb", "info", "len(jsonld_types) > 0 AND NOT list_contains(jsonld_types, 'BreadcrumbList')", "array_to_string(jsonld_types, ', ')"),
    ("social.og.missing", "warning", "og_missing = 'og:title, og:description, og:image'", "'no og tags'"),
    ("social.og.partial", "info", "og_missing NOT IN ('', 'og:title, og:description, og:image')", "og_missing"),
    ("content.thin", "warning", "text_length <= 299", "text_length::VARCHAR"),
    ("content.img_alt", "info", "images_total > images_with_alt", "(images_total - images_with_alt) || '/' || images_total"),
    ("content.too_many_links", "info", "link_count >= 201", "link_count::VARCHAR"),
    ("content.no_internal_link", "warning", "internal_link_count = 0", "'0'"),
    ("mobile.viewport.missing", "critical", "length(viewport) = 0", "'no viewport'"),
    ("mobile.viewport.no_zoom", "info", "regexp_matches(replace(viewport, ' ', ''), 'user-scalable=no|maximum-scale=1')", "viewport"),
    ("speed.very_slow", "critical", "elapsed >= 3", "printf('%.2f s, ', elapsed) || format('{:,}', html_bytes) || ' bytes'"),
    ("speed.slow", "warning", "elapsed >= 1.5 AND elapsed < 3", "printf('%.2f s, ', elapsed) || format('{:,}', html_bytes) || ' bytes'"),
    ("speed.blocking_scripts", "info", "blocking_scripts >= 4", "blocking_scripts::VARCHAR"),
    ("security.no_https", "critical", "NOT starts_with(lower(url), 'https://')", "url_scheme"),
    ("security.mixed_content", "warning", "starts_with(lower(url), 'https://') AND mixed_content >= 1", "mixed_content::VARCHAR"),
    ("japanese.lang.missing", "warning", "has_ja AND length(lang) = 0", "'no lang'"),
    ("japanese.lang.mismatch", "warning", "has_ja AND length(lang) > 0 AND NOT starts_with(lower(lang), 'ja')", "lang"),
    ("japanese.mojibake", "critical", "length(mojibake) > 0", "mojibake"),
    ("japanese.fullwidth_alnum", "info", "length(fullwidth) > 0", "fullwidth"),
    ("japanese.charset.missing", "info", "length(charset) = 0", "'no charset'"),
)
#: The same over facts of sites.
SITE_RULES = (
    ("crawl.robots.missing", "info", "robots_txt IS NULL", "base_url || '/robots.txt'"),
    ("crawl.robots.disallow_all", "critical", "robots_txt IS NOT NULL AND robots_blocks_all", "'Disallow: /'"),
    ("crawl.robots.no_sitemap", "info", "robots_txt IS NOT NULL AND length(robots_sitemap) = 0", "'no Sitemap line'"),
    ("crawl.sitemap.missing", "warning", "NOT sitemap_found", "base_url || '/sitemap.xml'"),
    ("content.broken_link", "warning", "length(broken) > 0", "broken"),
)


def findings(facts: str, keys: str, rules: tuple[tuple[str, str, str, str], ...], category: str | None = None) -> str:
    """A row for each hit, rule by rule; rule_ord counts the rules of the category, if one is given."""
    own = [r for r in rules if category is None or r[0].split(".")[0] == category]
    return " UNION ALL ".join(
        f"SELECT {keys}, {i} AS rule_ord, '{rule}' AS rule, '{rule.split('.')[0]}' AS category, '{severity}' AS severity, {evidence} AS evidence FROM {facts} WHERE {when}"
        for i, (rule, severity, when, evidence) in enumerate(own)
    )


#: Points by severity and labels of categories, in their order.
WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'warning' THEN 10 WHEN 'info' THEN 3 ELSE 5 END"
SCORE = "greatest(0, least(100, floor(100.5::DOUBLE - COALESCE({0}, 0) / greatest({1}, 1)::DOUBLE)))::INT"
VERDICT = "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 70 THEN 'good' WHEN {0} >= 50 THEN 'needs work' ELSE 'poor' END"
CATEGORIES = (
    "(0, 'crawl', 'Crawling'), (1, 'meta', 'Metadata'), (2, 'heading', 'Headings'), (3, 'structured', 'Structured data'), (4, 'social', 'Social'),"
    " (5, 'content', 'Content'), (6, 'mobile', 'Mobile'), (7, 'speed', 'Speed'), (8, 'security', 'Security'), (9, 'japanese', 'Japanese')"
)

#: Links of pages as seen from them: a link with a scheme is whole, one of two slashes takes the page's
#: scheme, one of a slash its authority, any other its folder. Dot segments are taken out in turn.
_AUTHORITY = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
_FOLDER = f"COALESCE(NULLIF(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*/|[A-Za-z][A-Za-z0-9+.-]*://[^/]*/)', 1), ''), {_AUTHORITY} || '/')"
ABSOLUTE = (
    "CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:') || href"
    f" WHEN starts_with(href, '/') THEN {_AUTHORITY} || href WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href ELSE {_FOLDER} || href END"
)


def dots(x: str, depth: int = 4) -> str:
    """x without /./ and, up to depth times, a segment with the /../ behind it."""
    x = f"regexp_replace({x}, '/\\./', '/', 'g')"
    for _ in range(depth):
        x = f"regexp_replace({x}, '([^/])/[^/?#]+/\\.\\./', '\\1/')"
    return x


def public(raw: str) -> str:
    """Whether the address in column url may be fetched, by numbers rather than by patterns: raw is a
    relation with url."""
    number = "a * 16777216 + b * 65536 + c * 256 + d"
    closed = [(0, 8), (10 << 24, 8), (100 << 24 | 64 << 16, 10), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24, 24), (192 << 24 | 2 << 8, 24),
              (192 << 24 | 168 << 16, 16), (198 << 24 | 18 << 16, 15), (198 << 24 | 51 << 16 | 100 << 8, 24), (203 << 24 | 113 << 8, 24), (224 << 24, 3)]
    blocks = " OR ".join(f"({number}) // {1 << (32 - bits)} = {base >> (32 - bits)}" for base, bits in closed)
    # Code points of digits and of letters that lookups leave as they are.
    letters = ((48, 57), (97, 122), (0xDF, 0xF6), (0xF8, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E), (0x3B1, 0x3C9), (0x430, 0x45F), (0x3005, 0x3005), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x30FC, 0x30FC), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
    letter = "(" + " OR ".join(f"unicode(c) BETWEEN {lo} AND {hi}" for lo, hi in letters) + ")"
    return f"""(SELECT raw, url, lower(regexp_extract(url, '^[^:]*')) IN ('http', 'https')
      AND COALESCE(TRY_CAST(NULLIF(regexp_extract(rest, ':([0-9]+)$', 1), '') AS BIGINT), 80) NOT IN (22, 23, 25, 445, 3306, 5432, 6379, 11211, 11434)
      AND CASE
        WHEN starts_with(host, '[') THEN len(groups) = 8 AND list_bool_and(list_transform(groups, lambda g: regexp_matches(g, '^[0-9a-f]{{1,4}}$')))
          AND g1 BETWEEN 8192 AND 16383 AND g1 <> 8194 AND NOT (g1 = 8193 AND (g2 < 512 OR g2 = 3512)) AND NOT (g1 = 16383 AND g2 < 4096)
        WHEN len(parts) = 4 AND list_bool_and(list_transform(parts, lambda p: regexp_matches(p, '^(0|[1-9][0-9]{{0,2}})$') AND TRY_CAST(p AS INT) <= 255)) THEN NOT ({blocks})
        ELSE host <> '' AND host <> 'localhost' AND NOT ends_with(host, '.localhost') AND NOT regexp_matches(parts[-1], '^([0-9]+|0x[0-9a-f]*)$') AND list_bool_and(list_transform(string_split(host, ''), lambda c: c IN ('.', '_', '-') OR {letter})) END
        AND list_bool_and(list_transform(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'), ''), lambda c: unicode(c) > 32 AND unicode(c) NOT IN (92, 127))) AS accepted
     FROM (SELECT *, TRY_CAST(parts[1] AS BIGINT) AS a, TRY_CAST(parts[2] AS BIGINT) AS b, TRY_CAST(parts[3] AS BIGINT) AS c, TRY_CAST(parts[4] AS BIGINT) AS d,
        TRY_CAST('0x' || groups[1] AS BIGINT) AS g1, TRY_CAST('0x' || groups[2] AS BIGINT) AS g2
      FROM (SELECT *, string_split(host, '.') AS parts,
        CASE WHEN NOT contains(six, '::') THEN string_split(six, ':') WHEN len(ahead) + len(behind) <= 7 AND NOT contains(six, ':::') THEN list_concat(ahead, list_transform(range(8 - len(ahead) - len(behind)), lambda i: '0'), behind) ELSE [] END AS groups
       FROM (SELECT *, list_filter(string_split(split_part(six, '::', 1), ':'), lambda g: g <> '') AS ahead, list_filter(string_split(split_part(six, '::', 2), ':'), lambda g: g <> '') AS behind
        FROM (SELECT *, lower(rtrim(regexp_extract(rest, '^(\\[[^\\]]*\\]|[^:]*)'), '.')) AS host, lower(regexp_extract(rest, '^\\[([^\\]]*)\\]', 1)) AS six
         FROM (SELECT *, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', '') AS rest FROM {raw}))))))"""
