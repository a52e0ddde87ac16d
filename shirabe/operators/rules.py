"""The catalogue of page rules, one declarative row each.

A rule is a predicate and an evidence over page facts; all rules run in one narrow projection that
makes an array of the hits and inlines it: no union, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shirabe.config import THRESHOLDS as L


@dataclass(frozen=True)
class Rule:
    """when and evidence are SQL expressions over facts."""

    id: str
    severity: str
    when: str
    evidence: str
    message: str = ""
    action: str = ""

    @property
    def category(self) -> str:
        return self.id.split(".")[0]


def _n(column: str) -> str:
    return f"CAST({column} AS STRING)"


def _cut(column: str, n: int) -> str:
    return f"substring({column}, 1, {n})"


_TIMED = "concat(format_string('%.2f', elapsed), ' s, ', format_number(html_bytes, 0), ' bytes')"
C, W, I = "critical", "warning", "info"  # noqa: E741
PAGE_RULES: tuple[Rule, ...] = (
    Rule("crawl.noindex", C, "noindex", "CASE WHEN robots_meta = '' THEN 'noindex' ELSE robots_meta END", "Search engines are told not to index this page", "Remove noindex if the page should be found"),
    Rule("crawl.nofollow", W, "nofollow", "robots_meta", "Links on this page are not followed", "Remove nofollow"),
    Rule("crawl.error_status", C, "status >= 400", _n("status"), "The page answers with an error", "Repair the page or its links"),
    Rule("crawl.redirect_chain", W, f"size(chain) >= {L.min_chain}", "array_join(slice(chain, 1, 4), ' -> ')", "The page is reached through redirects", "Link to the final address"),
    Rule("meta.title.missing", C, "title = ''", "'no title'", "There is no title", "Write a title"),
    Rule("meta.title.too_long", W, f"title_width > {L.title_max}", f"concat({_n('title_width')}, ': ', title)", "The title will be cut in results", "Shorten the title"),
    Rule("meta.title.too_short", W, f"title_width > 0 AND title_width < {L.title_min}", f"concat({_n('title_width')}, ': ', title)", "The title says little", "Describe the page in the title"),
    Rule("meta.description.missing", W, "description = ''", "'no description'", "There is no description", "Write a description"),
    Rule("meta.description.too_long", I, f"description_width > {L.description_max}", _n("description_width"), "The description will be cut", "Shorten it"),
    Rule("meta.description.too_short", I, f"description <> '' AND description_width < {L.description_min}", f"concat({_n('description_width')}, ': ', description)", "The description says little", "Say more"),
    Rule("meta.canonical.missing", I, "canonical = ''", "'no canonical'", "No canonical address is given", "Add one"),
    Rule("meta.canonical.conflict", W, "canonical_conflict", "canonical", "The canonical address is another page", "Check that this is meant"),
    Rule("heading.h1.missing", W, "h1_count = 0", "'0'", "There is no main heading", "Add one h1"),
    Rule("heading.h1.multiple", I, "h1_count > 1", f"concat({_n('h1_count')}, ': ', array_join(slice(h1_texts, 1, 3), ' / '))", "There are several main headings", "Keep one"),
    Rule("heading.level_jump", I, "heading_jumps <> ''", "heading_jumps", "Heading levels are skipped", "Use levels in order"),
    Rule("heading.h1_equals_title", I, "h1_first <> '' AND h1_first = title", _cut("title", 60), "Heading and title are the same", "Let them complement each other"),
    Rule("structured.missing", W, "jsonld_count = 0", "'no structured data'", "There is no structured data", "Add JSON-LD"),
    Rule("structured.invalid", W, "jsonld_count > 0 AND jsonld_invalid > 0", _n("jsonld_invalid"), "Some structured data can't be read", "Repair the JSON"),
    Rule("structured.breadcrumb", I, "jsonld_count > 0 AND NOT has_breadcrumb", "jsonld_list", "There is no breadcrumb data", "Add BreadcrumbList"),
    Rule("social.og.missing", W, "NOT (og_title OR og_description OR og_image)", "'no og tags'", "Shared links show no preview", "Add og tags"),
    Rule("social.og.partial", I, "(og_title OR og_description OR og_image) AND og_missing <> ''", "og_missing", "Some og tags are missing", "Add them"),
    Rule("content.thin", W, f"text_length < {L.thin_text}", _n("text_length"), "There is little text", "Write more"),
    Rule("content.img_alt", I, "images_without_alt > 0", f"concat({_n('images_without_alt')}, '/', {_n('images_total')})", "Images have no alternative text", "Add alt"),
    Rule("content.too_many_links", I, f"link_count > {L.most_links}", _n("link_count"), "There are very many links", "Reduce them"),
    Rule("content.no_internal_link", W, "internal_link_count = 0", "'0'", "No link leads to the own site", "Add internal links"),
    Rule("mobile.viewport.missing", C, "viewport = ''", "'no viewport'", "Phones show the desktop layout", "Add a viewport"),
    Rule("mobile.viewport.no_zoom", I, "replace(viewport, ' ', '') LIKE '%user-scalable=no%' OR replace(viewport, ' ', '') LIKE '%maximum-scale=1%'", "viewport", "Readers can't zoom", "Allow zooming"),
    Rule("speed.very_slow", C, f"elapsed >= {L.very_slow}", _TIMED, "The answer is very slow", "Speed up the server"),
    Rule("speed.slow", W, f"elapsed >= {L.slow} AND elapsed < {L.very_slow}", _TIMED, "The answer is slow", "Speed up the server"),
    Rule("speed.blocking_scripts", I, f"blocking_scripts > {L.blocking_scripts}", _n("blocking_scripts"), "Scripts in the head block rendering", "Use async or defer"),
    Rule("security.no_https", C, "url_scheme <> 'https'", "url_scheme", "The page isn't encrypted", "Use HTTPS"),
    Rule("security.mixed_content", W, "url_scheme = 'https' AND mixed_content > 0", _n("mixed_content"), "Unencrypted parts are included", "Use HTTPS for them"),
    Rule("japanese.lang.missing", W, "has_ja AND lang = ''", "'no lang'", "Japanese text without a language", "Set lang to ja"),
    Rule("japanese.lang.mismatch", W, "has_ja AND lang <> '' AND NOT lower(lang) LIKE 'ja%'", "lang", "Japanese text under another language", "Set lang to ja"),
    Rule("japanese.mojibake", C, "mojibake <> ''", "mojibake", "Text is garbled", "Repair the encoding"),
    Rule("japanese.fullwidth_alnum", I, "fullwidth <> ''", "fullwidth", "Full-width letters or digits in the title", "Use half-width ones"),
    Rule("japanese.charset.missing", I, "charset = ''", "'no charset'", "No character set is given", "Declare UTF-8"),
)


def findings(facts: DataFrame, keys: Sequence[str], rules: Sequence[Rule] | None = None) -> DataFrame:
    """keys, rule_ord, rule, category, severity and evidence of every hit; of all page rules, unless given some."""
    rules = every() if rules is None else rules
    hits = [
        F.when(F.expr(r.when), F.struct(F.lit(i).alias("rule_ord"), F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.expr(r.evidence).alias("evidence")))
        for i, r in enumerate(rules)
    ]
    return facts.select(*keys, F.inline(F.array_compact(F.array(*hits))))


#: Rules that users have added.
_ADDED: list[Rule] = []


def register(rule: Rule) -> None:
    """Add a rule to those that `every` gives; its id must be new."""
    if rule.id in {r.id for r in every()}:
        raise ValueError(f"there is a rule {rule.id}")
    _ADDED.append(rule)


#: A table of rules: valid_from is the day from which on a rule holds, of rules with one id the last that does.
TABLE = "place int, id string, severity string, predicate string, evidence string, message string, action string, valid_from date"


def to_table(spark: SparkSession, rules: Sequence[Rule], valid_from: date) -> DataFrame:
    rows = [(i, r.id, r.severity, r.when, r.evidence, r.message, r.action, valid_from) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, TABLE)


def from_table(table: DataFrame, on: date) -> tuple[Rule, ...]:
    """The rules of a table that hold on a day, in order of place and id. A rule that is empty then (no predicate) holds no
    more. Rules are settings: they are read to the driver, which makes the plan of them."""
    rows = table.filter(F.col("valid_from") <= F.lit(on)).groupBy("id").agg(F.max_by(F.struct("place", "severity", "predicate", "evidence", "message", "action"), "valid_from").alias("r"))
    rows = rows.select("id", "r.*").filter("predicate IS NOT NULL").orderBy("place", "id").collect()
    return tuple(Rule(r["id"], r["severity"], r["predicate"], r["evidence"] or "''", r["message"] or "", r["action"] or "") for r in rows)


def every() -> tuple[Rule, ...]:
    return PAGE_RULES + tuple(_ADDED)


def by_category(category: str) -> tuple[Rule, ...]:
    return tuple(r for r in every() if r.category == category)
