"""Other readings of the rules, as data, and how the findings of two readings differ.

Implementations of the rules differ in a few points. A dialect names its choice in each; facts are read once and only the
columns that depend on a choice are computed again, so any two dialects can be held against each other over all
audits in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions import dual as D
from shirabe.functions import text as T
from shirabe.functions import urls as U
from shirabe.operators import rules, scoring


@dataclass(frozen=True)
class Dialect:
    name: str
    #: East Asian widths that take a full cell.
    full: str = "WFA"
    #: A class of Japanese characters.
    japanese: str = T.JAPANESE
    #: Whether addresses are compared with percent escapes decoded.
    decoded: bool = True
    #: Whether times are rounded to milliseconds before thresholds.
    rounded: bool = False
    #: Whether scripts in the head are seen.
    head_scripts: bool = True
    #: Whether robots.txt without a character counts as there.
    empty_robots: bool = True
    #: Rules that it hasn't got.
    without: tuple[str, ...] = ()


STANDARD = Dialect("standard")
#: The choices of the implementation in one file.
SINGLE_FILE = Dialect("single-file", full="WF", japanese=r"[\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}]", rounded=True, empty_robots=False, without=("crawl.redirect_chain",))
#: The choices of the service where they differ from the standard.
SERVICE = Dialect("service", decoded=False, head_scripts=False)


def page_facts(facts: DataFrame, dialect: Dialect) -> DataFrame:
    """facts (as rules read them) as the dialect sees them."""
    changed: dict[str, Column] = {}
    if dialect.full != STANDARD.full:
        changed |= {f"{c}_width": T.visible_length(D.name(c), dialect.full).col for c in ("title", "description")}
    if dialect.japanese != STANDARD.japanese:
        changed["has_ja"] = T.has_japanese(D.name("text_sample"), dialect.japanese).col
    if not dialect.decoded:
        changed["canonical_conflict"] = (F.col("canonical") != "") & (U.normalize(D.name("canonical")).col != U.normalize(D.name("url")).col)
    if dialect.rounded:
        changed["elapsed"] = F.round("elapsed", 3)
    if not dialect.head_scripts:
        changed["blocking_scripts"] = F.lit(0)
    return facts.withColumns(changed) if changed else facts


def site_facts(facts: DataFrame, dialect: Dialect) -> DataFrame:
    return facts if dialect.empty_robots else facts.withColumn("robots_txt", F.when(F.col("robots_txt") != "", F.col("robots_txt")))


def findings(facts: DataFrame, dialect: Dialect, keys: Sequence[str]) -> DataFrame:
    """keys, rule, category, severity and evidence of the pages' findings in a dialect; its own rules included."""
    own = [r for r in rules.every() if r.id not in dialect.without]
    return rules.findings(page_facts(facts, dialect), keys, own).drop("rule_ord")


def rule_differences(left: DataFrame, right: DataFrame, audit: str) -> DataFrame:
    """audit, rule, left_n and right_n where the two sides' lists of rules differ: multisets by audit. Both sides are
    added up in one grouping, with counts before the shuffle; a hot audit is a row for each rule and task."""
    one = lambda df, l, r: df.select(audit, "rule", F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    both = one(left, 1, 0).unionByName(one(right, 0, 1))
    sums = both.groupBy(audit, "rule").agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"))
    return sums.filter(F.col("left_n") != F.col("right_n"))


def verdicts(left: DataFrame, right: DataFrame, audits: DataFrame, audit: str) -> DataFrame:
    """For each audit (audit, pages): both sides' overall score and whether scores, counts by severity, categories and
    lists of rules agree, and all of it."""
    sides = []
    for side, found in (("left", left), ("right", right)):
        overall = scoring.overall_scores(found, audits, [audit]).select(audit, F.col("overall").alias(f"{side}_overall"), F.struct("critical", "warning", "info").alias(f"{side}_counts"))
        parts = scoring.category_scores(found, audits, [audit]).groupBy(audit).agg(F.array_sort(F.collect_list(F.struct("category", "score"))).alias(f"{side}_parts"))
        sides.append(overall.join(parts, audit))
    differ = rule_differences(left, right, audit).groupBy(audit).agg(F.count("*").alias("differing"))
    rows = sides[0].join(sides[1], audit).join(differ, audit, "left")
    same = {"overall": F.col("left_overall") == F.col("right_overall"), "counts": F.col("left_counts") == F.col("right_counts"), "categories": F.col("left_parts") == F.col("right_parts"), "rules": F.col("differing").isNull()}
    return rows.select(audit, "left_overall", "right_overall", *[c.alias(f"same_{n}") for n, c in same.items()])
