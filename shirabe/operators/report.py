"""Markdown reports and prompts: lines with a place, joined in order for each audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.config import SETTINGS


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def ordered(findings: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """findings with their number: by severity, category and rule, then the ties."""
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), "category", "rule", *ties)
    return findings.withColumn("number", F.row_number().over(order))


def top(findings: DataFrame, keys: list[str], ties: list[str], n: int = SETTINGS.prompt_findings) -> DataFrame:
    """The first n findings of each audit by severity alone, else in their own order."""
    order = Window.partitionBy(*keys).orderBy(severity_rank(F.col("severity")), *ties)
    return findings.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= n)


def escape_html(x: Column) -> Column:
    """Text as it may stand in HTML, also in attributes."""
    for text, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(text), F.lit(by))
    return x


def _line(df: DataFrame, key: str, section: int, place: Column, text: Column) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.lit(section).alias("section"), place.cast("long").alias("place"), text.alias("line"))


def _text(lines: list[DataFrame], key: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, lines)
    # The lines of one audit make one text; they are bounded by its pages.
    every = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return rows.groupBy("key").agg(every.alias("r")).select(F.col("key").alias(key), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("body"))


def markdown(audits: DataFrame, categories: DataFrame, findings: DataFrame, pages: DataFrame, key: str, advice: DataFrame | None = None) -> DataFrame:
    """key and body. audits: key, name, overall, page_count, critical, warning, info, verdict;
    categories: key, place, label, score; findings: key, number, severity, url, rule, evidence;
    pages: key, seq, url, title_width, text_length, error; advice: key, body."""
    f = F.format_string
    head = f("# Audit of %s\n\n- Pages: %d\n- Score: **%d** / 100\n\n%s\n", F.col("name"), F.col("page_count"), F.col("overall"), F.col("verdict"))
    counts = f("## Findings by severity\n\n- Critical: %d\n- Warning: %d\n- Info: %d\n", F.col("critical"), F.col("warning"), F.col("info"))
    found = f("### %d. [%s] %s\n\n- Page: %s\n- Measured: %s\n", F.col("number"), F.col("severity"), F.col("rule"), F.col("url"), F.col("evidence"))
    page = f("### %s\n\n- Title: %d cells\n- Text: %d characters\n", F.col("url"), F.col("title_width"), F.col("text_length"))
    lines = [
        _line(audits, key, 0, F.lit(0), head),
        _line(audits, key, 1, F.lit(0), counts),
        _line(audits, key, 2, F.lit(0), F.lit("## Scores by category\n")),
        _line(categories, key, 3, F.col("place"), f("- %s: %d", F.col("label"), F.col("score"))),
        _line(findings, key, 4, F.col("number"), F.concat(F.when(F.col("number") == 1, "\n## Findings\n\n").otherwise(""), found)),
        _line(pages.filter("error = ''"), key, 5, F.col("seq"), page),
        _line(audits, key, 7, F.lit(0), F.lit("---\n\nEvery finding is a measured value; nothing is guessed.")),
    ]
    if advice is not None:
        lines.append(_line(advice.join(audits.select(key), key, "left_semi"), key, 6, F.lit(0), f("## Advice\n\n%s\n", F.col("body"))))
    return _text(lines, key)


def prompt(audits: DataFrame, categories: DataFrame, findings: DataFrame, pages: DataFrame, key: str, most_pages: int = SETTINGS.prompt_pages) -> DataFrame:
    """key and body: measured values only. The first pages are taken before those with an error
    are left out."""
    f = F.format_string
    lines = [
        _line(audits, key, 0, F.lit(0), f("Site: %s\nScore: %d / pages: %d\n\nScores:", F.col("name"), F.col("overall"), F.col("page_count"))),
        _line(categories, key, 1, F.col("place"), f("- %s: %d", F.col("label"), F.col("score"))),
        _line(audits, key, 2, F.lit(0), F.lit("\nFindings:")),
        _line(findings, key, 3, F.col("number"), f("- [%s] %s / %s", F.col("severity"), F.col("rule"), F.substring("evidence", 1, SETTINGS.evidence_chars))),
        _line(audits, key, 4, F.lit(0), F.lit("\nPages:")),
        _line(pages.filter((F.col("seq") <= most_pages) & (F.col("error") == "")), key, 5, F.col("seq"), f("- %s (%d cells, %d characters)", F.col("url"), F.col("title_width"), F.col("text_length"))),
    ]
    return _text(lines, key)
