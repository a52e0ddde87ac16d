"""Scores: category scores, the overall score and counts of severities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.config import CATEGORIES, OTHER_WEIGHT, WEIGHTS


def weight(severity: Column) -> Column:
    out: Column | None = None
    for name, points in WEIGHTS.items():
        out = F.when(severity == name, points) if out is None else out.when(severity == name, points)
    assert out is not None
    return out.otherwise(OTHER_WEIGHT)


def _score(points: Column, pages: Column) -> Column:
    raw = F.lit(100) - F.coalesce(points, F.lit(0)) / F.greatest(pages, F.lit(1))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw + 0.5))).cast("int")


def category_scores(findings: DataFrame, audits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A score for each audit and each of the categories, with findings or not. audits: keys, pages."""
    labels = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("label")) for c, n in CATEGORIES]))
    every = audits.select(*keys, "pages", labels.alias("c")).select(*keys, "pages", "c.*")
    points = findings.groupBy(*keys, "category").agg(F.sum(weight(F.col("severity"))).alias("points"))
    return every.join(points, [*keys, "category"], "left").select(*keys, "category", "label", _score(F.col("points"), F.col("pages")).alias("score"))


def overall_scores(findings: DataFrame, audits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The score over all findings (not the mean of the categories), counts and pages."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    sums = findings.groupBy(*keys).agg(F.sum(weight(F.col("severity"))).alias("points"), *[count(s) for s in WEIGHTS], F.count("*").alias("total"))
    joined = audits.join(sums, list(keys), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(*keys, _score(F.col("points"), F.col("pages")).alias("overall"), *[none(s) for s in WEIGHTS], none("total"), F.col("pages").cast("long").alias("pages"))


def nested_scores(categories: DataFrame, overall: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each audit: overall, a map of the categories, counts, pages and total."""
    cats = categories.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("label", "score")))).alias("categories"))
    counts = F.struct(*WEIGHTS).alias("counts")
    return overall.join(cats, list(keys), "left").select(*keys, "overall", "categories", counts, "pages", "total")


def verdict(score: Column) -> Column:
    """One of four bands."""
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "needs work").otherwise("poor")


def score_class(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 70, "mid").otherwise("bad")


SEVERITY_LABELS = {"critical": "Critical", "warning": "Warning", "info": "Info"}


def severity_label(severity: Column) -> Column:
    """What reports call a severity; an unknown one stays as it is."""
    out = severity
    for name, label in SEVERITY_LABELS.items():
        out = F.when(severity == name, label).otherwise(out)
    return out
