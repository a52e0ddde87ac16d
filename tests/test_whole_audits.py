"""Whole audits: the findings of pages and those about a host."""

from collections import Counter

from pyspark.sql import functions as F

from shirabe.operators import site
from shirabe.plans import catalogue


def test_findings_about_hosts_reach_scores(spark, sf_dir):
    a = catalogue.audited(spark, sf_dir)
    facts = a.facts.filter("error = ''").select("url_host", "page_id", "title", "description").collect()
    want = Counter()
    for at, rule in ((2, "meta.title.duplicate"), (3, "meta.description.duplicate")):
        groups = Counter((r["url_host"], r[at]) for r in facts if r[at])
        want.update((host, rule) for (host, _), n in groups.items() if n > 1)
    for r in a.sites.collect():
        want.update([(r["site"], rule.id) for rule in site.SITE_RULES if _applies(rule.id, r)])
    got = Counter((r["url_host"], r["rule"]) for r in a.findings.filter("part = 1").collect())
    assert got == want and {rule for _, rule in want} > {"crawl.robots.missing", "crawl.sitemap.missing", "content.broken_link"}
    totals = {r["url_host"]: r["n"] for r in a.findings.groupBy("url_host").agg(F.count("*").alias("n")).collect()}
    assert {r["url_host"]: r["total"] for r in catalogue.flagship(spark, sf_dir).collect()} == totals


def _applies(rule, r):
    return {
        "crawl.robots.missing": r["robots_txt"] is None,
        "crawl.robots.disallow_all": r["robots_txt"] is not None and r["robots_blocks_all"],
        "crawl.robots.no_sitemap": r["robots_txt"] is not None and not r["robots_sitemap"],
        "crawl.sitemap.missing": not r["sitemap_found"],
        "content.broken_link": bool(r["broken"]),
    }[rule]


def test_audits_without_a_page_have_no_score(spark, sf_dir):
    status = {r["url_host"]: r["status"] for r in catalogue.q_audit_status(spark, sf_dir).collect()}
    scored = {r["url_host"] for r in catalogue.q_score_overall(spark, sf_dir).collect()}
    assert "failed" in status.values() and scored == {h for h, s in status.items() if s == "done"}
