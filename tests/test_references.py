"""Titles and headings that were cut inside a character reference: queries read them as their SQL does."""

import duckdb
import pytest

from shirabe.plans.catalogue import QUERIES
from shirabe.sources import html

ENDS = ("&quot", "&quot;", "&qu", "&lt", "&gt", "&#39", "&#39;", "&copy", "&amp", "&am", "&quotx;", "&AMP", "&amp;quot")
QUERY_NAMES = tuple("q_findings_all q_h1_texts q_impl_diff q_title_width q_rules_heading q_rules_meta q_rules_table q_sql_links q_page_extract q_page_summary q_report_markdown".split())


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """A folder with pages alone: each end after a short, a fair and a long title."""
    titles = [f"{head}{end}" for head in ("Ab ", "A title of fair length ", "A title of many words and letters " * 2) for end in ENDS]
    rows = [
        (i, f"https://site{i % 3}.example/{i}", f'<html lang="en"><head><meta charset="utf-8"><title>{t}</title></head><body><h1>{t}</h1><p>text</p><a href="/{i + 1}">next</a></body></html>')
        for i, t in enumerate(titles)
    ]
    path = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", QUERY_NAMES)
def test_equals_sql(spark, cut, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{cut}/pages.parquet/*.parquet'")
    found = con.execute(QUERIES[name].sql)
    names, want = [c[0] for c in found.description], found.fetchall()
    got = [tuple(r) for r in QUERIES[name].run(spark, cut).select(*names).collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_references():
    page = '<title>{0}</title><meta name="description" content="{0}"><a href="/x?a=1&copy=2&amp;b=3">l</a><script type="application/ld+json">{{"@type": "A&quotB"}}</script>'
    for text, want in {"a &quot": "a &quot", "a &quot;": 'a "', "a &amp": "a &", "a &amp;lt": "a &lt", "&eacute;&eacute": "é&eacute", "&#39;&#39 &#x27;": "'&#39 '", "&notit; &": "&notit; &"}.items():
        facts = html.page_facts("https://a.example/", page.format(text))
        assert (facts["title"], facts["description"]) == (want, want)
        assert facts["links"] == ["https://a.example/x?a=1&copy=2&b=3"] and facts["jsonld_types"] == ["A&quotB"]
