"""Types of JSON-LD from VARIANT columns against the parser's, which reads blocks by Python's json."""

import pytest
from pyspark.sql import functions as F

from shirabe.functions import jsonld
from shirabe.sources import html

BLOCKS = [
    '{"@type": "A"}', '{"@type": ["A", "B", null, 1, {"x": 1}]}', '[{"@type": "A"}, "x", 3, null, [{"@type": "No"}], {"@type": ["C"]}]', '{"@type": true, "@graph": [{"@type": "C"}, "x", {"@type": ["D", 2]}]}',
    '{"@graph": {"@type": "NoList"}}', '{"@graph": [{"@graph": [{"@type": "TooDeep"}]}]}', '{"@type": "A"} x', '{"@type": "A"} {"@type": "B"}', "1, 2", "1] [2", "1} {", '"x"', "3", "null", "", "  ", "{", '{"@type": "A",}',
    '  {"@type": "\\u3042\\"q"}\n', '{"@type": {"@type": "NoText"}}', "[]", "{}", '{"type": "A"}', '{"@type": ""}',
]


def test_types_equal_the_parser(spark):
    rows = [(i, f'<html><head><script type="application/ld+json">{b}</script></head>') for i, b in enumerate(BLOCKS)]
    rows += [(100, "".join(f"<script defer type='application/LD+JSON; x=1'>{b}</script>" for b in BLOCKS[:5])), (101, "<p>none</p>"), (102, '<script type="text/javascript">{"@type": "A"}</script>')]
    got = spark.createDataFrame(rows, "id int, html string").select("id", jsonld.types(F.col("html")).alias("t"), jsonld.invalid(F.col("html")).alias("n")).collect()
    want = {i: html.page_facts("https://a.example/", h) for i, h in rows}
    assert {r["id"]: (r["t"], r["n"]) for r in got} == {i: (w["jsonld_types"], w["jsonld_invalid"]) for i, w in want.items()}


@pytest.mark.parametrize("block", ["NaN", '{"@type": "A", "@type": "B"}'])
def test_what_only_the_standard_refuses(spark, block):
    row = spark.createDataFrame([(f'<script type="application/ld+json">{block}</script>',)], "html string").select(jsonld.types(F.col("html")), jsonld.invalid(F.col("html"))).first()
    assert tuple(row) == ([], 1)


def test_null(spark):
    assert tuple(spark.createDataFrame([(None,)], "html string").select(jsonld.types(F.col("html")), jsonld.invalid(F.col("html"))).first()) == ([], 0)
