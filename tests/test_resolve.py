"""Resolution of links in columns against the standard library's."""

import itertools
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from shirabe.functions.resolve import resolve

BASES = ["https://a.jp/x/y/z.html?q=1#f", "http://a.jp", "https://a.jp/", "https://u@a.jp:8/x/", "https://a.jp/x;p/y;q?r", "https://a.jp//d//e", "https://a.jp/あ/い"]
LINKS = ["", "a", "./a", "../a", "../../a", "../../../../a", "/", "/a/../b", "/a/./b/", "..", ".", "../", "./", "a/..", "a/.", "?x=1", "#top", "?", "#", "a?b#c", "//b.jp/c/../d", "//b.jp", "http://b.jp/a/../b", "mailto:x@y", "javascript:void(0)", "tel:1",
         "a//b", "//", "a/b/../../../c", ";p", "a;p", "a;p/b", "/..", "/../x", "...", "a/...", "%2e%2e/a", " a", "a b", "a\nb", "HTTPS://b.jp/x", "data:,x", "あ/../い", "a:b", "/a;x=1/../b;y", "?a=../b", "#../b", "x/;q", "g;x=1/./y"]


def test_resolve_equals_the_standard_library(spark):
    r = random.Random(4)
    parts = ["a", "b.html", ".", "..", "", "c", "...", "あ"]
    made = ["/".join(r.choice(parts) for _ in range(r.randint(1, 9))) + r.choice(["", "?q", "#f", "?q#f"]) for _ in range(300)]
    pairs = [(b, x) for b, x in itertools.product(BASES, LINKS + made) if not (x.startswith("//") and x[2:3] in ("", "/"))]
    got = spark.createDataFrame(pairs, "base string, link string").select("base", "link", resolve(F.col("base"), F.col("link")).alias("r")).collect()
    wrong = [(r["base"], r["link"], r["r"], urljoin(r["base"], r["link"])) for r in got if r["r"] != urljoin(r["base"], r["link"])]
    assert not wrong, (len(wrong), len(got), wrong[:12])


def test_null(spark):
    assert spark.createDataFrame([("https://a.jp/", None)], "base string, link string").select(resolve(F.col("base"), F.col("link"))).first()[0] is None
