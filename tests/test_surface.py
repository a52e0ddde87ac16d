"""Rules as a table, dialects, the SQL surface, addresses, viewers, and the temporary folder."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shirabe import sql, storage
from shirabe.functions import dual as D
from shirabe.functions import text as T
from shirabe.functions import urls as U
from shirabe.operators import dialects, rules, store
from shirabe.sources import html

KANA = "これはにほんごのぶんしょうです。" * 5


def facts(spark, pages):
    rows = [(i, f"https://{host}/{i}", body, 200, elapsed, []) for i, (host, body, elapsed) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, status int, elapsed double, chain array<string>").withColumn("error", F.lit(""))
    return html.rule_facts(html.extract(df))


def page(title="A title that is long enough", head="", body=""):
    return f"<html lang='en'><head><meta charset='utf-8'><title>{title}</title>{head}</head><body><h1>x</h1>{body}</body></html>"


def test_rules_as_a_table(spark):
    own = rules.Rule("content.own", "info", "page_id = 1", "'e'")
    table = rules.to_table(spark, [*rules.PAGE_RULES[:3], own], date(2024, 1, 1))
    assert rules.from_table(table, date(2023, 12, 31)) == ()
    assert [r.id for r in rules.from_table(table, date(2024, 1, 1))] == [*(r.id for r in rules.PAGE_RULES[:3]), own.id]
    gone = spark.createDataFrame([(0, own.id, None, None, None, None, None, date(2024, 3, 1))], rules.TABLE)
    graver = spark.createDataFrame([(3, rules.PAGE_RULES[0].id, "info", "true", None, None, None, date(2024, 2, 1))], rules.TABLE)
    both = table.unionByName(gone).unionByName(graver)
    assert own.id in [r.id for r in rules.from_table(both, date(2024, 2, 29))]
    held = rules.from_table(both, date(2024, 3, 1))
    assert own.id not in [r.id for r in held] and held[-1].severity == "info"
    found = rules.findings(facts(spark, [("a.example", page(), 0.1)]), ["page_id"], held).collect()
    assert [(r["rule"], r["severity"], r["evidence"]) for r in found] == [(rules.PAGE_RULES[0].id, "info", "")]


def test_registered_rules_reach_every_query(spark, monkeypatch):
    monkeypatch.setattr(rules, "_ADDED", [])
    rules.register(rules.Rule("content.always", "info", "true", "'here'"))
    df = facts(spark, [("a.example", page(), 0.1)])
    assert "content.always" in [r["rule"] for r in rules.findings(df, ["page_id"]).collect()]
    assert [r.id for r in rules.by_category("content")][-1] == "content.always"
    assert "content.always" in [r["rule"] for r in dialects.findings(df, dialects.SINGLE_FILE, ["page_id"]).collect()]
    with pytest.raises(ValueError, match="there is a rule"):
        rules.register(rules.Rule("content.always", "info", "true", "''"))


def test_dialects_differ_where_they_say(spark):
    wide = "é" * 20 + "x" * 14  # 34 half cells, or 27 full ones
    pages = [
        ("width.example", page(title="é" * 40), 0.1),
        ("letters.example", page(body="<p>" + "ゔゝゞ々" * 2 + "ヷヸ" * 25 + "</p>"), 0.1),
        ("escapes.example", page(head='<link rel="canonical" href="https://escapes.example/%32">'), 0.1),
        ("time.example", page(), 1.4996),
        ("scripts.example", page(head='<script src="a.js"></script>' * 4), 0.1),
        ("same.example", page(title=wide), 0.1),
    ]
    df = facts(spark, pages)
    left, right = (dialects.findings(df, d, ["url_host"]) for d in (dialects.SERVICE, dialects.SINGLE_FILE))
    diff = {(r["url_host"], r["rule"]): (r["left_n"], r["right_n"]) for r in dialects.rule_differences(left, right, "url_host").collect()}
    assert diff[("width.example", "meta.title.too_long")] == (1, 0)
    assert diff[("letters.example", "japanese.lang.mismatch")] == (0, 1)
    assert diff[("escapes.example", "meta.canonical.conflict")] == (1, 0)
    assert diff[("time.example", "speed.slow")] == (0, 1)
    assert diff[("scripts.example", "speed.blocking_scripts")] == (0, 1)
    audits = df.groupBy("url_host").agg(F.count("*").alias("pages"))
    told = {r["url_host"]: (r["same_rules"], r["same_overall"]) for r in dialects.verdicts(left, right, audits, "url_host").collect()}
    assert len(told) == 6 and told["scripts.example"] == (False, False) and not any(told[h][0] for h in {h for h, _ in diff})
    assert dialects.rule_differences(left, left, "url_host").collect() == []
    sites = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "site string, robots_txt string")
    assert [r["robots_txt"] for r in dialects.site_facts(sites, dialects.SINGLE_FILE).orderBy("site").collect()] == [None, None, "x"]


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    sql.register(spark)
    urls = ["https://A.jp/x/index.html;v=1?q#f", "https://a.jp", "http://u@a.jp:8/b//", "https://[::1]/x", "no url", "", None, "https://a.jp/a;b/c;d"]
    df = spark.createDataFrame([(u, f"  a　{u} é① ") for u in urls], "url string, value string")
    df.createOrReplaceTempView("surface")
    got = spark.sql("SELECT url_host(url) AS host, normal_url(url) AS normal, display_width(value) AS width, norm_text(value) AS norm FROM surface").collect()
    u, v = D.name("url"), D.name("value")
    want = df.select(U.host(u).col, U.normalize(u).col, T.visible_length(v).col, T.norm(v).col).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_sql_tables_of_pages(spark):
    sql.register(spark)
    df = spark.createDataFrame([(1, "https://a.jp/x/", page(body='<a href="y">y</a><a href="https://b.jp/">b</a>')), (2, "https://a.jp/", None), (3, None, None)], "id int, url string, html string")
    df.createOrReplaceTempView("few_pages")
    links = spark.sql("SELECT id, l.* FROM few_pages, LATERAL page_links(url, html) l ORDER BY id, pos").collect()
    assert [tuple(r) for r in links] == [(1, 0, "https://a.jp/x/y"), (1, 1, "https://b.jp/")]
    names = spark.sql("SELECT f.value FROM few_pages, LATERAL page_facts(url, html) f WHERE f.name = 'title' AND id = 1").collect()
    assert [r[0] for r in names] == ["A title that is long enough"]


ADDRESSES = {
    "http://127.0.0.①/": False, "http://127.0.0.¹/": False, "http://ｌｏｃａｌｈｏｓｔ/": False, "http://ⓛocalhost/": False, "http://loc­alhost/": False, "http://127.0.0.1\\@example.com/": False,
    "http://example.com\\.evil/": False, "http://a\tb.example/": False, "http://127。0。0。1/": False, "http://a​b.example/": False, "http://ĳ.example/": False, "http://ſ.example/": False,
    "https://日本語.jp/": True, "https://ドメイン.example/あ": True, "https://München.example/": True, "http://a.example/x\\y": True, "http://a.example/あ b": True, "https://xn--wgv71a.jp/": True,
}


def test_names_that_lookups_map_are_refused(spark):
    df = spark.createDataFrame([(u,) for u in ADDRESSES], "url string")
    assert {r["url"]: r["ok"] for r in df.select("url", U.public_literal(D.name("url")).alias("ok")).collect()} == ADDRESSES


@pytest.mark.parametrize("most", [200_000, 0])
def test_viewers_see_rows_without_a_product(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "MOST_BROADCAST", most)
    rows = spark.createDataFrame([(i, f"o{i % 4}") for i in range(40)], "id int, owner string")
    viewers = spark.createDataFrame([(1, "o1"), (2, "@Boss"), (3, "boss"), (4, "nobody")], "viewer int, me string")
    seen = store.visible_to(rows, viewers, "me", ("boss",))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = sorted((r["viewer"], r["id"]) for r in seen.collect())
    assert got == sorted([(1, i) for i in range(1, 40, 4)] + [(v, i) for v in (2, 3) for i in range(40)])


def test_a_folder_without_a_setting():
    class Conf(dict):
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "local[2]", "local-1"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    assert storage.shared_dir(Session()).endswith("shirabe-local-1") and storage.shared_dir(Session()) == storage.shared_dir(Session())
    Session.sparkContext.master = "spark://x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
