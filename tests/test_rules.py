"""A healthy page has no findings; each change to it brings the rule that names it."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shirabe.functions import urls as U
from shirabe.operators import rules, safety, scoring
from shirabe.sources import fetch, html

BASE = "https://kumo.example/notes/42"
LINES = [f"<li>{n}番目の雲は、{n * 7}分かけて西の尾根を越え、港の上で二つに分かれた。</li>" for n in range(1, 25)]
SUMMARY = "港町から見える雲の動きを一時間ごとに書き留め、形と高さと速さを比べて、翌日の風を当てるための観察の記録です。"
TITLE = "港町の雲の観察帳と風の記録"
#: Parts of a page without findings; a case changes one of them.
PARTS = {
    "open": '<!doctype html>\n<html class="log" lang="ja-JP">\n<head>',
    "preview": "".join(f"<meta content='{k}' property='og:{k}'>" for k in ("image", "title", "description")),
    "data": '<script type="application/ld+json">[{"@type": ["Dataset", "BreadcrumbList"]}]</script>',
    "more_data": "",
    "zoom": '<meta content="width=device-width" name="viewport">',
    "address": f"<link href='{BASE}' rel='canonical'>",
    "summary": f"<meta content='{SUMMARY}' name='description'>",
    "encoding": "<meta charset='utf-8'>",
    "robots": "",
    "scripts": "<script src='/late.js' defer></script>",
    "name": f"<title>{TITLE}</title></head><body>",
    "heading": "<main><h1>きょうの雲</h1>",
    "second": "<section><h2>午前</h2><h3>東の空</h3></section>",
    "list": f"<ol>{''.join(LINES)}</ol>",
    "links": "<nav><a href='../41'>前の日</a> <a href='/about'>この帳面</a></nav>",
    "picture": "<figure><img alt='雲の図' src='cloud.svg'></figure>",
    "close": "</main></body></html>",
}
CASES = {
    "crawl.noindex": {"robots": "<meta content='NoIndex' name='robots'>"},
    "crawl.nofollow": {"robots": "<meta content='index, nofollow' name='robots'>"},
    "meta.title.missing": {"name": "</head><body>"},
    "meta.title.too_long": {"name": f"<title>{'雲' * 40}</title></head><body>"},
    "meta.title.too_short": {"name": "<title>雲</title></head><body>"},
    "meta.description.missing": {"summary": ""},
    "meta.description.too_long": {"summary": f"<meta content='{SUMMARY * 3}' name='description'>"},
    "meta.description.too_short": {"summary": "<meta content='雲の記録' name='description'>"},
    "meta.canonical.missing": {"address": ""},
    "meta.canonical.conflict": {"address": "<link href='/notes/7' rel='canonical'>"},
    "heading.h1.missing": {"heading": "<main>"},
    "heading.h1.multiple": {"heading": "<main><h1>きょうの雲</h1><h1>きのうの雲</h1>"},
    "heading.level_jump": {"second": "<section><h2>午前</h2><h5>東の空</h5></section>"},
    "heading.h1_equals_title": {"heading": f"<main><h1> {TITLE} </h1>"},
    "structured.invalid": {"more_data": '<script type="application/ld+json">{"@type" "x"}</script>'},
    "structured.breadcrumb": {"data": '<script type="application/ld+json">{"@graph": [{"@type": "Dataset"}]}</script>'},
    "structured.missing": {"data": ""},
    "social.og.missing": {"preview": ""},
    "social.og.partial": {"preview": "<meta content='x' property='og:title'>"},
    "content.thin": {"list": LINES[0]},
    "content.img_alt": {"picture": "<img src=cloud.svg>"},
    "content.too_many_links": {"links": "<a href=x>y</a>" * 201},
    "content.no_internal_link": {"links": "<a href='https://sora.example/'>外</a><a href='mailto:a@kumo.example'>手紙</a>"},
    "mobile.viewport.missing": {"zoom": ""},
    "mobile.viewport.no_zoom": {"zoom": "<meta content='maximum-scale = 1' name='viewport'>"},
    "speed.blocking_scripts": {"scripts": "".join(f"<script src={n}.js></script>" for n in range(4))},
    "security.mixed_content": {"picture": '<img alt="" src="http://sora.example/a.png">'},
    "japanese.lang.missing": {"open": "<!doctype html><html><head>"},
    "japanese.lang.mismatch": {"open": "<!doctype html><html lang=fr><head>"},
    "japanese.mojibake": {"heading": "<main><h1>nuÃ©e</h1>"},
    "japanese.fullwidth_alnum": {"name": f"<title>{TITLE}２０</title></head><body>"},
    "japanese.charset.missing": {"encoding": ""},
}
FETCHED = {
    "crawl.error_status": {"status": 503}, "crawl.redirect_chain": {"chain": ["a", "b", "c", "d", "e"]}, "speed.slow": {"elapsed": 1.5}, "speed.very_slow": {"elapsed": 3.0},
    "security.no_https": {"url": BASE.replace("https", "http")},
}


def page(**changes):
    return "".join((PARTS | changes).values())


@pytest.fixture(scope="module")
def found(spark):
    base = {"url": BASE, "status": 200, "elapsed": 0.2, "chain": ["x"]}
    rows = [("healthy", page(), base)]
    rows += [(rule, page(**change), base) for rule, change in CASES.items()]
    rows += [(rule, page(), base | change) for rule, change in FETCHED.items()]
    rows.append(("index", page(address="<link rel=canonical href=./>"), base | {"url": "https://kumo.example/notes/index.html"}))
    rows.append(("http-equiv", page(encoding="<meta content='text/html; charset=EUC-JP' http-equiv=content-type>"), base))
    rows.append(("last wins", page(more_data="<meta name=description content=first>", robots="<meta property=OG:Title content=''>"), base))
    rows.append(("empty", "", base))
    df = spark.createDataFrame([(n, h, b["url"], b["status"], b["elapsed"], b["chain"]) for n, h, b in rows], "name string, html string, url string, status int, elapsed double, chain array<string>")
    hits = rules.findings(html.rule_facts(html.extract(df)), ["name"]).collect()
    out = {n: {} for n, _, _ in rows}
    for r in hits:
        out[r["name"]][r["rule"]] = r["evidence"]
    return out


def test_healthy(found):
    for name in ("healthy", "index", "http-equiv", "last wins"):
        assert found[name] == {}, name


@pytest.mark.parametrize("rule", [*CASES, *FETCHED])
def test_change_brings_rule(found, rule):
    assert rule in found[rule]


def test_all_rules_are_covered():
    assert {*CASES, *FETCHED} == {r.id for r in rules.PAGE_RULES}


def test_evidence_has_the_measure(found):
    of = lambda rule: found[rule][rule]
    assert of("meta.title.too_long").startswith("40")
    assert of("crawl.redirect_chain") == "a -> b -> c -> d"
    assert of("heading.h1.multiple") == "2: きょうの雲 / きのうの雲"
    assert of("speed.slow") == f"1.50 s, {len(page().encode()):,} bytes" and of("speed.very_slow").startswith("3.00 s, ")


def test_users_add_rules(spark):
    own = rules.Rule("content.short_title", "info", "title_width < 3", "title")
    rules.register(own)
    try:
        assert rules.every()[-1] is own
        with pytest.raises(ValueError):
            rules.register(own)
        facts = spark.createDataFrame([("a", 2), ("long", 4)], "title string, title_width int")
        assert [r["rule"] for r in rules.findings(facts, ["title"], [own]).collect()] == ["content.short_title"]
    finally:
        rules._ADDED.clear()


def test_scores(spark):
    f = spark.createDataFrame([("a", "meta", "info")], "k string, category string, severity string")
    audits = spark.createDataFrame([("a", 2), ("b", 1)], "k string, pages int")
    cats = {(r["k"], r["category"]): r["score"] for r in scoring.category_scores(f, audits, ["k"]).collect()}
    assert cats["a", "meta"] == 99 and cats["a", "crawl"] == 100 and len(cats) == 20
    assert {r["k"]: r["overall"] for r in scoring.overall_scores(f, audits, ["k"]).collect()} == {"a": 99, "b": 100}
    nested = scoring.nested_scores(scoring.category_scores(f, audits, ["k"]), scoring.overall_scores(f, audits, ["k"]), ["k"]).collect()
    assert len(nested[0]["categories"]) == 10


def test_names_need_public_addresses(spark):
    urls = spark.createDataFrame([("example.com",), ("inner.example",), ("nowhere.example",), ("https://8.8.8.8/",)], "raw string")
    known = spark.createDataFrame([("example.com", "93.184.216.34"), ("inner.example", "93.184.216.34"), ("inner.example", "10.0.0.1")], "host string, ip string")
    got = {r["raw"]: r["accepted"] for r in safety.validate(urls, known).collect()}
    assert got == {"example.com": True, "inner.example": False, "nowhere.example": False, "https://8.8.8.8/": True}


def public(address):
    """By the standard library, and what is refused here as well: shared addresses, 3fff::/20, and of
    2001::/23 also what it lets through."""
    import ipaddress

    ip = ipaddress.ip_address(address)
    shared = ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10") or ip.version == 6 and (ip in ipaddress.ip_network("2001::/23") or ip in ipaddress.ip_network("3fff::/20"))
    exempt = ip.version == 4 and ip in ipaddress.ip_network("192.0.0.0/24") or ip.version == 6 and ip not in ipaddress.ip_network("2000::/3")
    return not (shared or exempt or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


def test_literals_equal_the_standard_library(spark):
    import ipaddress
    import random

    rng = random.Random(6)
    four = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)] + [f"{a}.{b}.{c}.9" for a in (10, 100, 127, 169, 172, 192, 198, 203, 224, 8) for b in (0, 16, 18, 51, 63, 64, 127, 128, 168, 254) for c in (0, 2, 100, 113)]
    six = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)] + [str(ipaddress.IPv6Address((top << 112) | rng.getrandbits(n))) for top in (0x2001, 0x2002, 0x2606, 0x3FFF, 0xFC00, 0xFE80, 0) for n in (8, 60, 110, 112) for _ in range(8)]
    urls = [f"http://{x}/" for x in four] + [f"http://[{x}]/" for x in six]
    got = {r["raw"]: r["accepted"] for r in safety.validate(spark.createDataFrame([(u,) for u in urls], "raw string"), spark.createDataFrame([], "host string, ip string")).collect()}
    assert got == {u: public(x) for u, x in zip(urls, [*four, *six])}


def test_odd_hosts_are_refused(spark):
    bad = ["2130706433", "127.1", "127.0.0.1.", "0x7f.0.0.1", "0177.0.0.1", "1.2.3.4.5", "256.1.1.1", "[::ffff:8.8.8.8]", "[2606::1::2]", "[2606:1]", "[:2606::1]", "localhost.", "a.localhost", "１２７.0.0.1", "127。0。0。1", "a b", "x%00y", "1.2.3.0x4", ""]
    urls = spark.createDataFrame([(f"http://{h}/",) for h in bad], "raw string")
    known = spark.createDataFrame([(h, "8.8.8.8") for h in bad], "host string, ip string")
    assert not [r["raw"] for r in safety.validate(urls, known).collect() if r["accepted"]]


def test_settings_can_be_overridden():
    from shirabe import config

    assert config.overridden(config.Thresholds, {"shirabe.title_max": "40", "shirabe.slow": "2.5"}) == config.Thresholds(title_max=40, slow=2.5)
    with pytest.raises(ValueError):
        config.overridden(config.Settings, {"shirabe.probes": "many"})


def test_decoding():
    assert fetch.decode("日本".encode("cp932"), "text/html") == "日本"
    assert fetch.decode('<meta charset="euc-jp">日本'.encode("euc_jp"), "").endswith("日本")
    assert fetch.decode(b"\xff\xfe\xfa", "text/html; charset=nonsense")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_parser_takes_anything(text):
    facts = html.page_facts("https://example.com/", text)
    assert facts["text_length"] >= 0 and facts["images_without_alt"] <= facts["images_total"]


def test_landing_stream(spark, tmp_path):
    from shirabe.streaming.landing import audit_landing

    rows = [("a1", 1, BASE, None, 200, 0.1, "text/html", ["x"], page(heading="<main>").encode(), ""), ("a1", 2, "https://example.com/b", None, 0, 0.1, None, None, None, "timeout")]
    spark.createDataFrame(rows, fetch.FETCH_LOG).write.parquet(str(tmp_path / "in"))
    audit_landing(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["audit_id"], r["seq"], r["rule"]) for r in got] == [("a1", 1, "heading.h1.missing")]


def test_resolve():
    assert U.resolve("https://a.jp/x/y", "../z") == "https://a.jp/z" and U.resolve("https://a.jp", "http://[") == ""


def test_attributes():
    assert html.attributes("<IMG src=a.png alt='x > y' Data-N=\"1 &amp; 2\" async alt=second>") == {"src": "a.png", "alt": "x > y", "data-n": "1 & 2", "async": ""}
    assert html.attributes("no tag") == {}


def test_escaped_html(spark):
    from pyspark.sql import functions as F

    from shirabe.operators import report

    df = spark.createDataFrame([("<a href='x'>\"&amp;\"</a>",)], "t string")
    assert df.select(report.escape_html(F.col("t")).alias("t")).first()["t"] == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;amp;&quot;&lt;/a&gt;"
