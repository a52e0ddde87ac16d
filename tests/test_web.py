"""Fetching from a server on this machine."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from shirabe.sources import fetch, web


class Site(BaseHTTPRequestHandler):
    def _answer(self):
        status = {"/": 200, "/gone": 404, "/moved": 302, "/loop": 302, "/inside": 302, "/nohead": 405 if self.command == "HEAD" else 200}.get(self.path, 500)
        self.send_response(status)
        if status == 302:
            self.send_header("Location", {"/moved": "./", "/loop": "/loop", "/inside": "http://127.0.0.1:22/"}[self.path])
        self.send_header("Content-Type", "text/html; charset=shift_jis")
        self.end_headers()
        if self.command == "GET":
            self.wfile.write("<title>日本</title>".encode("cp932"))

    do_GET = do_HEAD = _answer

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, base):
    paths = ["/", "/moved", "/gone", "/loop", "/inside"]
    urls = spark.createDataFrame([("a", i, base + p) for i, p in enumerate(paths)] + [("a", 9, "ftp://x.example/"), ("a", 10, None)], "audit_id string, seq int, url string")
    rows = {r["seq"]: r for r in web.fetched(urls, allow_private=True, delay=0.0).collect()}
    assert [rows[i]["status"] for i in range(5)] == [200, 200, 404, 302, 0]
    assert rows[1]["redirect_chain"] == [base + "/moved", base + "/"] and rows[1]["final_url"] == base + "/"
    assert rows[3]["error"] == "too many redirects" and "port 22" in rows[4]["error"] and rows[9]["error"] and rows[10]["error"]
    assert fetch.decode(bytes(rows[0]["body"]), rows[0]["content_type"]) == "<title>日本</title>"
    pages = fetch.landed_pages(spark.createDataFrame([r for r in rows.values()], fetch.FETCH_LOG)).collect()
    assert {r["seq"] for r in pages} == {0, 1, 2}


def test_private_addresses_are_refused(spark, base):
    (row,) = web.fetched(spark.createDataFrame([("a", 0, base)], "audit_id string, seq int, url string"), delay=0.0).collect()
    assert row["status"] == 0 and "not public" in row["error"]


def test_probe_asks_again_where_head_is_not_allowed(spark, base):
    urls = spark.createDataFrame([("a", 0, base + "/nohead"), ("a", 1, base + "/gone")], "audit_id string, seq int, url string")
    assert {r["seq"]: r["status"] for r in web.fetched(urls, "HEAD", allow_private=True, delay=0.0).collect()} == {0: 200, 1: 404}
