"""What a worker or a task holds at once."""

from __future__ import annotations

import itertools
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shirabe import storage
from shirabe.operators import crawl, store
from shirabe.plans import catalogue
from shirabe.plans.catalogue import QUERIES
from shirabe.sources import html


class _Caught:
    """Stands for pages: keeps the function that a worker runs."""

    columns = ["page_id", "url", "html"]

    def __init__(self, schema):  # noqa: ANN001, ANN204
        self.schema = schema

    def select(self, *names):  # noqa: ANN002, ANN201
        return self

    def mapInArrow(self, run, schema):  # noqa: ANN001, ANN201, N802
        return run


def test_a_worker_makes_facts_of_a_part_of_a_batch(spark):
    short = [(i, f"https://a.example/{i}", f"<title>page {i}</title>" if i % 7 else None) for i in range(1000)]
    long = [(1000 + i, f"https://a.example/{i}", f"<title>long {i}</title>" + "x" * (html.MOST_BYTES * 2 // 5)) for i in range(7)]
    rows = short + long + [(2000, "https://a.example/", "<p>" + "y" * (3 * html.MOST_BYTES)), (2001, None, "<title>last</title>")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "html"])
    run = html.extract(_Caught(spark.createDataFrame(rows[:1], "page_id bigint, url string, html string").schema))
    found = list(run(iter([batch, batch.slice(0, 0)])))
    made = [row for b in found for row in b.select(["page_id", "title", "html_bytes"]).to_pylist()]
    assert [(r["page_id"], r["title"], r["html_bytes"]) for r in made] == [(i, html.page_facts(u or "", h or "")["title"], len((h or "").encode())) for i, u, h in rows]
    for b in found:
        sizes = b.column("html_bytes").to_pylist()
        assert len(sizes) == 1 or (len(sizes) <= html.MOST_PAGES and sum(sizes) <= html.MOST_BYTES)


@pytest.mark.parametrize("broadcast", [True, False])
def test_pairs_of_viewers_and_sites_are_dealt_to_tasks(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(storage, "MOST_BROADCAST", 0)
    monkeypatch.setattr(store, "MOST_PAIRS", 2000, raising=False)
    sites = [(i, "hot" if i % 4 else str(i % 40)) for i in range(1200)] + [(5000, None)]
    viewers = [(i, "hot" if i < 10 else "@Boss" if i < 15 else str(i)) for i in range(40)] + [(900, None)]
    rows = spark.createDataFrame(sites, "id int, owner string").coalesce(1)
    seen = store.visible_to(rows, spark.createDataFrame(viewers, "viewer int, me string"), "me", ("boss",)).select("viewer", "id")
    expected = [(v, i) for v, me in viewers for i, o in sites if me == "@Boss" or (me is not None and me == o)]
    assert sorted(tuple(r) for r in seen.collect()) == sorted(expected)
    largest = seen.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    if broadcast:  # one file of sites: not one task with all pairs
        assert largest <= 2 * 2000 < len(expected) / 3


@pytest.mark.parametrize("name", ["q_dup_titles", "q_dup_descriptions"])
def test_pages_are_parsed_once_for_duplicates(spark, sf_dir, name):
    plan = QUERIES[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1


def test_table_functions_get_few_pages_at_a_time(spark, sf_dir):
    found = QUERIES["q_sql_links"].run(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert found.count()


def test_objects_of_a_worker_do_not_grow_with_the_batch(spark):
    def peak(n):  # noqa: ANN001, ANN202
        body = "<title>t</title>" + "".join(f'<a href="/{i}">x</a>' for i in range(20))
        batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"https://a.example/{i}" for i in range(n)]), pa.array([body] * n)], ["page_id", "url", "html"])
        run = html.extract(_Caught(spark.createDataFrame([(1, "", "")], "page_id bigint, url string, html string").schema))
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in run(iter([batch]))) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(10)  # what is made once
    assert peak(2048) < 1.5 * peak(512)


def test_batches_of_long_pages_end_by_bytes(spark):
    def sizes(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    pages = spark.range(900, numPartitions=1).select("id", F.repeat(F.lit("x" * 1000), 100).alias("html"))
    found = pages.mapInArrow(sizes, "n bigint, bytes bigint").collect()
    assert sum(r["n"] for r in found) == 900 and max(r["bytes"] for r in found) < (64 << 20) + (1 << 20)


def test_lists_of_links_are_not_broadcast(spark, sf_dir, monkeypatch):
    plans, whole = [], storage.store

    def seen(df, name):  # noqa: ANN001, ANN202
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return whole(df, name)

    monkeypatch.setattr(catalogue, "keep", seen)
    monkeypatch.setattr(crawl, "store", seen)
    QUERIES["q_crawl_bfs"].run(spark, sf_dir)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    joins = 0
    for lines in plans:
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                under = itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[i + 1 :])
                assert not any("links#" in x for x in under)
                joins += 1
    assert joins
