"""Documents, a file for each: retention, listing, loading, and files that are no documents."""

import os

import pytest

from shirabe.operators import documents
from shirabe.storage import new_path

SCHEMA = "url string, overall int"


def ids(n, day="20240101"):
    return [f"{day}-{i:06d}-{i:08x}" for i in range(n)]


def files(path):
    return sorted(os.listdir(path.removeprefix("file://")))


def test_saved_listed_loaded(spark):
    path = new_path(spark, "documents")
    rows = [(x, f"https://{i}", i) for i, x in enumerate(ids(9))]
    documents.save(spark.createDataFrame(rows, f"id string, {SCHEMA}"), path, kept=6)
    assert files(path) == [f"audit-{x}.json" for x in ids(9)[3:]]
    later = [(x, "https://later", 1) for x in ids(2, "20240202")]
    documents.save(spark.createDataFrame(later, f"id string, {SCHEMA}"), path, kept=6)
    assert files(path) == [f"audit-{x}.json" for x in [*ids(9)[5:], *ids(2, "20240202")]]
    got = documents.listed(spark, path, SCHEMA, 3).orderBy("id").collect()
    assert [(r["id"], r["url"], r["_corrupt"]) for r in got] == [(ids(9)[8], "https://8", None), *((x, "https://later", None) for x in ids(2, "20240202"))]
    assert [tuple(r) for r in documents.load(spark, path, ids(9)[7], SCHEMA).collect()] == [(ids(9)[7], "https://7", 7)]
    assert documents.load(spark, path, ids(9)[0], SCHEMA).collect() == [] and documents.load(spark, path, "../x", SCHEMA).collect() == []


def test_what_is_no_document_is_told(spark):
    path = new_path(spark, "documents")
    bodies = ['{"url": "a", "overall": 3}', '{"url": ', "", "[1, 2]", '{"overall": "many"}', '{\n  "url": "b"\n}']
    rows = list(zip(ids(6), bodies, strict=True))
    documents.save(spark.createDataFrame(rows, "id string, body string"), path, body="body")
    got = {r["id"]: r for r in documents.listed(spark, path, SCHEMA).collect()}
    assert sorted(got) == ids(6)
    assert [got[x]["_corrupt"] is None for x in ids(6)] == [True, False, False, False, False, True]
    assert got[ids(6)[0]]["overall"] == 3 and got[ids(6)[5]]["url"] == "b"
    assert documents.load(spark, path, ids(6)[1], SCHEMA).collect() == []


def test_odd_folders_and_ids(spark):
    path = new_path(spark, "documents")
    assert documents.listed(spark, path, SCHEMA).collect() == []
    documents.save(spark.createDataFrame([], f"id string, {SCHEMA}"), path)
    assert documents.listed(spark, path, SCHEMA).columns == ["id", "url", "overall", "_corrupt"]
    for bad in ("x", None, "20240101-000000-XYZ00000"):
        with pytest.raises(Exception, match="no document id"):
            documents.save(spark.createDataFrame([(bad, "a", 1)], f"id string, {SCHEMA}"), path)
