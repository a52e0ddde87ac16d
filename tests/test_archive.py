"""The partitioned store: what is read, what is rewritten, what is refused."""

import os
import re

import pytest
from pyspark.sql import functions as F

from shirabe.operators.archive import Archive
from shirabe.storage import new_path


def sites(spark):
    rows = [(s + "0" * 13 + str(i), f"o{i % 2}", f"n{i}", None) for s in ("a1", "b2", "c3") for i in range(2)]
    return spark.createDataFrame(rows, "id string, owner string, name string, url string").withColumn("created_at", F.lit("2024-01-05").cast("timestamp"))


@pytest.fixture(scope="module")
def made(spark):
    to = Archive(spark, new_path(spark, "archive"))
    to.append(sites(spark), "sites")
    audits = sites(spark).select(F.col("id").alias("site_id"), "owner", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    audits = audits.withColumn("created_at", F.add_months(F.lit("2024-01-07").cast("date"), F.col("n")).cast("timestamp"))
    audits = audits.withColumn("id", F.concat(F.substring("site_id", 1, 14), F.substring("site_id", 16, 1), F.col("n").cast("string")))
    to.start(audits.select("id", "site_id", "owner", "created_at"))
    to.append(audits.select(F.col("id").alias("audit_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq")), "findings")
    to.append(audits.filter("n = 0").select(F.col("id").alias("audit_id"), "owner"), "advice", body="do")
    to.append(audits.select("owner"), "usage", kind="audit")
    return to


def files(to, kind):
    top = to.path.removeprefix("file://") + f"/{kind}"
    return {os.path.join(d, f)[len(top) :] for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_and_times_are_filled(made):
    advice = made.read("advice").collect()
    assert len(advice) == 6 and all(re.fullmatch("[a-f0-9]{16}", r["id"]) and r["id"][0] == r["audit_id"][0] and r["created_at"] for r in advice)
    assert made.read("usage").count() == 18 and made.read("findings").count() == 54


def test_point_reads_open_one_slot(made):
    one = made.get("sites", "b200000000000001")
    assert [r["name"] for r in one.collect()] == ["n1"]
    assert re.search(r"PartitionFilters: \[isnotnull\(slot#\d+\), \(slot#\d+ = b\)\]", plan(one))
    site = one.first()["id"]
    late = made.audits_of(site, "2024-02")
    assert sorted(r["period"] for r in late.collect()) == ["2024-02", "2024-03"]
    own = made.children_of("findings", late)
    assert "dynamicpruning" in plan(own).lower()
    assert own.count() == 6 and {r["site_id"] for r in own.collect()} == {site}


def test_deleting_rewrites_touched_partitions_only(spark, made):
    before = {k: files(made, k) for k in ("sites", "audits", "findings", "statuses", "advice", "usage")}
    gone = [r["id"] for r in made.read("sites").collect() if r["id"].startswith("a1") or (r["id"].startswith("b2") and r["name"] == "n0")]
    made.delete_sites(spark.createDataFrame([(g,) for g in [*gone, "ffff000000000000", None]], "id string"))
    assert {r["id"][:2] for r in made.read("sites").collect()} == {"b2", "c3"}
    assert (made.read("sites").count(), made.read("audits").count(), made.read("findings").count(), made.read("statuses").count(), made.read("advice").count(), made.read("usage").count()) == (3, 9, 27, 9, 3, 18)
    for kind, old in before.items():
        new = files(made, kind)
        for slot in ("slot=c",) if kind != "usage" else ("",):
            assert {f for f in old if slot in f} == {f for f in new if slot in f}, kind
        assert not any("slot=a" in f for f in new)
    left = made.read("findings").join(made.read("audits").select(F.col("id").alias("audit_id")), "audit_id", "left_anti")
    assert left.count() == 0
    made.delete_sites(spark.createDataFrame([(g,) for g in gone], "id string"))  # again
    assert made.read("sites").count() == 3


def test_what_is_refused(spark, made):
    for kind, row, kinds in (
        ("sites", ("XYZ",), "id string"),
        ("sites", (None,), "id string"),
        ("findings", ("c300000000000fff",), "audit_id string"),
        ("audits", ("d300000000000fff", "c300000000000000"), "id string, site_id string"),
    ):
        with pytest.raises(Exception, match="no id|no audit|not in its site's slot"):
            made.append(spark.createDataFrame([row], kinds), kind)
    with pytest.raises(ValueError, match="no table"):
        made.append(spark.range(1), "others")


def test_empty_store(spark):
    to = Archive(spark, new_path(spark, "archive"))
    assert to.read("sites").collect() == [] and to.get("audits", "a" * 16).collect() == []
    to.delete_sites(spark.createDataFrame([("a" * 16,)], "id string"))
