"""Quotas request by request against a plain fold, and the usage stream against the batch count."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shirabe import storage
from shirabe.operators import admission, store
from shirabe.storage import new_path
from shirabe.streaming import usage

ROWS = "id long, owner string, kind string, start timestamp, end timestamp"
LIMITS = {"audit": 3, "advice": 1, "never": 0}


def fold(rows, limits, admins=()):
    """{id: accepted}, one request after another."""
    recorded, out = {}, {}
    for id_, owner, kind, start, end in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        used = [e for e in recorded.get((owner, kind), []) if e <= start and (e.year, e.month) == (start.year, start.month)]
        out[id_] = kind not in limits or (owner or "").lower().lstrip("@") in admins or len(used) < limits[kind]
        if out[id_] and end:
            recorded.setdefault((owner, kind), []).append(max(start, end))
    return out | {r[0]: False for r in rows if not r[3]}


def requests(seed, n=600):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 24 * 150))
        end = r.choice([None, start, start + timedelta(hours=r.choice([1, 30, 24 * 20, 24 * 45]))])
        rows.append((i, r.choice(["hot", "hot", "a", "b", None, "@Boss"]), r.choice(["audit", "audit", "advice", "never", "other", None]), start, end))
    return [*rows, (n, "a", "audit", None, None), (n + 1, "a", "audit", datetime(2024, 2, 1), datetime(2024, 1, 1))]


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (2, 0)])
def test_admission_equals_a_fold(spark, monkeypatch, seed, most):
    monkeypatch.setattr(storage, "MOST_BROADCAST", most)
    rows = requests(seed)
    admitted = admission.admit(spark.createDataFrame(rows, ROWS), LIMITS, ("boss",))
    want = fold(rows, LIMITS, ("boss",))
    assert {r["id"]: r["accepted"] for r in admitted.collect()} == want
    assert 0 < sum(want.values()) < len(want)
    used = admission.usage(admitted).collect()
    assert sorted((str(r["owner"]), str(r["kind"]), r["created_at"]) for r in used) == sorted((str(o), str(k), max(s, e)) for i, o, k, s, e in rows if want[i] and e)


def test_a_refused_request_frees_next_month(spark):
    """Refused in January, it would have ended in February: February's quota is untouched."""
    d = datetime
    rows = [(i, "a", "audit", d(2024, 1, 2 + i), d(2024, 1, 2 + i)) for i in range(3)]
    rows += [(3, "a", "audit", d(2024, 1, 31), d(2024, 2, 2)), (4, "a", "audit", d(2024, 2, 3), d(2024, 2, 3)), (5, "a", "audit", d(2024, 2, 4), d(2024, 2, 4)), (6, "a", "audit", d(2024, 2, 5), d(2024, 2, 5)), (7, "a", "audit", d(2024, 2, 6), None)]
    got = {r["id"]: r["accepted"] for r in admission.admit(spark.createDataFrame(rows, ROWS), LIMITS).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_admission_of_nothing(spark):
    assert admission.admit(spark.createDataFrame([], ROWS), LIMITS).collect() == []
    assert admission.admit(spark.createDataFrame([(1, "a", "never", datetime(2024, 1, 1), None)], ROWS), {"never": 0}).first()["accepted"] is False


def events(seed, n=400):
    r = random.Random(seed)
    start = datetime(2024, 1, 20)
    return [(str(i), r.choice(["hot", "a", None]), r.choice(["audit", "advice"]), start + timedelta(minutes=r.randint(0, 60 * 24 * 25))) for i in range(n)]


def counted(df):
    return sorted(((str(r["owner"]), r["kind"], r["month"], r["used"]) for r in df.collect()))


def test_stream_equals_batch_in_any_order(spark):
    rows = events(3)
    want = counted(store.usage_by_month(spark.createDataFrame(rows, usage.EVENTS), "owner", "kind", "at"))
    for seed in (1, 2):
        landing, sink, state = (new_path(spark, n) for n in ("landing", "sink", "state"))
        order = rows + random.Random(seed).sample(rows, 80)  # some come again
        random.Random(seed).shuffle(order)
        for lo in range(0, len(order), 160):
            spark.createDataFrame(order[lo : lo + 160], usage.EVENTS).coalesce(1).write.mode("append").parquet(landing)
            if lo == 160:  # stopped and started again in between
                usage.count_usage(spark, landing, sink, state, late="40 days", files=1).awaitTermination()
        usage.count_usage(spark, landing, sink, state, late="40 days", files=1).awaitTermination()
        assert counted(usage.usage_counts(spark, sink)) == want
        assert counted(usage.usage_counts(spark, sink, "2024-01")) == [w for w in want if w[2].month == 1]
        usage.compact(spark, sink, into := new_path(spark, "compact"))
        assert counted(usage.usage_counts(spark, into)) == want


def test_events_behind_the_watermark_are_dropped(spark):
    landing, sink, state = (new_path(spark, n) for n in ("landing", "sink", "state"))
    d = datetime
    for rows in ([("1", "a", "audit", d(2024, 1, 5))], [("2", "a", "audit", d(2024, 3, 1))], [("3", "a", "audit", d(2024, 1, 6)), ("4", "a", "audit", d(2024, 2, 29, 12))]):
        spark.createDataFrame(rows, usage.EVENTS).coalesce(1).write.mode("append").parquet(landing)
        usage.count_usage(spark, landing, sink, state, late="3 days").awaitTermination()
    found = {(r["month"].month, r["used"]) for r in usage.usage_counts(spark, sink).collect()}
    assert found == {(1, 1), (2, 1), (3, 1)}
