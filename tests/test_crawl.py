"""Crawls of many audits at once against queues that are worked off one address at a time."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from shirabe import storage
from shirabe.operators import crawl


def queue_order(seeds, web, budget, expand):
    """[(node, depth, kind, place)] of one audit."""
    queue, depth, out, places = deque(dict.fromkeys(seeds)), dict.fromkeys(seeds, 0), [], 0
    while queue and (budget is None or places < budget):
        node = queue.popleft()
        kind, links = web[node]
        places += kind != crawl.OTHER
        out.append((node, depth[node], kind, places if kind != crawl.OTHER else None))
        for link in links if kind == crawl.PAGE and expand else ():
            if link not in depth:
                depth[link] = depth[node] + 1
                queue.append(link)
    return out


def made(seed, sites=6, nodes=25):
    r = random.Random(seed)
    webs, seeds, audits = {}, {}, {}
    for s in range(sites):
        names = [f"n{i:02d}" for i in range(nodes if s else 4 * nodes)]
        webs[f"s{s}"] = {n: (r.choice([crawl.PAGE] * 4 + [crawl.OTHER, crawl.FAILED]), [r.choice(names) for _ in range(r.randint(0, 5))]) for n in names}
        seeds[f"s{s}"] = [r.choice(names) for _ in range(r.randint(1, 3))]
        audits[f"s{s}"] = (r.choice([None, 1, 4, 12]), r.random() < 0.8)
    return webs, seeds, audits


@pytest.mark.parametrize(("seed", "most"), [(1, 200_000), (3, 0)])
def test_crawl_equals_queues(spark, monkeypatch, seed, most):
    monkeypatch.setattr(storage, "MOST_BROADCAST", most)  # 0: range partitions and their counts
    webs, seeds, audits = made(seed)
    answers = spark.createDataFrame([(s, n, k, ls) for s, web in webs.items() for n, (k, ls) in web.items()], "site string, node string, kind string, links array<string>")
    asked = []

    def fetch(wanted):
        asked.append(wanted)
        return wanted.join(answers, ["site", "node"])

    first = spark.createDataFrame([(s, n, i) for s, ns in seeds.items() for i, n in enumerate(ns)] + [("nobody", "n01", 0)], "site string, node string, pos int")
    plans = spark.createDataFrame([(s, b, e) for s, (b, e) in audits.items()] + [("idle", 3, True)], "site string, budget long, expand boolean")
    got = {}
    for r in crawl.breadth_first(first, fetch, plans).collect():
        got.setdefault(r["site"], set()).add((r["node"], r["depth"], r["kind"], r["place"]))
    assert got == {s: set(queue_order(seeds[s], webs[s], *audits[s])) for s in webs}
    # Nothing beyond what a queue would have fetched, either.
    fetched = sum(w.count() for w in asked)
    assert fetched == sum(map(len, got.values()))


def test_crawl_of_nothing(spark):
    first = spark.createDataFrame([], "site string, node string, pos int")
    plans = spark.createDataFrame([("a", 3, True)], "site string, budget long, expand boolean")
    assert crawl.breadth_first(first, lambda x: x, plans).collect() == []


def test_numbers_within_keys(spark, monkeypatch):
    monkeypatch.setattr(storage, "MOST_BROADCAST", 0)
    rows = spark.range(5000).select((F.col("id") % 7 % 3).alias("k"), F.xxhash64("id").alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["v"]):
        want.setdefault(r["k"], []).append(r["v"])
    got = {k: [None] * len(v) for k, v in want.items()}
    for r in storage.numbered_within(rows, "k", [F.col("v")], "numbers").collect():
        got[r["k"]][r["number"]] = r["v"]
    assert got == want
