"""The link graph: edges, probe candidates, and crawls in the order of a queue, for all audits at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.functions import dual as D
from shirabe.functions import urls as U
from shirabe.storage import counted_small, numbered_within, store

#: What an address answered: a page; something other than a page, which costs nothing; nothing, which costs as a page.
PAGE, OTHER, FAILED = "page", "other", "failed"

Fetch = Callable[[DataFrame], DataFrame]


def edges(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url_host, pos and target (normal form) of each internal link, in order of the page. links are
    whole addresses, as the parser resolves them against their page."""
    rows = facts.select(key, "url_host", F.posexplode("links").alias("pos", "absolute"))
    rows = rows.filter(U.host(D.name("absolute")).col == F.col("url_host"))
    return rows.select(key, "url_host", "pos", U.normalize(D.name("absolute")).col.alias("target"))


def seeds(sites: DataFrame, listed: DataFrame) -> DataFrame:
    """site, node and pos: the base address of a site (site, base_url) and then, of the addresses that its
    sitemap lists (site, pos, url), those of its own host, each once in order of first appearance."""
    base = sites.select("site", U.normalize(D.name("base_url")).col.alias("node"), F.lit(-1).alias("at"), U.host(D.name("base_url")).col.alias("own"))
    more = listed.select("site", U.normalize(D.name("url")).col.alias("node"), F.col("pos").alias("at"), U.host(D.name("url")).col.alias("host"))
    more = more.join(base.select("site", "own"), "site").filter("host = own").select("site", "node", "at")
    every = base.select("site", "node", "at").unionByName(more).groupBy("site", "node").agg(F.min("at").alias("at"))
    order = Window.partitionBy("site").orderBy("at", "node")
    return every.select("site", "node", (F.row_number().over(order) - 1).alias("pos"))


def candidates(links: DataFrame, known: DataFrame, site: str, order: list[str], most: int = 20) -> DataFrame:
    """site, target and pos: internal links to no known page (url), each once in order of their first
    appearance, and no more than `most` for a site."""
    fresh = links.join(known.select(F.col("url").alias("target")).distinct(), "target", "left_anti")
    first = fresh.groupBy(site, "target").agg(F.min(F.struct(*order)).alias("at"))
    rank = F.row_number().over(Window.partitionBy(site).orderBy("at", "target"))
    return first.select(site, "target", rank.alias("pos")).filter(F.col("pos") <= most)


def breadth_first(seeds: DataFrame, fetch: Fetch, audits: DataFrame) -> DataFrame:
    """site, node, depth, kind and place of every address that the audits' crawls visit.

    Each audit (site, budget: null without one; expand: whether links are followed) has a queue of its own:
    its seeds (site, node, pos) first, then the links of each page it visits, each address once. It ends when its
    queue is empty or budget places are taken; pages and addresses that failed take one each (place, from 1, in
    the queue's order), any other kind takes none. fetch gets (site, node) and returns them with kind and links
    (addresses in order).

    All queues advance together, one level of depth after another, and nothing beyond a budget is fetched: a
    round takes of each audit as many addresses of the level as it has places left, and only what turned out to
    take none leads to a further round. Orders within an audit come from range partitions and their counts, so
    an audit's addresses may fill any number of tasks. The loop runs over levels and rounds, never over
    rows. Repeated seeds count once, at their first place; an audit without a seed, and a seed without an audit, have
    no rows."""
    level = seeds.groupBy("site", "node").agg(F.min(F.struct(F.lit(0).cast("long").alias("parent"), F.col("pos").cast("long").alias("pos"))).alias("at"))
    state = store(audits.select("site", "budget", "expand", F.lit(0).cast("long").alias("spent")), "crawl-state")
    few = counted_small(state)
    level = level.join(few(state.select("site")), "site", "left_semi")
    known: list[DataFrame] = []
    found: list[DataFrame] = []
    while True:
        level = store(level, "crawl-level")
        if not level.count():
            break
        level = numbered_within(level, "site", [F.col("at"), F.col("node")], "crawl-level", "turn")
        known.append(level.select("site", "node"))
        visited = _visit(level, fetch, state, few)
        costs = visited.filter(F.col("kind") != OTHER)
        places = numbered_within(costs.select("site", "turn"), "site", [F.col("turn")], "crawl-places", "number")
        places = places.join(few(state.select("site", "spent")), "site").select("site", "turn", (F.col("spent") + F.col("number") + 1).alias("place"))
        found.append(store(visited.select("site", "node", F.lit(len(found)).alias("depth"), "kind", "turn").join(places, ["site", "turn"], "left").drop("turn"), "crawl-found"))
        taken = places.groupBy("site").agg(F.max("place").alias("last"))
        state = store(state.join(taken, "site", "left").select("site", "budget", "expand", F.coalesce("last", "spent").alias("spent")), "crawl-state")
        follows = state.filter(F.col("expand") & (F.col("budget").isNull() | (F.col("spent") < F.col("budget")))).select("site")
        links = visited.filter(F.col("kind") == PAGE).join(few(follows), "site", "left_semi")
        links = links.select("site", F.col("turn").alias("parent"), F.posexplode("links").alias("pos", "node"))
        level = links.groupBy("site", "node").agg(F.min(F.struct("parent", F.col("pos").cast("long").alias("pos"))).alias("at"))
        level = level.join(reduce(DataFrame.unionByName, known), ["site", "node"], "left_anti")
    if not found:
        return seeds.select("site", "node", F.lit(0).alias("depth"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("place")).limit(0)
    return reduce(DataFrame.unionByName, found).select("site", "node", "depth", "kind", "place")


def _visit(level: DataFrame, fetch: Fetch, state: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """level (site, node, turn) as far as the budgets reach, with kind and links."""
    rounds: list[DataFrame] = []
    if not state.filter(F.col("budget").isNotNull()).count():
        due = level.select("site", "node", "turn")
        return store(due.join(fetch(due.select("site", "node")), ["site", "node"]).select("site", "node", "turn", "kind", "links"), "crawl-round")
    # Turns of the level that are done, and places that are left.
    at = state.select("site", F.lit(0).cast("long").alias("from"), (F.col("budget") - F.col("spent")).alias("left"))
    while True:
        due = level.join(few(at), "site").filter((F.col("turn") >= F.col("from")) & (F.col("left").isNull() | (F.col("turn") < F.col("from") + F.col("left"))))
        due = store(due.select("site", "node", "turn"), "crawl-due")
        if rounds and not due.count():
            break
        got = fetch(due.select("site", "node"))
        rounds.append(store(due.join(got, ["site", "node"]).select("site", "node", "turn", "kind", "links"), "crawl-round"))
        spent = rounds[-1].groupBy("site").agg(F.max("turn").alias("last"), F.count_if(F.col("kind") != OTHER).alias("n"))
        after = at.join(spent, "site", "left").select("site", F.coalesce(F.col("last") + 1, "from").alias("from"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"))
        at = store(after, "crawl-at")
    return reduce(DataFrame.unionByName, rounds)
