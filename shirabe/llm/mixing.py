"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. With a target of r times its size, every document of
the source is copied floor(r) times for certain, and the rest of the target is drawn without
repeats, with unequal probabilities: a document's inclusion probability is in proportion to its words,
min(1, rate * words), where the rate of a source makes the expected words equal to the rest. Documents
that come to 1 are certain. Ranks are the odds of a random number divided by the odds of the
inclusion probability (Pareto order sampling; certain documents have rank 0), and the smallest ranks
are taken. The sample's size is fixed in words, which is what targets are in: the cut lies where the
drawn words come nearest to the rest, so they miss it by at most half a document.

The random number is a digest of the document's id and a seed, and, of equal rows from the second on, their
number among them, so reruns agree and nothing depends on partitions. No source is gathered in one task: sizes are counted by source and value for the
rates, words are summed by source and by bin of the rank, a running sum over the bins finds the bin in
which the rest is reached, and only that bin's documents (about 1/BINS of the source) are put in order.

Cases: null text has size 0; a null source is a source of its own, last in order; rows of size 0
are taken 0 times; a null id counts as the string 'null' for its random number; repeated rows are
separate rows with random numbers of their own, and as they are alike it doesn't matter which of them is taken; ties
are broken by id, size, text digest and number; very long texts count as one document of their size; an empty table
gives an empty result; extra columns are kept, and a name of docs that clashes with one of the
result's moves that one to the name with '_' behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.storage import numbered, numbered_within, small, store, unused

BINS = 4096
#: Rows up to which the table of sources is broadcast.
MOST_BROADCAST = 100_000
#: Columns that `mix` adds.
ADDED = ("mx_size", "mx_source_size", "mx_target", "mx_copies")
TIES = ("mx_id", "mx_size", "mx_tie", "mx_number")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: starts of runs of other than white space. Null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inclusion() -> Column:
    """Inclusion probability of a row of mx_size words at its source's mx_rate."""
    return F.least(F.lit(1.0), F.col("mx_rate") * F.col("mx_size"))


def pareto_rank() -> Column:
    """Odds of the random number over odds of the inclusion probability."""
    u, pi = F.col("mx_u"), inclusion()
    return (u / (1 - u)) * ((1 - pi) / pi)


def rank_bin() -> Column:
    """Bins of ranks, in their order; ranks are from 0 to infinity, and cuts lie near 1."""
    q = pareto_rank()
    return F.floor(q / (1 + q) * BINS).cast("int")


def equal_rows(base: DataFrame) -> DataFrame | None:
    """mx_same (place of the row) and mx_more (its number, from 0) of rows that equal others; None without any. Counts
    find the sets of equal rows, and only these rows are numbered, by range partitions where they are many."""
    by = ["mx_key", "mx_id", "mx_size", "mx_tie"]
    sets = base.groupBy(*by).agg(F.count("*").alias("mx_n")).filter("mx_n > 1").select(F.struct(*by).alias("mx_set"))
    sets = store(sets, "mix-equal")
    if not (n := sets.count()):
        return None
    rows = base.select(F.struct(*by).alias("mx_which"), F.col("mx_at").alias("mx_same"))
    rows = rows.join(small(sets, n), F.col("mx_which").eqNullSafe(F.col("mx_set")), "left_semi")
    rows = numbered_within(store(rows, "mix-again"), "mx_which", [F.col("mx_same")], "mix-numbers", "mx_more")
    return store(rows.select("mx_same", "mx_more"), "mix-numbers")


def rates(base: DataFrame, goals: DataFrame) -> DataFrame:
    """mx_rated (source) and mx_rate: min(1, rate * words), times words, adds up to mx_rest over the
    source. Documents from a size on are certain: the rate is the first, going down in size, that
    leaves its own size below 1. One row for each size that a source has."""
    sizes = base.filter("mx_size > 0").groupBy("mx_key", "mx_size").agg(F.count("*").alias("mx_n"))
    down = Window.partitionBy("mx_key").orderBy(F.col("mx_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("mx_key").orderBy(F.col("mx_size").desc()).rowsBetween(0, Window.unboundedFollowing)
    n, size = F.col("mx_n"), F.col("mx_size")
    sizes = sizes.withColumn("mx_larger", F.coalesce(F.sum(n * size).over(down), F.lit(0))).withColumn("mx_squares", F.sum(n * size * size).over(onward))
    sizes = sizes.withColumnRenamed("mx_size", "mx_one").join(goals.select("mx_source", "mx_rest"), F.col("mx_key").eqNullSafe(F.col("mx_source")))
    rate = (F.col("mx_rest") - F.col("mx_larger")) / F.col("mx_squares").cast("double")
    sizes = sizes.withColumn("mx_rate", rate).filter(F.col("mx_rate") * F.col("mx_one") < 1)
    return sizes.groupBy(F.col("mx_key").alias("mx_rated")).agg(F.max_by("mx_rate", "mx_one").alias("mx_rate"))


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int], cap: int, share: float = 1.0) -> DataFrame:
    """source, source_size, target for each source: `share` of all words, split by weight (dealt
    to the sources in code point order, null last, repeating), no target above cap times its source.

    Targets are min(cap * size, level * weight). The level rises from round to round as what exceeds a
    cap goes to the others, and stays when no further source reaches its cap; a round sums one narrow row
    per source, and three numbers reach the driver."""
    per = sizes.groupBy(F.col(source).alias("mx_source")).agg(F.sum(size).alias("mx_size"))
    per = numbered(per, [F.col("mx_source").asc_nulls_last()], "mix-sources", "mx_place")
    per = per.withColumn("mx_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("mx_place") % len(weights) + 1).cast("int")))
    most = F.lit(cap) * F.col("mx_size")
    goal = float(share) * float(per.agg(F.sum("mx_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("mx_w") > most
        n, words, weight = per.agg(F.count_if(full), F.sum(F.when(full, F.col("mx_size"))), F.sum(F.when(~full, F.col("mx_w")))).first()
        if n == capped or not weight:
            break
        capped, level = n, (goal - cap * float(words or 0)) / float(weight)
    target = F.least(F.col("mx_size") * F.lit(float(cap)), F.lit(level) * F.col("mx_w") if weight else F.col("mx_size") * F.lit(float(cap)))
    return per.select("mx_source", "mx_size", target.alias("mx_target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
    share: float = 1.0,
    narrow: bool = False,
) -> DataFrame:
    """Rows of docs with mx_size, mx_source_size, mx_target and mx_copies (how often the mix takes
    the row). narrow: keep only the id and the source of docs. Texts are read and their words counted once."""
    kept = [doc_id, source] if narrow else docs.columns
    own = [F.col(source).alias("mx_key"), word_count(F.col(text)).alias("mx_size"), F.col(doc_id).alias("mx_id"), F.xxhash64(F.col(text)).alias("mx_tie")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("mx_row")
    wide = store(docs.select(row, *own, F.monotonically_increasing_id().alias("mx_at")), "mix-rows")
    again = equal_rows(wide.drop("mx_row"))
    if again is None:
        wide = wide.withColumn("mx_number", F.lit(0).cast("long"))
    else:
        wide = wide.join(small(again, again.count()), F.col("mx_at") == F.col("mx_same"), "left").withColumn("mx_number", F.coalesce("mx_more", F.lit(0).cast("long"))).drop("mx_same", "mx_more")
    number = F.when(F.col("mx_number") > 0, F.concat(F.lit(":"), F.col("mx_number").cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("mx_id").cast("string"), F.lit("null")), F.lit(f":{seed}"), number))
    # 48 bits, never 0 or 1
    wide = wide.withColumn("mx_u", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48))
    base = wide.drop("mx_row")
    goals = source_targets(base, "mx_key", "mx_size", weights, cap, share)
    rate = F.when(F.col("mx_size") > 0, F.col("mx_target") / F.col("mx_size")).otherwise(F.lit(0.0))
    goals = goals.select(
        "mx_source",
        F.col("mx_size").alias("mx_source_size"),
        "mx_target",
        F.least(F.floor(rate), F.lit(cap)).cast("long").alias("mx_whole"),
    )
    goals = store(goals.withColumn("mx_rest", F.col("mx_target") - F.col("mx_whole") * F.col("mx_source_size")), "mix-targets")
    goals = goals.join(rates(base, goals), F.col("mx_source").eqNullSafe(F.col("mx_rated")), "left").drop("mx_rated")
    goals = store(goals.withColumn("mx_rate", F.when(F.col("mx_rest") > 0, F.col("mx_rate"))), "mix-rates")
    # A broadcast only where the count of sources shows that it is small; else a join by source,
    # which adaptive execution splits where a source is hot.
    few = F.broadcast if goals.count() <= MOST_BROADCAST else (lambda df: df)
    ranked = base.filter("mx_size > 0").join(few(goals.filter("mx_rate > 0")), F.col("mx_key").eqNullSafe(F.col("mx_source")))
    ranked = ranked.withColumn("mx_bin", rank_bin())
    bins = ranked.groupBy("mx_source", "mx_bin", "mx_rest").agg(F.sum("mx_size").alias("mx_sum"))
    ahead = Window.partitionBy("mx_source").orderBy("mx_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("mx_before", F.coalesce(F.sum("mx_sum").over(ahead), F.lit(0)))
    edge = bins.filter("mx_before < mx_rest AND mx_before + mx_sum >= mx_rest").select(
        F.col("mx_source").alias("mx_edge_source"), F.col("mx_bin").alias("mx_edge"), "mx_before"
    )
    edge = ranked.join(few(edge), F.col("mx_source").eqNullSafe(F.col("mx_edge_source")) & (F.col("mx_bin") == F.col("mx_edge")))
    run = Window.partitionBy("mx_source").orderBy(pareto_rank().asc(), *(F.col(c).asc_nulls_first() for c in TIES)).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("mx_ahead", F.col("mx_before") + F.coalesce(F.sum("mx_size").over(run), F.lit(0)))
    # The first row that is not drawn: a row is drawn while its middle lies below the target.
    stop = (
        edge.filter("mx_ahead + mx_size / 2 > mx_rest")
        .groupBy("mx_source")
        .agg(F.min(F.struct(pareto_rank().alias("q"), *TIES)).alias("mx_stop"))
        .withColumnRenamed("mx_source", "mx_stop_source")
    )
    plan = goals.join(stop, F.col("mx_source").eqNullSafe(F.col("mx_stop_source")), "left")
    # Where rounding puts the stop behind the edge's bin, its first row is the first of the next bin.
    later = edge.groupBy("mx_source").agg(F.max("mx_bin").alias("mx_last")).withColumnRenamed("mx_source", "mx_last_source")
    plan = plan.join(later, F.col("mx_source").eqNullSafe(F.col("mx_last_source")), "left")
    plan = store(plan.drop("mx_stop_source", "mx_last_source"), "mix-plan")
    rows = wide.join(few(plan), F.col("mx_key").eqNullSafe(F.col("mx_source")))
    key = F.struct(pareto_rank().alias("q"), *TIES)
    inside = F.when(F.col("mx_stop").isNotNull(), key < F.col("mx_stop")).otherwise(rank_bin() <= F.coalesce(F.col("mx_last"), F.lit(BINS)))
    drawn = F.when((F.col("mx_rate") > 0) & inside, 1).otherwise(0)
    copies = F.when(F.col("mx_size") > 0, F.col("mx_whole") + drawn).otherwise(0).cast("long")
    names = unused(ADDED, kept)
    found = zip(ADDED, (F.col("mx_size"), F.col("mx_source_size"), F.col("mx_target"), copies), strict=True)
    return rows.select("mx_row.*", *[c.alias(names[n]) for n, c in found])


def repeat(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs only."""
    copies = unused(ADDED, docs.columns)["mx_copies"]
    again = unused(("mx_n",), [*docs.columns, *unused(ADDED, docs.columns).values()])["mx_n"]
    mixed = mix(docs, **options).filter(F.col(copies) > 0)  # type: ignore[arg-type]
    mixed = mixed.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])
