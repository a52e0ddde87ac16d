"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of symbols: each symbol runs up to and with the next character that is not an
ASCII consonant, so Latin text has about one symbol for a syllable, and scripts without such
letters one for a character. Of every K symbols in a row (a k-mer), those whose smallest inner
symbol, by hash, stands at the first or the last place are closed syncmers. Whether a k-mer is one
depends on nothing outside it, so copies and moved passages choose the same anchors.

The fingerprint is the KEPT smallest distinct hashes of the anchors, each with the place (symbols
before it) where the anchor first stands. The likeness of two fingerprints is the share of the KEPT
smallest hashes of both together that both have: an unbiased estimate of the Jaccard likeness of their
anchor sets, exact while both have at most KEPT. `aligned` matches by position: of the anchors that
both have, the share that lies on one diagonal, i.e. at one distance from each other's places (within
SLACK symbols), which tells a shared passage from scattered common phrases.

Cases: a text of fewer than K symbols has one anchor, itself; null is an empty text, whose
fingerprint is empty; two empty fingerprints have likeness 1, an empty one and another 0; a very
long text costs time in proportion to its length; an empty table gives an empty result. In
`compare`, rows that share an id are in order of the texts' hashes, rows that repeat id and text
follow one another, and each has its row in the result; null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.storage import numbered, store

K = 4
KEPT = 64
#: Symbols by which places on one diagonal may differ.
SLACK = 8
#: Cut behind every character other than an ASCII consonant.
SYMBOL = r"(?<=[^b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"
HEX = 8


def anchors(text: Column, k: int = K) -> Column:
    """The closed syncmers of a text in order, each as its 32-bit hash << 31 | place, null where a k-mer is
    none. The smallest symbol stands at an edge if no inner one is smaller than both."""
    hashes = F.transform(F.split(text, SYMBOL, -1), lambda s: F.xxhash64(s))
    packed = lambda h: F.shiftleft(F.shiftrightunsigned(h, 32), 31)

    def chosen(h: Column) -> Column:
        def pick(x: Column, i: Column) -> Column:
            inner = [F.get(h, i + n) for n in range(1, k - 1)]
            last = F.get(h, i + (k - 1))
            low = F.least(*inner) if len(inner) > 1 else inner[0]
            return F.when(F.least(x, last) <= low, packed(F.xxhash64(x, *inner, last)).bitwiseOR(i.cast("long")))

        whole = F.array(packed(F.xxhash64(h)))
        return F.when(F.size(h) < k, whole).otherwise(F.transform(F.slice(h, 1, F.size(h) - (k - 1)), pick))

    return _with(hashes, chosen)


def _with(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), 0)


def fingerprint(text: Column, k: int = K, kept: int = KEPT) -> Column:
    """The smallest distinct anchor hashes in order, each as hash << 31 | place. Null and '' give none.

    Of a long text, only the hashes below a bound are put in order, which is chosen so that 4 * kept are
    expected; where fewer than `kept` distinct ones lie below it, all are."""

    def distinct(values: Column) -> Column:
        """In order; of equal hashes the first place."""
        same = lambda s, v, i: F.shiftrightunsigned(v, 31) == F.shiftrightunsigned(F.get(s, i - 1), 31)
        return _with(F.sort_array(values), lambda s: F.filter(s, lambda v, i: (i == 0) | ~same(s, v, i)))

    def pick(p: Column) -> Column:
        found, bound = p["found"], p["bound"]
        every = distinct(F.array_compact(found))
        enough = lambda low: F.when(F.size(low) >= kept, low).otherwise(every)
        return F.slice(F.when(bound.isNull(), every).otherwise(_with(distinct(F.filter(found, lambda v: v < bound)), enough)), 1, kept)

    def bounded(found: Column) -> Column:
        n = F.size(found)
        bound = F.when(n > 8 * kept, (F.lit(float(1 << 63)) * (8 * kept) / n).cast("long"))
        return _with(F.struct(found.alias("found"), bound.alias("bound")), pick)

    return F.when(text != "", _with(anchors(text, k), bounded)).otherwise(F.array().cast("array<bigint>"))


def written(print_: Column) -> Column:
    """A fingerprint as text: HEX digits of each hash and as many of its place."""
    # A place has at most 31 bits, so a hash and a place in 64 bits are 2 * HEX digits.
    both = lambda v: F.shiftleft(F.shiftrightunsigned(v, 31), 32).bitwiseOR(v.bitwiseAND(F.lit((1 << 31) - 1)))
    return F.lower(F.array_join(F.transform(print_, lambda v: F.lpad(F.hex(both(v)), 2 * HEX, "0")), ""))


def _hashes(print_: Column) -> Column:
    return F.transform(print_, lambda v: F.shiftrightunsigned(v, 31))


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """The likeness of two fingerprints, 0 to 1."""

    def share(pair: Column) -> Column:
        both = F.slice(F.sort_array(F.array_union(pair["x"], pair["y"])), 1, kept)
        common = F.size(F.array_intersect(F.array_intersect(both, pair["x"]), pair["y"]))
        return common / F.size(both)

    either = F.size(a) + F.size(b) > 0
    return F.when(~either, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(_with(F.struct(_hashes(a).alias("x"), _hashes(b).alias("y")), share))


def aligned(a: Column, b: Column, slack: int = SLACK) -> Column:
    """Of the anchors that two fingerprints share, the share on their best diagonal; 0 if none is shared."""
    place = lambda v: v.bitwiseAND(F.lit((1 << 31) - 1))

    def on_best(d: Column) -> Column:
        most = F.array_max(F.transform(F.array_distinct(d), lambda x: F.size(F.filter(d, lambda y: F.abs(y - x) <= slack))))
        return F.when(F.size(d) > 0, most / F.size(d)).otherwise(F.lit(0.0))

    def shifts(p: Column) -> Column:
        of = lambda side: F.filter(p[side], lambda v: F.array_contains(p["common"], F.shiftrightunsigned(v, 31)))
        # Both are in order of their hashes, so the i-th of one is the i-th of the other.
        return _with(F.zip_with(of("x"), of("y"), lambda v, w: place(v) - place(w)), on_best)

    # Where nothing is shared there is nothing to match; equal fingerprints lie on one diagonal.
    common = F.array_intersect(_hashes(a), _hashes(b))
    return F.when((a == b) & (F.size(a) > 0), F.lit(1.0)).otherwise(_with(F.struct(a.alias("x"), b.alias("y"), common.alias("common")), shifts))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(places, prints). places: sy_id, sy_tag, sy_chars, sy_n (rows that repeat them) and id, tag and
    length of the document before in order of ids (of the last, for the first): narrow rows, in order by
    one range shuffle and numbered by partition counts. prints: pr_id, pr_tag and sy_print (fingerprint)."""
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("sy_id"), F.xxhash64(body).alias("sy_tag"), F.char_length(body).cast("long").alias("sy_chars"), fingerprint(body).alias("sy_print"))
    own = store(own, "syncmer-ids")
    order = [F.col("sy_id").asc_nulls_last(), F.col("sy_tag")]
    rows = own.groupBy("sy_id", "sy_tag").agg(F.max("sy_chars").alias("sy_chars"), F.count("*").alias("sy_n"))
    rows = numbered(rows, order, "syncmer-order", "pos")
    total = rows.count()
    prior = rows.select((F.col("pos") + 1).alias("pos"), F.col("sy_id").alias("sy_prev"), F.col("sy_tag").alias("sy_prev_tag"), F.col("sy_chars").alias("sy_prev_chars"))
    prior = prior.withColumn("pos", F.when(F.col("pos") == total, F.lit(0)).otherwise(F.col("pos")).cast("long"))
    placed = store(rows.join(prior, "pos").drop("pos"), "syncmer-places")
    prints = own.select(F.col("sy_id").alias("pr_id"), F.col("sy_tag").alias("pr_tag"), "sy_print")
    # Rows that repeat id and text have one fingerprint.
    if placed.filter("sy_n > 1").limit(1).count():
        prints = prints.groupBy("pr_id", "pr_tag").agg(F.min("sy_print").alias("sy_print"))
    return placed, prints


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint and next_print: each document's text with the last
    floor(n / share) code points replaced by as many of the next one's first (or all), its own and the
    next one's fingerprint."""
    places, prints = neighbours(docs, doc_id, text)
    own = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("tag", F.xxhash64("body"))
    same = own["doc"].eqNullSafe(places["sy_id"]) & (own["tag"] == places["sy_tag"])
    names = ["doc", "tag", "body", "sy_chars", "sy_n", "sy_prev", "sy_prev_tag", "sy_prev_chars", "sy_print"]
    repeats = places.filter("sy_n > 1").limit(1).count() > 0
    own = own.join(places, same)
    own = own.join(prints, own["doc"].eqNullSafe(prints["pr_id"]) & (own["tag"] == prints["pr_tag"])).select(*names)
    if repeats:  # each once here; its copies come back below
        once = own.filter("sy_n > 1").groupBy("doc", "tag").agg(*[F.min(c).alias(c) for c in names[2:]])
        own = own.filter("sy_n = 1").unionByName(once)
    mine = own.select("doc", "tag", "body", "sy_chars", "sy_n", "sy_print")
    # What a document gives to the one before it: the head that is taken, and its fingerprint.
    head = F.substring("body", F.lit(1), F.floor(F.col("sy_prev_chars") / share).cast("int"))
    given = own.select(F.col("sy_prev").alias("to"), F.col("sy_prev_tag").alias("to_tag"), head.alias("head"), F.col("sy_print").alias("next_print"))
    both = mine.join(given, mine["doc"].eqNullSafe(given["to"]) & (mine["tag"] == given["to_tag"]))
    cut = F.floor(F.col("sy_chars") / share).cast("int")
    begin = F.substring("body", F.lit(1), F.col("sy_chars").cast("int") - cut)
    out = ["doc", "sy_chars", "edited", "sy_print", "next_print"]
    rows = both.withColumn("edited", F.concat(begin, F.col("head"))).select(*out)
    if repeats:  # of n equal rows all but the last are followed by their own text
        more = mine.filter("sy_n > 1").withColumn("edited", F.concat(begin, F.substring("body", F.lit(1), cut))).withColumn("next_print", F.col("sy_print"))
        more = more.withColumn("again", F.explode(F.sequence(F.lit(2).cast("long"), F.col("sy_n"))))
        rows = rows.unionByName(more.select(*out))
    return rows.withColumnsRenamed({"doc": "doc_id", "sy_chars": "n_chars", "sy_print": "fingerprint"})


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of the documents and of their edited texts, and how like they are."""
    rows = edited(docs, doc_id, text)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_print"), "next_print",
    )
    mine, changed, after = F.col("fingerprint"), F.col("edited_print"), F.col("next_print")
    near = [likeness(mine, changed).alias("near_edited"), likeness(mine, after).alias("near_next"), aligned(mine, changed).alias("aligned_edited"), aligned(mine, after).alias("aligned_next")]
    return rows.select("doc_id", "n_chars", "edited_sha256", written(mine).alias("fingerprint"), written(changed).alias("edited_fingerprint"), *near)
