"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

1. Signatures. A document's set of word shingles is hashed, and every element gets a random
   permutation of the signature's positions: it offers the value j + r to its j-th position
   (correlated ranks, so variance is lower than MinHash's). Level j is worked off for all elements
   at once, and stops as soon as every position of a document holds a value below j + 1. A byte of
   each value is kept; a band is ROWS bytes and its number in one 64-bit integer, so the bands are
   the whole signature.
2. Documents with equal sets are one class from here on, named by the smallest doc_id.
3. Classes with an equal band share a bucket. With 36 bands of 7 rows a pair of similarity 0.8
   shares none with a probability of 2e-4, one of 0.85 with 8e-7.
4. Rounds of pivots: in each bucket with several groups every class is paired with one pivot (at first
   the class that meets most others, later another by chance), and the pairs' links are grouped. Rounds
   go on while they find links for a share MERGING of the open classes, so a bucket of copies never
   emits its pairs.
5. The rest: classes of one bucket that are still in different groups. An element that no class of
   another group has can't be in an intersection that matters; the others are counted in CELLS parts by
   a digest. The lesser counts of two classes, added up, bound their intersection from above, exactly.
   A pair is made, once, in the first bucket that both share, if sizes and this bound allow the
   similarity. Buckets of many classes are dealt out in blocks.
6. Every link is confirmed on the full sets. Before that, pairs with a pivot whose signatures are more
   than MARGIN (4 standard deviations) below the similarity are left out. Grouping joins components by repeated hooking of the smaller label and pointer jumping
   (union-find in rounds), on tables in the shared folder.

Hot classes meet in partial aggregates; hot buckets are read by joins, which adaptive execution
splits. Nothing is collected but counts.

Elements are 64-bit hashes of words and their order, so two different shingles of a pair of documents
are taken for one with a probability of 5e-20 for each two of them.

Cases: null or wordless text has an empty set and no link; a null id can't be linked to and its row
is kept with a null component; rows that share an id count as one document for links; a very long
text is one row; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.llm import words as W
from shirabe.llm.storage import small, store

BANDS, ROWS = 36, 7
M = BANDS * ROWS
#: Rounds of pivots go on while one finds links for this share of the classes that are still open.
MERGING = 0.02
#: How far below the wanted similarity a signature's estimate may lie; its standard deviation is 0.025.
MARGIN = 0.1
#: Classes of a bucket that meet in one block of the last comparison.
BLOCK = 1000
#: Parts in which a class's elements are counted for that comparison.
CELLS = 64

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document in turn, and their bounds. A document with
    fewer words than size has its whole sequence as one."""
    counts = np.diff(w.first)
    grams = W.gram_hashes(w.hashes, size, size)
    sets, bounds = [], np.zeros(len(counts) + 1, np.int64)
    for d, n in enumerate(counts):
        a = w.first[d]
        if n >= size:
            own = np.unique(grams[a : a + n - size + 1])
        elif n:
            own = W.gram_hashes(w.hashes[a : a + n], int(n), int(n))
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(elements: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """A SuperMinHash signature of m positions for each set; each value is level << 32 | random."""
    n = len(bounds) - 1
    none = np.iinfo(np.uint64).max
    out = np.full((n, m), none, np.uint64)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(n), sizes)
    elems = elements
    perm = None
    for j in range(m):
        random = W.mix(elems + np.uint64((j + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        pick = j + (((random >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (random & np.uint64(0xFFFFFFFF))
        if perm is None:
            place = pick
        else:
            rows = np.arange(len(elems))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
        np.minimum.at(out.reshape(-1), doc * m + place, value)
        # Sets with a value below j + 1 in every position can't change any more.
        open_ = (out >= np.uint64(j + 1) << np.uint64(32)).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        stay = open_[doc]
        if perm is None:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (int(stay.sum()), m)).copy()
            rows = np.arange(len(perm))
            perm[rows, place[stay]] = 0
            perm[rows, 0] = place[stay]
        elif not stay.all():
            perm = perm[stay]
        elems, doc = elems[stay], doc[stay]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each set its bands: a byte of each of `rows` values, and the band's number above them."""
    tops = W.mix(signature) & np.uint64(0xFF)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) << np.uint64(8 * rows), (len(signature), bands)).copy()
    for r in range(rows):
        keys |= tops[:, r * bands : (r + 1) * bands] << np.uint64(8 * r)
    return keys


def likeness(x: Column, y: Column) -> Column:
    """The similarity as estimated from two arrays of bands: their share of equal bytes."""

    def differing(z: Column) -> Column:
        for n in (4, 2, 1):  # bit 0 of each byte: whether any of its bits is set
            z = z.bitwiseOR(F.shiftrightunsigned(z, n))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    unlike = F.aggregate(F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda n, z: n + differing(z))
    return 1 - unlike / F.lit(float(M))


def _sketch(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1), lower=True):
                elements, bounds = shingle_sets(w, shingle)
                sizes = np.diff(bounds)
                sums = np.zeros((2, len(elements) + 1), np.uint64)
                np.cumsum(W.mix(elements), out=sums[0, 1:])
                np.cumsum(W.mix(elements ^ _GOLD), out=sums[1, 1:])
                keys = W.mix((sums[:, bounds[1:]] - sums[:, bounds[:-1]]) + sizes.astype(np.uint64))
                some = np.flatnonzero(sizes)
                bands = np.zeros((len(sizes), BANDS), np.uint64)
                # A long text's permutations are bounded by its batch: chunks hold about 1 MB of text.
                bands[some] = band_keys(signatures(elements, np.concatenate([[0], np.cumsum(sizes[some])])))
                flat = pa.array(bands.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(sizes), W.signed(keys[0]), W.signed(keys[1]), pa.FixedSizeListArray.from_arrays(flat, BANDS).cast(pa.list_(pa.int64()))],
                    ["nd_doc", "nd_n", "nd_a", "nd_b", "nd_bands"],
                )
        W.release()

    return docs.select(doc_id, text).mapInArrow(run, f"nd_doc {id_type}, nd_n bigint, nd_a bigint, nd_b bigint, nd_bands array<bigint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc and its set as sorted unsigned 64-bit integers, for docs (doc, text)."""
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1), lower=True):
                elements, bounds = shingle_sets(w, shingle)
                raw = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(raw, pa.binary())], ["doc", "items"])
        W.release()

    return docs.select("doc", "text").mapInArrow(run, f"doc {id_type}, items binary")


def _likely(pairs: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures are not MARGIN below the wanted similarity."""
    like = likeness(F.col("x"), F.col("y")) >= percent / 100 - MARGIN
    both = pairs.join(bands.select(F.col("rep").alias("a"), F.col("bands").alias("x")), "a").join(bands.select(F.col("rep").alias("b"), F.col("bands").alias("y")), "b")
    return both.filter(like).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        W.release()

    left, right = sets.select(F.col("doc").alias("a"), F.col("items").alias("p")), sets.select(F.col("doc").alias("b"), F.col("items").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").mapInArrow(run, f"a {id_type}, b {id_type}")


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node reachable) of the nodes in edges (a, b)."""
    both = store(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = store(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    n = labels.count()
    while True:
        # Hooking: the smallest label among a node's neighbours.
        near = both.join(small(labels, n), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = near.join(small(labels, n), labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # Jumping: the label of the label.
        up = small(labels.select(F.col("node").alias("up"), F.col("label").alias("next")), n)
        stepped = hooked.join(up, hooked["label"] == up["up"]).select("node", "was", F.least("label", "next").alias("label"))
        stepped = store(stepped, "labels")
        labels = stepped.select("node", "label")
        if not stepped.filter("label != was").limit(1).count():
            return labels


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after more edges: only the groups that the edges touch are joined anew."""
    if labels is None:
        return components(edges)
    n = labels.count()
    old = small(labels, n)
    over = edges.join(old, edges["a"] == labels["node"], "left").select(F.coalesce("label", "a").alias("a"), "b")
    over = over.join(old, over["b"] == labels["node"], "left").select("a", F.coalesce("label", "b").alias("b")).filter("a != b")
    new = components(over).select(F.col("node").alias("from"), F.col("label").alias("to"))
    m = new.count()
    moved = labels.join(small(new, m), labels["label"] == new["from"], "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = new.join(old, new["from"] == labels["node"], "left_anti").select(F.col("from").alias("node"), F.col("to").alias("label"))
    return store(moved.unionByName(fresh), "labels")


def _elements(nodes: DataFrame) -> DataFrame:
    """rep, label and element of each element of the sets in nodes (rep, label, items)."""
    id_type = nodes.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                items = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                row = pa.array(np.repeat(np.arange(len(items)), [len(x) for x in items]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(np.concatenate(items))], ["rep", "label", "element"])

    return nodes.select("rep", "label", "items").mapInArrow(run, f"rep {id_type}, label {id_type}, element bigint")


def _across(open_: DataFrame, bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket, lie in different groups and may be similar: each
    once. open_: bucket, rep, n and label."""
    nodes = store(open_.select("rep", "n", "label").distinct(), "neardup-nodes")
    elements = store(_elements(nodes.join(sets, nodes["rep"] == sets["doc"])), "neardup-elements")
    outside = elements.groupBy("element").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("element")
    # Only these can be in common with a class of another group: `most` of them in all, and `cells` by a
    # digest of the element, from which upper bounds of the intersection and lower ones of the union follow.
    cell = F.pmod("element", F.lit(CELLS))
    cells = F.array(*[F.count_if(cell == i).cast("int") for i in range(CELLS)])
    most = elements.join(outside, "element").groupBy("rep").agg(F.count("*").alias("most"), cells.alias("cells"))
    nodes = nodes.join(most, "rep").filter(F.lit(100) * F.col("most") >= F.lit(percent) * F.col("n"))
    nodes = store(nodes.join(bands, "rep"), "neardup-bounds")
    rows = open_.select("bucket", "rep").join(nodes, "rep")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = store(rows.join(sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket"), "neardup-rest")
    # Blocks: one side is dealt out, the other goes to all of its bucket's blocks.
    x = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks").alias("x")
    y = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").alias("y")
    number = F.shiftrightunsigned("x.bucket", 8 * ROWS)
    first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), F.lit(True)) - 1
    common = F.aggregate(F.zip_with("x.cells", "y.cells", lambda c, d: F.least(c, d)), F.lit(0), lambda n, c: n + c)
    reach = lambda c: F.lit(100 + percent) * c >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    meets = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.label") < F.col("y.label"))
    meets = meets & (F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n"))
    meets = meets & reach(F.least("x.most", "y.most")) & (first == number) & reach(common)
    return x.join(y, meets).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that hold classes of different groups, with each class's group."""
    named = buckets.join(small(labels, labels.count()), buckets["rep"] == labels["node"], "left")
    named = named.select("bucket", "rep", "n", "degree", F.coalesce("label", "rep").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    return store(named.join(several, "bucket"), "neardup-open")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs."""
    sketch = store(_sketch(docs, doc_id, text, shingle), "neardup-sketch")
    full = sketch.filter("nd_n > 0 AND nd_doc IS NOT NULL")
    classes = full.groupBy("nd_n", "nd_a", "nd_b").agg(F.min(F.struct("nd_doc", "nd_bands")).alias("r"))
    classes = store(classes.select("nd_n", "nd_a", "nd_b", F.col("r.nd_doc").alias("rep"), F.col("r.nd_bands").alias("bands")), "neardup-classes")
    buckets = classes.select("rep", F.col("nd_n").alias("n"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size")).filter("low != high").select("bucket", "size")
    buckets = store(buckets.join(shared, "bucket"), "neardup-shared")
    # How many meet a class in its buckets: highest for the middle of a group of near copies.
    degree = store(buckets.groupBy("rep").agg(F.sum("size").alias("degree")), "neardup-degree")
    members = degree.count()
    buckets = store(buckets.drop("size").join(small(degree, members), "rep"), "neardup-buckets")
    bands = store(classes.select("rep", "bands").join(small(degree.select("rep"), members), "rep", "left_semi"), "neardup-bands")
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(small(degree.select(F.col("rep").alias("doc")), members), "doc", "left_semi")
    # Rows that share an id may have different texts; one set for each is enough.
    sets = store(_sets(texts, shingle).distinct(), "neardup-sets")
    open_ = buckets.withColumn("label", F.col("rep"))
    labels = None
    turn = 0
    while members:
        # First the middle of each bucket is its pivot; then others, another in each bucket.
        order = -F.col("degree") if not turn else F.xxhash64("rep", "bucket", F.lit(turn))
        pivots = open_.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), "rep", "n", "label")).alias("p"))
        pivots = pivots.select("bucket", F.col("p.rep").alias("b"), F.col("p.n").alias("m"), F.col("p.label").alias("lb"))
        pairs = open_.join(pivots, "bucket").filter("label != lb").filter(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
        pairs = pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
        links = store(_verified(_likely(pairs, bands, percent), sets, percent), "neardup-links")
        labels = _merged(labels, links)
        open_ = _apart(buckets, labels)
        turn += 1
        left = open_.select("rep").distinct().count()
        if links.count() < MERGING * left or not left:
            break
    if labels is not None and left:
        labels = _merged(labels, store(_verified(_across(open_.drop("degree"), bands, sets, percent), sets, percent), "neardup-links"))
    if labels is None:
        labels = classes.select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("nd_n", "nd_a", "nd_b", F.coalesce("label", "rep").alias("component"))
    named = sketch.drop("nd_bands").join(named, ["nd_n", "nd_a", "nd_b"], "left")
    component = F.when(F.col("nd_n") > 0, F.col("component")).otherwise(F.col("nd_doc"))
    component = F.when(F.col("nd_doc").isNotNull(), component)
    return named.select(
        F.col("nd_doc").alias("doc_id"), F.col("nd_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("nd_doc")).alias("kept")
    )


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents of a group other than its first; columns stay."""
    out = near_duplicates(docs, shingle, percent, doc_id, text).filter("NOT kept").select(F.col("doc_id").alias("nd_out")).distinct()
    return docs.join(out, docs[doc_id] == out["nd_out"], "left_anti")
