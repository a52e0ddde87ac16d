"""Compression of vectors to codes: integer k-means per part position, entries found by vantage-point trees.

Components become integers, floor(scale * x), and a vector is cut into PARTS equal consecutive parts. Each
position has a codebook of up to ENTRIES entries. Spark deals out the vectors: each round's tasks assign their
parts and return counts and sums per (position, entry) and batch, Spark adds them up, and only the codebooks
(PARTS * ENTRIES short vectors, whatever the input) reach the driver and go with the next round's tasks.

An assignment searches a vantage-point tree over the position's entries. Every node's vantage point is an entry;
the others lie inside or outside of its median distance, with the least and greatest distance of either side.
Distances are square roots of exact integers, rounded down where they bound from below and up where they bound
from above, so a side is only passed over if each of its entries is surely farther than the best so far. A side that
may hold an equally near entry is visited, squared distances are compared as integers, and ties go to the lower
index. All vectors of a batch walk the tree together, each the nearer side first.

Cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. Repeated rows and
ids stay; the first entries are taken by id (nulls last), equal ids by their integer vectors. With fewer vectors than
ENTRIES a codebook has as many entries as there are vectors. Vectors whose length isn't that of the first, or isn't a
multiple of PARTS, stay with null code and error. Magnitudes that 64 bits can't square are computed by
Python's integers; an error that doesn't fit a long is null. Null labels are one label. An empty table gives an empty
result. Of docs the columns in `keep` stay; one named like an added one moves that to the name with '_' behind it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.llm.storage import small, store, unused

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that walk a tree together.
AT_ONCE = 8192
#: Components up to here, and their sums of squares over a part of up to 2 ** 14 components, fit 64 bits.
PLAIN = 1 << 23
ADDED = ("vc_code", "vc_error", "vc_label_error", "vc_codebooks")

Codebooks = list[np.ndarray]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of a's rows and b."""
    d = a - b
    return (d * d).sum(axis=1)


def down(square: int) -> int:
    """A distance, rounded down."""
    return math.isqrt(int(square))


def up(square: int) -> int:
    """A distance, rounded up."""
    return math.isqrt(int(square) - 1) + 1 if square else 0


def lower_roots(square: np.ndarray) -> np.ndarray:
    """Square roots, rounded down exactly."""
    if square.dtype == object:
        return np.array([math.isqrt(x) for x in square], object)
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    root += (root + 1) * (root + 1) <= square
    return root


class Node:
    """A vantage point (the index of an entry), what lies inside and outside, and between which distances."""

    __slots__ = ("entry", "sides", "bounds", "middle")

    def __init__(self, entries: np.ndarray, own: list[int]) -> None:
        # The entry farthest from the first is a good vantage point: distances from it spread.
        far = squares(entries[own], entries[own[0]])
        self.entry = own[int(np.argmax(far))]
        rest = [i for i in own if i != self.entry]
        self.sides: list[Node | None] = [None, None]
        self.bounds: list[tuple[int, int]] = [(0, 0), (0, 0)]
        self.middle = 0
        if rest:
            square = squares(entries[rest], entries[self.entry])
            order = sorted(range(len(rest)), key=lambda i: (square[i], rest[i]))
            half = (len(rest) + 1) // 2
            self.middle = int(square[order[half - 1]])
            for side, part in enumerate((order[:half], order[half:])):
                if part:
                    self.sides[side] = Node(entries, [rest[i] for i in part])
                    self.bounds[side] = (down(min(square[i] for i in part)), up(max(square[i] for i in part)))


def nearest(parts: np.ndarray, entries: np.ndarray, root: Node | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance) of each part; ties to the lower index."""
    root = root or Node(entries, list(range(len(entries))))
    best = np.full(len(parts), -1, np.int64)
    least = np.zeros(len(parts), parts.dtype)

    def visit(node: Node, rows: np.ndarray) -> None:
        square = squares(parts[rows], entries[node.entry])
        now = best[rows]
        better = (now < 0) | (square < least[rows]) | ((square == least[rows]) & (node.entry < now))
        best[rows[better]], least[rows[better]] = node.entry, square[better]
        if node.sides[0] is None:
            return
        inside = (square <= node.middle).astype(bool)
        root_ = lower_roots(square)
        for nearer, at in ((0, np.flatnonzero(inside)), (1, np.flatnonzero(~inside))):
            for side in (nearer, 1 - nearer):
                if node.sides[side] is None or not len(at):
                    continue
                low, high = node.bounds[side]
                # The true distance lies in [root, root + 1): no entry of the side is nearer than the gap.
                gap = np.maximum(np.maximum(low - (root_[at] + 1), root_[at] - high), 0)
                may = (gap * gap <= least[rows[at]]).astype(bool)
                if may.any():
                    visit(node.sides[side], rows[at[may]])

    if len(parts):
        visit(root, np.arange(len(parts)))
    return best, least


def trees(books: Codebooks) -> list[Node]:
    return [Node(b, list(range(len(b)))) for b in books]


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, or Python's where those are too small for squares."""
    values = values.astype(np.float64)
    if not len(values) or float(np.abs(values).max()) * scale <= PLAIN:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(Fraction(x) * scale) for x in values.tolist()], object)


def usable(vector: Column) -> Column:
    """No null, and no component that is null, NaN or infinite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _blocks(batch: pa.RecordBatch, size: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of a batch with their vectors as rows of integers."""
    for lo in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(lo, AT_ONCE)
        yield part, integers(part.column("vc_vector").flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, size)


def _alike(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python integers where one of them is."""
    wide = parts.dtype == object or (len(book) and int(np.abs(book).max()) > PLAIN)
    return (parts.astype(object), book.astype(object)) if wide else (parts, book.astype(np.int64))


def refine(vectors: DataFrame, books: Codebooks, parts: int, scale: int) -> Codebooks:
    """One round: each entry becomes the mean, rounded down, of the parts that are nearest to it."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        roots = trees(books)
        for batch in batches:
            for _, rows in _blocks(batch, width * parts, scale):
                for p in range(parts):
                    own, book = _alike(rows[:, p * width : (p + 1) * width], books[p])
                    best, _ = nearest(own, book, roots[p])
                    for e in np.unique(best).tolist():
                        mine = own[best == e]
                        total = [int(x) for x in mine.sum(axis=0)]
                        n, old = found.get((p, e), (0, [0] * width))
                        found[p, e] = (n + len(mine), [a + b for a, b in zip(old, total, strict=True)])
        # A row for each position, entry and place in it of this task, whatever it has read.
        rows_ = [(p, e, i, n, str(x)) for (p, e), (n, total) in found.items() for i, x in enumerate(total)]
        cols = list(zip(*rows_, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], ["part", "entry", "place", "n", "total"]
        )

    each = vectors.select("vc_vector").mapInArrow(sums, "part int, entry int, place int, n bigint, total string")
    total = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = [b.astype(object) for b in books]
    for r in total.collect():  # PARTS * ENTRIES * width rows
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def assigned(vectors: DataFrame, books: Codebooks, parts: int, scale: int) -> DataFrame:
    """vectors with vc_code and vc_error instead of vc_vector."""
    width = books[0].shape[1] if books else 0

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = trees(books)
        for batch in batches:
            for part, rows in _blocks(batch, width * parts, scale):
                total, code = np.zeros(len(rows), object), np.zeros((len(rows), parts), np.uint8)
                for p in range(parts):
                    own, book = _alike(rows[:, p * width : (p + 1) * width], books[p])
                    code[:, p], least = nearest(own, book, roots[p])
                    total = total + least
                text = [bytes(c).hex() for c in code]
                rest = part.drop_columns(["vc_vector"])
                error = [int(x) if int(x) < 1 << 63 else None for x in total]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(text, pa.string()), pa.array(error, pa.int64())], [*rest.schema.names, "vc_code", "vc_error"])

    plain = T.StructType([f for f in vectors.schema if f.name != "vc_vector"])
    return vectors.mapInArrow(codes, T.StructType([*plain, T.StructField("vc_code", T.StringType()), T.StructField("vc_error", T.LongType())]))


def digest(books: Codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress(
    docs: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    keep: Sequence[str] = ("vec_id",),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """The columns `keep` of the usable rows with vc_code (two hex digits a part), vc_error (sum of the parts'
    squared distances), vc_label_error (that summed over the label) and vc_codebooks (digest of the entries)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code's byte tells up to 256 entries apart")
    value = F.col(f"`{vector}`")
    if not isinstance(docs.schema[vector].dataType.elementType, (T.FloatType, T.DoubleType)):
        value = value.cast("array<double>")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("vc_row")
    rows = docs.filter(usable(value)).select(kept, F.col(f"`{vec_id}`").alias("vc_id"), F.col(f"`{label}`").alias("vc_label"), value.alias("vc_vector"))
    rows = store(rows, "vectors")
    first = rows.orderBy(F.col("vc_id").asc_nulls_last(), "vc_vector").select("vc_vector").limit(entries).collect()
    start = [integers(np.array(r["vc_vector"]), scale) for r in first]
    size = len(start[0]) if start and len(start[0]) % parts == 0 else 0
    width = size // parts
    start = [s for s in start if size and len(s) == size]
    books: Codebooks = [np.array([s[p * width : (p + 1) * width] for s in start], object) for p in range(parts)] if start else []
    fits = (F.size("vc_vector") == size) & F.lit(size > 0)
    alike = rows.filter(fits).select("vc_row", "vc_label", "vc_vector")
    for _ in range(rounds if books else 0):
        books = refine(alike, books, parts, scale)
    empty = (F.lit(None).cast("string").alias("vc_code"), F.lit(None).cast("long").alias("vc_error"))
    coded = rows.filter(~fits).select("vc_row", "vc_label", *empty)
    if books:
        coded = assigned(alike, books, parts, scale).unionByName(coded)
    coded = store(coded, "vector-codes")
    sums = coded.groupBy("vc_label").agg(F.sum(F.col("vc_error").cast("decimal(38,0)")).cast("string").alias("vc_total"))
    sums = store(sums.select(F.col("vc_label").alias("vc_same"), F.expr("try_cast(vc_total AS BIGINT)").alias("vc_label_error")), "vector-labels")
    found = coded.join(small(sums, sums.count()), F.col("vc_label").eqNullSafe(F.col("vc_same")), "left")
    names = unused(ADDED, keep)
    out = (F.col("vc_code"), F.col("vc_error"), F.col("vc_label_error"), F.lit(digest(books)))
    return found.select("vc_row.*", *[c.alias(names[n]) for n, c in zip(ADDED, out, strict=True)])
