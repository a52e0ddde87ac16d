"""Best-fit packing of documents into sequences by a linear grouping scheme.

Documents become token pieces of at most `capacity` ids (only longer documents are cut). The
lengths' counts, at most `capacity` numbers however large the corpus is, decide the packing:

1. Large lengths are sorted and split into groups of equal cardinality; each group's lengths are
   rounded up to its largest (linear grouping).
2. Configurations of the few rounded sizes are optimised by a covering linear program with column
   generation; whole multiples of its patterns become sequences.
3. Actual documents take the places of their group, the larger first; what rounding up had
   reserved beyond their real length becomes a gap.
4. Small lengths, and the large ones that no whole pattern took, go best-fit, the longest first,
   into the smallest gap that holds them, or into new sequences.

The plan is a list of runs (a range of equal pieces into a range of sequences), of a few times
`capacity` entries at most. Pieces are put in order by one range shuffle of narrow rows, numbered
by partition counts, and find their run by binary search: no piece is gathered or joined, and
hot lengths are spread over all partitions.

Cases: null text is an empty document, which has just its end id; a null id is kept; repeated rows
are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm import encoding
from shirabe.llm import words as W
from shirabe.llm.storage import store

CAPACITY = 2048
GROUPS = 400
#: Lengths above capacity / SMALL count as large. Measured on 51,282 lengths: 0.03 % above the sum of
#: lengths divided by the capacity, against 0.7 % for 64 groups of lengths above an eighth.
SMALL = 3
#: The linear program stops when its value is within this share of its bound.
NEAR = 5e-4

Run = tuple[int, int, int, int, int, int]  # length, first rank, pieces, first sequence, pieces each, offset


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    kind: str = encoding.SPACE_PREFIX,
    capacity: int = CAPACITY,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece. The
    first piece of a long document takes what is over, so that the others are full."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer, kind)
        for batch in batches:
            for lo, hi, ids, bounds in enc.blocks(batch.column(1), end):
                n = np.diff(bounds) // 4
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n - 1) % capacity + 1
                start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[row])
                # Pieces follow one another in the block's ids, so they are stretches of one buffer.
                at = np.append(bounds[row] + 4 * start, bounds[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), encoding.sliced(ids, at).cast(pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )
        W.release()

    return docs.select(doc_id, text).mapInArrow(cut, f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary")


def _patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, list[int]]]:
    """Patterns (copies of each size) and their amounts, covering the demand: a simplex over
    generated columns, priced by a knapsack over at most capacity // min(sizes) items."""
    n, most = len(sizes), capacity // min(sizes)
    columns = [np.eye(n)[g] * (capacity // sizes[g]) for g in range(n)]
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ np.array(demand, float)
    for _ in range(40 * n):
        y = inverse.sum(axis=0)
        best, took = np.zeros(capacity + 1), []
        for _k in range(most):
            nxt, by = best.copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                if y[g] > 0:
                    v = best[: capacity + 1 - s] + y[g]
                    more = v > nxt[s:] + 1e-12
                    nxt[s:][more] = v[more]
                    by[s:][more] = g
            took.append(by)
            best = nxt
        if best[capacity] <= 1 + NEAR:
            break
        a, c = np.zeros(n), capacity
        for by in reversed(took):
            if (g := by[c]) >= 0:
                a[g] += 1
                c -= sizes[g]
        d = inverse @ a
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        x = x - step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
        columns[r] = a
    return [(float(v), [int(k) for k in c]) for v, c in zip(x, columns, strict=True)]


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Lengths (longest first, with counts) split into groups of equal cardinality; neighbours
    with the same longest length are one group."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // groups))
    out: list[list[list[int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                if not (out and out[-1][0][0] == length):
                    out.append([])
                room = each
            take = min(n, room)
            out[-1].append([length, take])
            n, room = n - take, room - take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[Run]:
    """Where the pieces of each length go; ranks count the pieces of a length from 0."""
    taken: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by gap: first sequence, sequences, used
    sequences = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, each, offset))
        taken[length] += n

    if counts.get(capacity):
        put(capacity, counts[capacity], 0, 1, 0)
        sequences = counts[capacity]
    large = [(s, n) for s, n in sorted(counts.items(), reverse=True) if n and capacity // small < s < capacity]
    if large:
        grouped = _grouped(large, groups)
        sizes, left = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
        for amount, pattern in sorted(_patterns(sizes, left, capacity), reverse=True):
            fit = [left[g] // k for g, k in enumerate(pattern) if k]
            x = min([int(amount + 1e-6), *fit]) if fit else 0
            if x <= 0:
                continue
            blocks = [(sequences, x, 0)]
            sequences += x
            for g, k in enumerate(pattern):
                left[g] -= k * x
                for _ in range(k):
                    filled = []
                    for first, n, used in blocks:
                        while n:
                            item = grouped[g][0]
                            m = min(n, item[1])
                            put(item[0], m, first, 1, used)
                            filled.append((first, m, used + item[0]))
                            first, n = first + m, n - m
                            item[1] -= m
                            if not item[1]:
                                grouped[g].pop(0)
                    blocks = filled
            for first, n, used in blocks:
                if used < capacity:
                    gaps[capacity - used].append((first, n, used))
    order = sorted(gaps)
    for length in sorted((s for s in counts if s < capacity), reverse=True):
        n = counts[length] - taken[length]
        while n:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                gap, each = capacity, capacity // length
                first, m, used = sequences, -(-n // each), 0
                sequences += m
            else:
                gap = order[i]
                each = gap // length
                first, m, used = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[i]
            whole = min(m, n // each)
            rest = n - whole * each if whole < m else 0
            for bins, k in ((whole, each), (1 if rest else 0, rest)):
                if bins:
                    put(length, bins * k, first, k, used)
                    if gap > k * length:
                        if not gaps[gap - k * length]:
                            bisect.insort(order, gap - k * length)
                        gaps[gap - k * length].append((first, bins, used + k * length))
                    first, m, n = first + bins, m - bins, n - bins * k
            if m:
                if not gaps[gap]:
                    bisect.insort(order, gap)
                gaps[gap].append((first, m, used))
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """pieces (narrow rows with doc_id, piece and length) with sequence_id and offset."""
    names = pieces.columns
    ordered = pieces.repartitionByRange(F.col("length").desc(), "doc_id", "piece").sortWithinPartitions(F.col("length").desc(), "doc_id", "piece")
    ordered = store(ordered.withColumn("pk_at", F.monotonically_increasing_id()), "packing-order")
    counts = {r[0]: r[1] for r in ordered.groupBy("length").count().collect()}  # at most `capacity` rows
    parts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("pk_at", 33).alias("p")).count().collect())  # one row a partition
    runs = plan(counts, capacity, groups)
    before, start_of = 0, {}
    for length in sorted(counts, reverse=True):
        start_of[length] = before
        before += counts[length]
    runs.sort(key=lambda r: start_of[r[0]] + r[1])
    begins = np.array([start_of[r[0]] + r[1] for r in runs], np.int64)
    table = np.array(runs, np.int64).reshape(-1, 6)
    part_ids = np.array([p for p, _ in parts], np.int64)
    part_first = np.concatenate([[0], np.cumsum([n for _, n in parts])]).astype(np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy(zero_copy_only=False)
            pos = part_first[np.searchsorted(part_ids, at >> 33)] + (at & ((1 << 33) - 1))
            run = np.searchsorted(begins, pos, "right") - 1
            length, _, _, first, each, offset = table[run].T
            k = pos - begins[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first + k // each), pa.array(offset + k % each * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ordered.mapInArrow(assign, f"{fields}, sequence_id bigint, offset bigint")


def pack_digests(docs: DataFrame, tokenizer: str, kind: str = encoding.SPACE_PREFIX, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packing with the checksum of each piece's ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer, kind, capacity, end_id)
    narrow = store(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return place(narrow, capacity)


def sequences(docs: DataFrame, tokenizer: str, kind: str = encoding.SPACE_PREFIX, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and their offsets. A sequence
    gathers at most `capacity` ids."""
    pieces = store(token_pieces(docs, tokenizer, kind, capacity, end_id), "packing-tokens")
    # Repeated rows of one document have equal pieces; their number tells them apart.
    twin = F.row_number().over(Window.partitionBy("doc_id", "piece", F.crc32("ids")).orderBy("length"))
    pieces = pieces.withColumn("pk_twin", twin).withColumn("pk_crc", F.crc32("ids"))
    placed = place(pieces.select("doc_id", "piece", "length", "pk_crc", "pk_twin"), capacity)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "piece", "pk_crc", "pk_twin")]
    full = pieces.alias("a").join(placed.alias("b"), on).select("b.sequence_id", "b.offset", "a.doc_id", "a.ids")
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return full.groupBy("sequence_id").agg(rows.alias("r")).select(
        "sequence_id",
        F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("r", lambda x: x["offset"]).alias("offsets"),
    )
