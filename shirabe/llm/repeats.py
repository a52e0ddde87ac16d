"""Passages that repeat across documents, by level-wise doubling.

A window of `window` words in a document counts as repeated if its word sequence also starts in a
document with a smaller id; every word that such a window covers is removed.

Level 1 looks at half windows (window / 2 words). Of all the half windows in a window the one with
the smallest hash is its anchor: equal windows have equal anchors at equal places, so it is enough to
count the anchors, about one for 13 words. Half windows that occur in one document only are dropped.
Level 2 extends what is left to twice the length: only windows whose anchor was repeated are hashed
and counted, each once. Windows repeated there decide what is removed. Level 3 has windows of twice
that length: two that follow one another and were both repeated; level 4 twice again, and so on,
until no candidates survive. A window of any length is repeated only if its halves are, so none is
lost. The last level that a document has part in is told as `longest`.

Documents with the same sequence of words are one document here, under the smallest id; the others
lose all their words if they have a window at all.

Sequences of documents are compared by their SHA-256; windows by two 64-bit hashes (the anchor's and
the window's own), which mix words pairwise and are not linear in them.

Cases: null text has no words; a null id keeps all its words and does not count as an occurrence;
rows that share an id and differ in text get their windows together by id; repeated rows get equal
results; very long texts are one row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.llm import words as W
from shirabe.llm.storage import discard, store

WINDOW = 50


def _slide(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum (pick) of each n consecutive values."""
    out, width = values, 1
    while width * 2 <= n:
        out = pick(out[: len(out) - width], out[width:])
        width *= 2
    return pick(out[: len(values) - n + 1], out[n - width : n - width + len(values) - n + 1])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two stretches, one after the other, from theirs."""
    return W.mix((W.mix(a + np.uint64(0x9E3779B97F4A7C15)) ^ b) * np.uint64(0x5851F42D4C957F2D))


def _stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, by doubling; the last step lets the two halves overlap."""
    out, width = hashes, 1
    while width * 2 <= n:
        out = _joined(out[: len(out) - width], out[width:])
        width *= 2
    last = len(hashes) - n + 1
    return out if width == n else _joined(out[:last], out[n - width : n - width + last])


def _anchors(hashes: np.ndarray, window: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one document: hashes of its half windows, smallest of each window, and which half
    windows are the smallest of some window."""
    grams = _stretches(hashes, half)
    inside = window - half + 1
    low = _slide(grams, inside, np.minimum)
    padded = np.concatenate([np.zeros(inside - 1, np.uint64), low, np.zeros(inside - 1, np.uint64)])
    return grams, low, _slide(padded, inside, np.maximum) == grams


def _plain(w: W.Words) -> pa.Array:
    """SHA-256 of each document's words joined by one space; bytes.split() parts where words do."""
    return pa.array([hashlib.sha256(b" ".join(w.data[s:e].tobytes().split())).hexdigest() for s, e in zip(w.bounds[:-1], w.bounds[1:], strict=True)], pa.string())


def _documents(docs: DataFrame, window: int, half: int) -> DataFrame:
    """rp_doc, n_words, the SHA-256 of the words joined by one space, and the distinct anchors' hashes."""
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                counts = np.diff(w.first)
                found = []
                for at, n in zip(w.first, counts, strict=False):
                    if n < window:
                        found.append(np.zeros(0, np.int64))
                    else:
                        grams, _, chosen = _anchors(w.hashes[at : at + n], window, half)
                        found.append(np.unique(grams[chosen]).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array(counts), _plain(w), lists], ["rp_doc", "n_words", "plain", "anchors"])

    return docs.mapInArrow(run, f"rp_doc {id_type}, n_words bigint, plain string, anchors array<bigint>")


def _windows(docs: DataFrame, window: int, half: int) -> DataFrame:
    """rp_doc, anchor, hash and start of each window whose anchor is in the row's list."""
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = batch.column(2)
            for w in W.word_chunks(batch.column(1)):
                row, anchor, own, start = [], [], [], []
                for i in range(w.hi - w.lo):
                    a, b = w.first[i], w.first[i + 1]
                    if b - a < window:
                        continue
                    hashes = w.hashes[a:b]
                    _, low, _ = _anchors(hashes, window, half)
                    keep = np.flatnonzero(np.isin(low, np.array(alive[w.lo + i].values, np.int64).view(np.uint64)))
                    if len(keep):
                        spans = _stretches(hashes, window)[keep]
                        row.append(np.full(len(keep), w.lo + i))
                        anchor.append(low[keep])
                        own.append(spans)
                        start.append(keep)
                if row:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.concatenate(row))), W.signed(np.concatenate(anchor)), W.signed(np.concatenate(own)), pa.array(np.concatenate(start).astype(np.int32))],
                        ["rp_doc", "anchor", "hash", "start"],
                    )

    return docs.mapInArrow(run, f"rp_doc {id_type}, anchor bigint, hash bigint, start int")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """doc, n_words, digest of all words, n_removed and the kept words joined by one space, for docs
    (doc, text, starts)."""
    id_type = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                removed, kept = [], []
                for i in range(w.hi - w.lo):
                    a, b = w.first[i], w.first[i + 1]
                    change = np.zeros(b - a + 1, np.int64)
                    at = batch.column(2)[w.lo + i]
                    if at.is_valid and len(at.values):
                        starts = np.array(at.values, np.int64)
                        np.add.at(change, starts, 1)
                        np.add.at(change, np.minimum(starts + window, b - a), -1)
                    keep = np.cumsum(change[:-1]) == 0
                    removed.append(int(b - a - keep.sum()))
                    spans = zip(w.starts[a:b][keep], w.ends[a:b][keep], strict=True)
                    kept.append(b" ".join([w.data[s:e].tobytes() for s, e in spans]).decode())
                columns = [pa.array(np.diff(w.first)), _plain(w), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), *columns], ["doc", "n_words", "tag", "n_removed", "kept"])

    return docs.mapInArrow(run, f"doc {id_type}, n_words bigint, tag string, n_removed bigint, kept string")


def _longest(level: DataFrame, window: int) -> DataFrame:
    """rp_doc and longest: the last length, from window on and doubling, at which the document has a
    repeated window. level: rp_doc, start, anchor and hash of the windows repeated at the first."""
    size, found = window, level.select("rp_doc").distinct().withColumn("longest", F.lit(window).cast("long"))
    found, before = [store(found, "repeats-longest")], level
    while True:
        # One window for each place, also where rows repeat an id.
        level = level.groupBy("rp_doc", "start").agg(F.min(F.struct("anchor", "hash")).alias("w")).select("rp_doc", "start", "w.anchor", "w.hash")
        after = level.select(F.col("rp_doc").alias("d"), (F.col("start") - size).alias("s"), F.xxhash64("anchor", "hash").alias("then"))
        pairs = level.join(after, (level["rp_doc"] == after["d"]) & (level["start"] == after["s"])).select("rp_doc", "start", "anchor", F.xxhash64("hash", "then").alias("hash"))
        pairs = store(pairs, "repeats-extended")
        discard(before)
        before = level = store(_repeated(pairs).drop("low"), "repeats-level")
        discard(pairs)
        if not level.limit(1).count():
            break
        size *= 2
        found.append(store(level.select("rp_doc").distinct().withColumn("longest", F.lit(size).cast("long")), "repeats-longest"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("rp_doc").agg(F.max("longest").alias("longest"))


def _repeated(windows: DataFrame) -> DataFrame:
    """The windows (rp_doc, start, anchor, hash) that occur in two documents, with the smallest as low. What occurs twice is
    written before it meets the windows again, so both sides of the join are plain and a window of very many documents is
    split over tasks."""
    twice = windows.groupBy("anchor", "hash").agg(F.min("rp_doc").alias("low"), F.max("rp_doc").alias("high")).filter("low < high").select("anchor", "hash", "low")
    twice = store(twice, "repeats-twice")
    return windows.join(twice, ["anchor", "hash"]).select("rp_doc", "start", "anchor", "hash", "low")


def find(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, candidates, hits): rp_doc, n_words, plain (the words' digest), copy (of a smaller id) and
    longest of every row; doc, text and starts of the documents with candidates; and rp_doc with
    starts, the windows that repeat. Copies are in rows alone."""
    half = window // 2
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    seen = store(_documents(own, window, half), "repeats-documents")
    # Only sequences with copies need their first; the others are left as they are.
    first = seen.filter("rp_doc IS NOT NULL").groupBy("plain").agg(F.min("rp_doc").alias("first"), F.max("rp_doc").alias("last")).filter("first < last").select("plain", "first")
    copy = F.coalesce(F.col("rp_doc") > F.col("first"), F.lit(False))
    anchors = F.when(~copy & F.col("rp_doc").isNotNull(), F.col("anchors"))
    rows = seen.join(first, "plain", "left").select("rp_doc", "n_words", "plain", copy.alias("copy"), anchors.alias("anchors"))
    rows = store(rows, "repeats-rows")
    # Level 1: half windows, of the first of each kind, that occur in two documents or more.
    level = rows.select("rp_doc", F.explode("anchors").alias("anchor"))
    twice = level.groupBy("anchor").agg(F.min("rp_doc").alias("low"), F.max("rp_doc").alias("high")).filter("low < high").select("anchor")
    twice = store(twice, "repeats-halves")
    alive = level.join(twice, "anchor").groupBy("rp_doc").agg(F.collect_set("anchor").alias("alive"))
    # Level 2: the windows around them. The list of a document is bounded by its own length.
    alive = store(alive, "repeats-alive")
    candidates = store(own.join(alive, own["doc"] == alive["rp_doc"]).select("doc", "text", "alive"), "repeats-candidates")
    # Windows found twice in rows that share id and text are one.
    windows = store(_windows(candidates, window, half), "repeats-windows")
    level = store(_repeated(windows), "repeats-level")
    discard(windows, seen, alive)
    hits = store(level.filter("rp_doc > low").groupBy("rp_doc").agg(F.collect_set("start").alias("starts")), "repeats-hits")
    longest = _longest(level.drop("low"), window)
    reach = F.when(F.col("copy") & (F.col("n_words") >= window), F.expr(f"bigint({window} * pow(2, floor(log2(n_words / {window}))))")).otherwise(F.coalesce("longest", F.lit(0)))
    rows = rows.drop("anchors").withColumnRenamed("rp_doc", "rp_own").join(longest, F.col("rp_own") == longest["rp_doc"], "left")
    rows = rows.select(F.col("rp_own").alias("rp_doc"), "n_words", "plain", "copy", reach.cast("long").alias("longest"))
    return rows, candidates.select("doc", "text"), hits


def remove(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space) of every row."""
    rows, _, hits = find(docs, window, doc_id, text)
    whole = rows.filter(F.col("copy") & (F.col("n_words") >= window)).select(F.col("rp_doc").alias("gone"), F.col("plain").alias("gone_tag")).distinct()
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    cut = _cut(own.join(hits, own["doc"] == hits["rp_doc"], "left").select("doc", "text", "starts"), window)
    cut = cut.join(whole, (cut["doc"] == whole["gone"]) & (cut["tag"] == whole["gone_tag"]), "left")
    gone = F.col("gone").isNotNull()
    removed = F.when(gone, F.col("n_words")).otherwise(F.col("n_removed"))
    return cut.select(F.col("doc").alias("doc_id"), "n_words", removed.alias("n_removed"), F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def digests(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As remove, with kept_sha256 in place of kept, and with longest. Only texts with hits are cut: a document
    without one keeps all its words, whose digest the first pass has taken."""
    rows, candidates, hits = find(docs, window, doc_id, text)
    texts = candidates.join(hits, candidates["doc"] == hits["rp_doc"]).select("doc", "text", "starts")
    cut = _cut(texts, window).select("doc", F.col("tag").alias("cut_tag"), "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")).distinct()
    out = rows.join(cut, (rows["rp_doc"] == cut["doc"]) & (rows["plain"] == cut["cut_tag"]), "left")
    gone = F.col("copy") & (F.col("n_words") >= window)
    removed = F.when(gone, F.col("n_words")).otherwise(F.when(F.col("copy"), 0).otherwise(F.coalesce("n_removed", F.lit(0))))
    digest = F.when(gone, F.sha2(F.lit(""), 256)).when(F.col("copy"), F.col("plain")).otherwise(F.coalesce("kept_sha256", "plain"))
    return out.select(F.col("rp_doc").alias("doc_id"), "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"), "longest")
