"""Token ids in seekable binary files.

A file holds one independent zstandard frame for each document (a very long document takes
several), a skippable frame with the documents' ids, and a trailing seek table as in zstandard's
public seekable format: compressed and decompressed size and the low 32 bits of the XXH64 checksum
of every frame. A reader takes the last bytes, finds the frames of the documents it wants, and
decompresses and verifies only those. Any zstandard decompressor can read the whole file.

Files are written by the tasks of one range shuffle, in ascending order of the documents' ids, to
a temporary name that is then moved, so a task that is run again leaves the same file.

Cases: null text is an empty document, which has just its end id; null ids come first; repeated
rows are written each, in any order among themselves; an empty table writes no file; other columns
are ignored; ids that are not integers raise a TypeError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shirabe.llm import encoding
from shirabe.llm.storage import new_path

#: Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids in a frame at most.
FRAME = 1 << 22
LEVEL = 1


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, out) -> None:  # noqa: ANN001
        import zstandard

        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        self.frames = bytearray()
        self.index = bytearray()
        self.docs = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        for at in range(0, max(1, len(ids)), FRAME):
            part = ids[at : at + FRAME]
            frame = self.compressor.compress(part)
            self.out.write(frame)
            self.frames += struct.pack("<III", len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            # 1: has an id; 2: goes on with the document before
            self.index += struct.pack("<qB", doc_id or 0, (doc_id is not None) + 2 * (at > 0))
        self.docs += 1
        self.tokens += len(ids) // 4

    def close(self) -> None:
        n = len(self.frames) // 12
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(self.index)) + self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(self.frames) + 9) + self.frames + struct.pack("<IBI", n, CHECKSUM_FLAG, SEEKABLE_MAGIC))


@dataclass
class Frame:
    at: int
    packed: int
    size: int
    checksum: int
    doc_id: int | None
    goes_on: bool


class Reader:
    """Reads documents of one file from a seekable binary stream."""

    def __init__(self, source) -> None:  # noqa: ANN001
        import zstandard

        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = end - 9 - 12 * n - 8
        index = table - 8 - 9 * n
        source.seek(index)
        raw = source.read(end - 9 - index)
        docs = struct.iter_unpack("<qB", raw[8 : 8 + 9 * n])
        frames = struct.iter_unpack("<III", raw[16 + 9 * n :])
        at, self.frames = 0, []
        for (doc_id, bits), (packed, size, checksum) in zip(docs, frames, strict=True):
            self.frames.append(Frame(at, packed, size, checksum, doc_id if bits & 1 else None, bool(bits & 2)))
            at += packed

    def _read(self, frame: Frame) -> bytes:
        import xxhash

        self.source.seek(frame.at)
        data = self.decompressor.decompress(self.source.read(frame.packed), max_output_size=max(1, frame.size))
        if len(data) != frame.size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != frame.checksum:
            raise ValueError(f"a frame at {frame.at} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, ids); only wanted documents are decompressed."""
        start, i = 0, 0
        while i < len(self.frames):
            j = i + 1
            while j < len(self.frames) and self.frames[j].goes_on:
                j += 1
            own = self.frames[i:j]
            if wanted is None or own[0].doc_id in wanted:
                yield own[0].doc_id, start, b"".join(map(self._read, own))
            start += sum(f.size for f in own) // 4
            i = j


def _filesystem(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, path: str, tokenizer: str, kind: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Write docs below path; (file, documents, ids) of each file, in order: one row a partition."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, writer = encoding.encoder(tokenizer, kind), int(end_id).to_bytes(4, "little"), None
        task = TaskContext.get()
        system, folder = _filesystem(path)
        name = f"part-{task.partitionId():06d}.tokens.zst"
        attempt = f"{folder}/_{name}.{task.taskAttemptId()}"
        for batch in batches:
            for lo, hi, ids, bounds in enc.blocks(batch.column(1), end):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    writer = Writer(system.open_output_stream(attempt))
                view = memoryview(ids)
                for key, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    writer.add(key, view[a:b])
        if writer is not None:
            writer.close()
            writer.out.close()
            system.move(attempt, f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "docs": [writer.docs], "ids": [writer.tokens]})

    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be an integer column, for the files' index holds integers of 64 bits")
    ordered = docs.select(F.col(doc_id).cast("long").alias(doc_id), text).repartitionByRange(doc_id).sortWithinPartitions(doc_id)
    rows = ordered.mapInArrow(files, "name string, docs bigint, ids bigint").collect()
    return sorted((r["name"], r["docs"], r["ids"]) for r in rows)


def read(spark: SparkSession, path: str, files: Iterable[tuple[str, int, int]], wanted: set[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of the documents written below path."""
    rows, before = [], 0
    for name, _, ids in files:
        rows.append((name, before))
        before += ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _filesystem(path)
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{folder}/{name}") as source:
                    keys, starts, data, size = [], [], [], 0
                    for key, start, ids in Reader(source).documents(wanted):
                        keys.append(key)
                        starts.append(first + start)
                        data.append(ids)
                        size += len(ids)
                        if size > FRAME:
                            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
                            keys, starts, data, size = [], [], [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    listed = spark.createDataFrame(rows, "name string, before bigint")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(documents, "doc_id bigint, start bigint, ids binary")


def write_and_read(docs: DataFrame, tokenizer: str, kind: str = encoding.SPACE_DROPPED, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    return read(spark, path, write(docs, path, tokenizer, kind, end_id))
