"""Vectorised word tables: words and their 64-bit hashes straight from Arrow's string buffers.

A word is a run of bytes other than space and \\x09-\\x0D, which equals `[^\\x20\\x09-\\x0D]+` on the
text. Hashes come from a mixer that takes eight bytes of every word at a time, so a batch costs a few
numpy passes and Python work only for words of more than LONG bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; keeps the working arrays near the cache and bounded.
CHUNK = 1 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_GOLD = 0x9E3779B97F4A7C15
#: Spans of up to LONG bytes are hashed eight bytes at a time, all spans at once; longer ones (few,
#: among words) one by one with XXH3, so that one endless word can't make many passes.
LONG = 64


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Every eight bytes go through a bijective mixer that
    is not linear in them, so sequences built of repeated or swapped parts have unrelated hashes."""
    import xxhash

    n = len(starts)
    length = ends - starts
    out = mix((length.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
    if not n:
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    at, left, rows = starts, length, None
    if n and (over := length > LONG).any():
        view = memoryview(np.ascontiguousarray(data))
        for i in np.flatnonzero(over).tolist():
            out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
        rows = np.flatnonzero(~over)
        at, left = starts[rows], length[rows]
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    while len(at):
        part = eight[at] & masks[np.minimum(left, 8)]
        if rows is None:
            out = mix((out ^ part) * np.uint64(_BASE))
        else:
            out[rows] = mix((out[rows] ^ part) * np.uint64(_BASE))
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


@dataclass
class Words:
    """Words of documents lo..hi-1 of a batch."""

    lo: int
    hi: int
    data: np.ndarray  # bytes of the chunk
    bounds: np.ndarray  # hi-lo+1 byte bounds of the documents in data
    starts: np.ndarray  # byte bounds of each word
    ends: np.ndarray
    first: np.ndarray  # hi-lo+1 bounds of the documents' words
    hashes: np.ndarray | None

    @property
    def doc(self) -> np.ndarray:
        """Number of the document, from 0 in this chunk, of each word."""
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    bounds = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def doc_chunks(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, bounds) of runs of documents of about `chunk` bytes; null counts as empty."""
    if not len(texts):
        return
    bounds, data = _buffers(texts)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def spans(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes of a kind, parted at the documents' bounds."""
    word = kind[data]
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_chunks(texts: pa.Array, lower: bool = False, hashed: bool = True) -> Iterator[Words]:
    """The word tables of a batch of texts, chunk by chunk. lower: A-Z count as a-z."""
    for lo, hi, data, bounds in doc_chunks(texts):
        if lower:
            data = LOWER[data]
        starts, ends = spans(data, bounds)
        first = np.searchsorted(starts, bounds)
        yield Words(lo, hi, data, bounds, starts, ends, first, byte_hashes(data, starts, ends) if hashed else None)


def gram_hashes(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of each n consecutive words (also across documents; the caller masks those)."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(k, np.uint64(seed), np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + k]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return mix(out)


def release() -> None:
    """Give memory that is free back to the system. Workers live on from stage to stage beside the
    executor's own memory, and allocators keep what a stage had at its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
