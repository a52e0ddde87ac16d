"""Exact and fast token ids: texts are cut where no token can span, the distinct cuts of a block are
encoded once by the tokenizers library, and a bounded number of them is kept for later blocks.

A cut may be made

* before a space or line feed that follows a visible character: byte-level BPE starts a new pre-token
  with a run of white space (its last space goes with what follows), and BPE with word ends drops white
  space, so both treat what lies on either side apart;
* before one of MARKS that follows an ASCII letter: letters and marks are never in one pre-token.

Everything runs on Arrow buffers: cuts are byte offsets into the block's text, Arrow's dictionary
encoding finds the distinct ones (by their bytes, so no hash can mix up two), and the ids of all
texts are one `take` from the distinct cuts' ids. Python works for distinct cuts only.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shirabe.llm import words as W

SPACE_PREFIX, SPACE_DROPPED = "prefix", "dropped"
#: Bytes of text encoded at a time (a longer text is a block of its own).
BLOCK = 4 << 20
#: Bytes of keys and ids kept in each worker, twice (a young and an old generation).
KEPT_BYTES = 16 << 20
#: Cuts handed to the library at a time; it holds an object of some hundred bytes for each.
AT_ONCE = 10_000

MARKS = ".,;:!?"

_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_ASCII_VISIBLE = np.zeros(256, bool)
_ASCII_VISIBLE[0x21:0x7F] = True


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ascending byte offsets at which the texts between bounds may be cut, with the bounds themselves
    (once each, empty texts aside)."""
    n = len(data)
    may = np.zeros(n, bool)
    if n > 1:
        last = data[:-1]
        may[1:] = (_MARK[data[1:]] & _LETTER[last]) | (_SPACE[data[1:]] & _ASCII_VISIBLE[last])
        # After other scripts: the character before must not be one of Unicode's spaces, which begin
        # with C2, E1, E2 or E3 80.
        other = np.flatnonzero(_SPACE[data[1:]] & (last >= 0x80)) + 1
        if len(other):
            lead2, lead3 = data[np.maximum(other - 2, 0)], data[np.maximum(other - 3, 0)]
            two = (lead2 >= 0xC3) & (lead2 < 0xE0)
            three = (lead3 >= 0xE4) & (lead3 < 0xF0) & (lead2 >= 0x80) & (lead2 < 0xC0)
            kana = (lead3 == 0xE3) & (lead2 > 0x80) & (lead2 < 0xC0)
            may[other[two | three | kana]] = True
    inner = bounds[(bounds > 0) & (bounds < n)]
    may[inner] = True
    if n:
        may[0] = True
    return np.append(np.flatnonzero(may), n)


def _binary(offsets: np.ndarray, data: pa.Buffer | None) -> pa.LargeBinaryArray:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data if data is not None else pa.py_buffer(b"")]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.folds = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.young = self.old = self._none()

    @staticmethod
    def _none() -> tuple[pa.Array, pa.Array]:
        return pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _keys(self, cuts_: pa.Array) -> pa.Array:
        """What stands for each cut: where white space is dropped, one space before it says nothing, and
        where letters are folded, nor do capitals."""
        keys = cuts_.cast(pa.large_string())
        if self.kind == SPACE_DROPPED:
            led = pc.or_(pc.starts_with(keys, " "), pc.starts_with(keys, "\n"))
            keys = pc.if_else(led, pc.utf8_slice_codeunits(keys, 1), keys)
        return pc.if_else(pc.string_is_ascii(keys), pc.ascii_lower(keys), keys) if self.folds else keys

    def _encoded(self, keys: pa.Array) -> pa.Array:
        """Ids by the library, for distinct keys."""
        parts = []
        for lo in range(0, len(keys), AT_ONCE):
            got = self.tokenizer.encode_batch_fast(keys.slice(lo, AT_ONCE).to_pylist(), add_special_tokens=False)
            parts.append(pa.array([array("I", e.ids).tobytes() for e in got], pa.large_binary()))
        return pa.concat_arrays(parts) if parts else self._none()[1]

    def _ids(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct cuts. Keys are looked up in what is kept, by their bytes; the library encodes the
        others. What is found in the old generation goes over to the young one."""
        keys = self._keys(distinct)
        n = len(self.young[0])
        kept = [pa.concat_arrays(both) for both in zip(self.young, self.old, strict=True)]
        at = pc.index_in(keys, value_set=kept[0])
        fresh = keys.filter(pc.is_null(at)).unique()
        known = pa.concat_arrays([kept[1], self._encoded(fresh)])
        at = pc.coalesce(at, pc.add(pc.index_in(keys, value_set=fresh), len(kept[0])))
        found = known.take(at)
        again = np.unique(at.to_numpy(zero_copy_only=False))
        again = pa.array(again[(again >= n) & (again < len(kept[0]))])
        self.young = (pa.concat_arrays([self.young[0], kept[0].take(again), fresh]), pa.concat_arrays([self.young[1], kept[1].take(again), known.slice(len(kept[0]))]))
        if sum(x.nbytes for x in self.young) > KEPT_BYTES:
            self.old, self.young = self.young, self._none()
        return found

    def _block(self, data: np.ndarray, bounds: np.ndarray, end: bytes) -> tuple[pa.Buffer | None, np.ndarray]:
        """(buffer of the ids of all texts, one after another, and each text's bounds in it)."""
        at = cuts(data, bounds)
        parts = _binary(at, pa.py_buffer(data)).dictionary_encode()
        ids = self._ids(parts.dictionary)
        where = parts.indices.to_numpy(zero_copy_only=False)
        first = np.searchsorted(at[:-1], bounds)  # the first cut of each text
        first[-1] = len(at) - 1
        if end:  # one more cut behind each text
            ids = pa.concat_arrays([ids, pa.array([end], pa.large_binary())])
            n = len(bounds) - 1
            places = first[1:] + np.arange(n)
            whole = np.full(len(where) + n, len(ids) - 1, where.dtype)
            keep = np.ones(len(whole), bool)
            keep[places] = False
            whole[keep] = where
            where, first = whole, first + np.arange(n + 1)
        taken = ids.take(pa.array(where))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        return taken.buffers()[2] if len(taken) else None, offsets[first]

    def blocks(self, texts: pa.Array, end: bytes = b"") -> Iterator[tuple[int, int, pa.Buffer | None, np.ndarray]]:
        """(lo, hi, ids, bounds) of runs of texts: bytes of the ids of texts lo..hi-1, each with `end`
        behind it, and where each text's begin. Null counts as empty."""
        for lo, hi, data, bounds in W.doc_chunks(texts, BLOCK):
            yield lo, hi, *self._block(np.ascontiguousarray(data), bounds, end)
            pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.LargeBinaryArray:
        """The ids of each text, with `end` behind them."""
        found = [_binary(bounds, ids) for _, _, ids, bounds in self.blocks(texts, end)]
        return pa.concat_arrays(found) if found else pa.array([], pa.large_binary())


def sliced(ids: pa.Buffer | None, bounds: np.ndarray) -> pa.LargeBinaryArray:
    """The stretches of a block's ids between bounds, without copying them."""
    return _binary(bounds, ids)


class Decoder:
    """Texts of ids. Byte-level vocabularies decode by a table of each id's bytes, all ids of a batch
    at once; any other goes through the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str()).get("decoder") or {}
        self.table = self._bytes() if kind.get("type") == "ByteLevel" else None

    def _bytes(self) -> pa.Array:
        """Byte-level vocabularies write a printable byte as itself, and the n-th other one as the
        character 256 + n."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = self.tokenizer.get_added_tokens_decoder()
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            token = self.tokenizer.id_to_token(i) or ""
            out.append(token.encode() if i in special else bytes(of[c] for c in token))
        return pa.array(out, pa.large_binary())

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids[bounds[i]:bounds[i + 1]]."""
        if self.table is None:
            return self.tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], skip_special_tokens=False)
        if not len(ids):
            return [""] * (len(bounds) - 1)
        taken = self.table.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        return [t.decode("utf-8", "replace") for t in _binary(offsets[bounds], taken.buffers()[2]).to_pylist()]


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, Decoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process, so that tasks share what it has kept."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def vocabulary(path: str) -> int:
    """Number of ids of a tokenizer, added tokens included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
