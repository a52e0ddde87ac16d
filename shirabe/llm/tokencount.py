"""Token counts by a compiled tokenizer: BPE with word ends as a deterministic transducer.

The transducer reads the bytes of a word (a pre-token). A segmentation is what BPE gives if and only if
each two neighbours in it are what BPE makes of them alone, so the last token of every prefix is known
from left to right. A state holds, for each place of the word that a token in progress may have begun at,
the node of the vocabulary's trie that its bytes lead to, the token that ends there and how many tokens lie
before it, less the fewest. A transition emits by how much the fewest rises, the end of a word what is then
missing; so all emitted counts add up to the word's tokens. States and transitions are compiled when a text
first needs them, and dropped when there are MOST_STATES.

A block of words runs in lockstep: one lane a word, one step a byte, a few gathers from the tables for all
lanes together. Words longer than CHUNK bytes are lanes of CHUNK bytes each: a chunk's state map is found for
the state that WARM bytes before it lead to, maps compose where one's exit is the next one's entry, in
a scan by doubling over all chunks, and where it isn't the chunk runs again from its true entry.

Texts themselves are pieces of PIECE characters, which Spark deals out as rows. A piece's map is kept as
(head, tokens, tail): what comes before its first place at which no token can span, the tokens between, what
comes behind its last such place. Maps of neighbours compose by joining tail and head; a long text's are
composed in order, so neither a task nor a batch needs to hold more of it than a piece.

What is a letter, a number, a space, and which lower case a character has, is asked from the tokenizers
library once per character, and so is the canonical composition of texts that are not composed.

Cases: null text counts as empty and has 0 tokens; special tokens' strings inside texts are one token each, as
the library has it; repeated rows stay; equal texts have equal counts, so there are no ties; very long texts
are cut as told, and a text without any safe place is joined again as one row, as it was in the input; an empty
table gives an empty result; of docs the columns in `keep` stay, and one that is named like an added one
moves that to the name with '_' behind it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.llm import words as W
from shirabe.llm.storage import store, unused

#: Fixed values of the tokenizer file: how texts become words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ("NFC", "Replace", "Lowercase")
END = "</w>"

#: Characters of a text that one row of pieces has.
PIECE = 1 << 18
#: Bytes of text handled at a time, and of distinct words that run between two looks at the number of states.
BLOCK, RUN = 1 << 20, 1 << 17
#: Bytes of a lane, and bytes before it that its entry is guessed from.
CHUNK, WARM = 256, 64
MOST_STATES = 1 << 18
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Odd factor that spreads keys over a table (2 ** 64 by the golden ratio).
_SPREAD = 0x9E3779B97F4A7C15

#: A letter or digit, then a character that always begins a word or is dropped and composes with nothing before it.
_SAFE = re.compile(r"(?<=[^\W_])(?=[ \n.,;:!?、。！，？])")
ADDED = ("tc_bytes", "tc_tokens", "tc_over")


class Edges:
    """Transitions by state << 8 | byte, in a table with open addresses that is looked up for many keys at once."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.targets = np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.uint8)

    def add(self, key: int, target: int, emitted: int) -> None:
        if 3 * self.used >= len(self.keys):
            full = self.keys >= 0
            old = zip(self.keys[full].tolist(), self.targets[full].tolist(), self.emits[full].tolist(), strict=True)
            self.__init__(self.bits + 1)
            for edge in old:
                self.add(*edge)
        slot = (key * _SPREAD & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.targets[slot], self.emits[slot] = key, target, emitted
        self.used += 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where there is none."""
        slots = ((keys.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        at = self.keys[slots]
        wrong = np.flatnonzero(at != keys)
        while wrong.size:
            none = self.keys[slots[wrong]] < 0
            slots[wrong[none]] = -1
            wrong = wrong[~none]
            slots[wrong] = (slots[wrong] + 1) & (len(self.keys) - 1)
            wrong = wrong[self.keys[slots[wrong]] != keys[wrong]]
        return slots


class Transducer:
    """States and transitions of the words' automaton; state 0 is the beginning of a word."""

    def __init__(self, model: dict) -> None:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in self.char.items()}
        self.rank = {(m if isinstance(m, tuple) else tuple(m if isinstance(m, list) else m.split(" "))): i for i, m in enumerate(model["merges"])}
        self.children: list[dict[int, int]] = [{}]
        self.inner: list[str | None] = [None]  # the token that a node's bytes are, inside a word
        self.last: list[str | None] = [None]  # and at its end
        for token in model["vocab"]:
            ends = token.endswith(END) and token != END
            body = token.removesuffix(END) if ends else token
            if not all(c in byte for c in body):
                continue  # no sequence of bytes
            node = 0
            for c in body:
                if (b := byte[c]) not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.inner.append(None)
                    self.last.append(None)
                node = self.children[node][b]
            (self.last if ends else self.inner)[node] = token
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.shared: dict[tuple, tuple] = {}  # equal parts of states are one object
        self.edges = Edges()
        self.final = np.full(1024, -1, np.int32)
        self._state(((0, None, 0),))

    def _state(self, key: tuple) -> int:
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.states)
            self.states.append(key)
            if at == len(self.final):
                self.final = np.concatenate([self.final, np.full_like(self.final, -1)])
        return at

    def merged(self, symbols: list[str]) -> list[str]:
        """What BPE makes of the symbols: the lowest rank first, the leftmost of equal ones."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(symbols[:-1], symbols[1:], strict=True)))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _fit(self, left: str | None, token: str) -> bool:
        """Whether BPE leaves left (which ends inside a word) and token side by side."""
        if (found := self.fits.get((left, token))) is None:
            own = [*token.removesuffix(END)]
            if token.endswith(END):
                own[-1] += END
            found = self.merged([*(left or ""), *own]) == [x for x in (left, token) if x is not None]
            if len(self.fits) > 1 << 20:
                self.fits.clear()
            self.fits[left, token] = found
        return found

    def compile(self, state: int, byte: int) -> int:
        """Add the transition; its target."""
        kept, ended = [], None
        for node, token, count in self.states[state]:
            if (child := self.children[node].get(byte)) is None:
                continue
            if (own := self.inner[child]) is not None and ended is None and self._fit(token, own):
                ended = (own, count + 1)
            if self.children[child] or self.last[child] is not None:
                kept.append((child, token, count))
        assert ended is not None, "the vocabulary lacks a byte"
        kept.append((0, *ended))
        least = min(c for _, _, c in kept)
        parts = [(n, t, c - least) for n, t, c in kept]
        target = self._state(tuple(self.shared.setdefault(x, x) for x in parts))
        self.edges.add(state << 8 | byte, target, least)
        return target

    def ending(self, state: int) -> int:
        """Tokens that are still to be emitted where a word ends in this state."""
        if self.final[state] < 0:
            found = [c + 1 for n, t, c in self.states[state] if n and self.last[n] is not None and self._fit(t, self.last[n])]
            self.final[state] = found[0] if found else 0
        return int(self.final[state])

    def _lanes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit state, emitted tokens) of each lane: lengths bytes from starts on, from states on."""
        order = np.argsort(-lengths, kind="stable")
        at, left, now = starts[order], lengths[order], states[order].astype(np.int64)
        count = np.zeros(len(at), np.int64)
        live = len(at)
        for step in range(int(left[0]) if live else 0):
            live = int(np.searchsorted(-left[:live], -step, "left"))
            keys = now[:live] << 8 | data[at[:live] + step]
            slots = self.edges.find(keys)
            if (gap := np.flatnonzero(slots < 0)).size:
                for pair in np.unique(keys[gap]).tolist():
                    self.compile(pair >> 8, pair & 255)
                slots = self.edges.find(keys)
            count[:live] += self.edges.emits[slots]
            now[:live] = self.edges.targets[slots]
        out, emitted = np.empty_like(now), np.empty_like(count)
        out[order], emitted[order] = now, count
        return out, emitted

    def tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word."""
        n = -(-lengths // CHUNK)  # chunks of each word; none is empty
        word = np.repeat(np.arange(len(starts)), n)
        first = np.cumsum(n) - n
        part = np.arange(len(word)) - first[word]
        begin = starts[word] + part * CHUNK
        length = np.minimum(lengths[word] - part * CHUNK, CHUNK)
        entry = np.zeros(len(word), np.int64)
        if (later := np.flatnonzero(part)).size:
            entry[later] = self._lanes(data, begin[later] - WARM, np.full(len(later), WARM), entry[later])[0]
        leave, count = self._lanes(data, begin, length, entry)
        while (wrong := later[entry[later] != leave[later - 1]]).size:
            wrong = wrong[np.unique(word[wrong], return_index=True)[1]]  # the first of each word: its true entry is known
            entry[wrong] = leave[wrong - 1]
            leave[wrong], count[wrong] = self._lanes(data, begin[wrong], length[wrong], entry[wrong])
        ends, total = composed(leave, count, part)
        at_end = first + n - 1
        final = self.final[ends[at_end]]
        for state in np.unique(ends[at_end][final < 0]).tolist():
            self.ending(state)
        return total[at_end] + self.final[ends[at_end]]


def composed(leave: np.ndarray, count: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix scan of chunk maps by doubling: after it, each chunk's map is that of its word up to it. part is a
    chunk's number in its word; each map's entry is the exit of the one before."""
    total, step = count.copy(), 1
    while (far := np.flatnonzero(part >= step)).size:
        total[far] = total[far] + total[far - step]
        step *= 2
    return leave, total


class Counter:
    """Tokens of texts, as the library counts them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        split = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = tuple(x["type"] for x in (own.get("normalizer") or {}).get("normalizers", ()))
        if own["model"].get("end_of_word_suffix") != END or (split[0].get("pattern") or {}).get("Regex") != PATTERN or steps != NORMALIZERS or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in own["added_tokens"]):
            raise ValueError(f"{path}: not BPE with word ends over words of the pattern that is compiled here")
        library = Tokenizer.from_file(path)
        self.specials = [x["content"] for x in own["added_tokens"]]
        self.normalizer, self.words, self.nfc = library.normalizer, library.pre_tokenizer, normalizers.NFC()
        self.machine = Transducer(own["model"])
        self.lower = np.zeros(0x110000, np.uint32)
        self.kind = np.full(0x110000, 255, np.uint8)
        self.long: dict[str, str] = {}

    def _learn(self, points: np.ndarray) -> None:
        """Lower case and class of characters that are met for the first time."""
        for point in points.tolist():
            c = chr(point)
            low = self.normalizer.normalize_str(c)
            if len(low) != 1:
                self.long[c] = low
                low = c
            around = len(self.words.pre_tokenize_str(f"a{low}a"))
            kind = {1: LETTER, 2: SPACE}.get(around) if around < 3 else OTHER if len(self.words.pre_tokenize_str(f"!{low}")) == 1 else NUMBER
            self.lower[point], self.kind[point] = ord(low), kind

    def _points(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if (new := points[self.kind[points] == 255]).size:
            self._learn(np.unique(new))
        return points

    def _spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased characters without spaces, where words begin in them, where each one was before)."""
        low, kind = self.lower[points], self.kind[points]
        begin = kind != SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        mark = np.flatnonzero(begin & (low == 0x27))
        if mark.size:  # contractions, where an apostrophe begins a word
            after = np.zeros(len(low) + 3, low.dtype)
            after[: len(low)] = low
            one, two = after[mark + 1], after[mark + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(mark), bool)
            for pair in ("re", "ve", "ll"):
                long |= (one == ord(pair[0])) & (two == ord(pair[1]))
            begin[mark[short | long] + 1] = False
            for some, n in ((short, 2), (long, 3)):
                behind = mark[some] + n
                behind = behind[behind < len(kind)]
                begin[behind] = kind[behind] != SPACE
        there = np.flatnonzero(kind != SPACE)
        return low[there], np.flatnonzero(begin[there]), there

    def count(self, texts: Sequence[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        texts = list(texts)
        for i, text in enumerate(texts):
            if "<|" in text or any(not s.startswith("<|") for s in self.specials):
                for special in self.specials:
                    out[i] += text.count(special)
                    text = text.replace(special, "\n")
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = self.nfc.normalize_str(text)
            texts[i] = text
        # A line feed between texts is dropped and parts them.
        whole = "\n".join(texts)
        points = self._points(whole)
        found = [c for c in self.long if c in whole]
        if found:
            for c in found:
                whole = whole.replace(c, self.long[c])
                texts = [t.replace(c, self.long[c]) for t in texts]
            points = self._points(whole)
        low, begin, there = self._spans(points)
        if not len(begin):
            return out
        data = np.frombuffer(low.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        size = 1 + (low >= 0x80).astype(np.int64) + (low >= 0x800) + (low >= 0x10000)
        bounds = np.append((np.cumsum(size) - size)[begin], len(data))
        # Equal words have equal counts: each distinct one of the block runs once.
        distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        offsets, own = np.frombuffer(distinct.dictionary.buffers()[1], np.int64)[: len(distinct.dictionary) + 1], np.frombuffer(distinct.dictionary.buffers()[2], np.uint8)
        tokens, lo = np.empty(len(offsets) - 1, np.int64), 0
        while lo < len(tokens):
            hi = min(len(tokens), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + RUN, "right")) - 1))
            if len(self.machine.states) > MOST_STATES:
                self.machine.reset()
            tokens[lo:hi] = self.machine.tokens(own, offsets[lo:hi], np.diff(offsets[lo : hi + 1]))
            lo = hi
        each = tokens[distinct.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return out + np.bincount(np.searchsorted(ends, there[begin], "right"), each, len(texts)).astype(np.int64)

    def of(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow array, in blocks."""
        texts, out = texts.fill_null("").cast(pa.large_string()), np.zeros(len(texts), np.int64)
        for lo, hi, _, _ in W.doc_chunks(texts, BLOCK):
            out[lo:hi] = self.count(texts.slice(lo, hi - lo).to_pylist())
        return out


def ends_of(text: str) -> tuple[int, int] | None:
    """The first and the last place of a piece at which no token can span; None without any."""
    first = _SAFE.search(text)
    if first is None:
        return None
    back = 256
    while True:
        lo = max(0, len(text) - back)
        found = [m.start() for m in _SAFE.finditer(text, lo)]
        if found:
            return first.start(), found[-1]
        back *= 8


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process, so that tasks share what it has compiled."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


_MAP = T.StructType([T.StructField("tc_whole", T.BooleanType()), T.StructField("tc_head", T.StringType()), T.StructField("tc_n", T.LongType()), T.StructField("tc_tail", T.StringType())])


def _maps(path: str):  # noqa: ANN202
    """Each row's piece of text becomes its map; a text of one piece just its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            rest = batch.drop_columns(["tc_text"])
            pieces, many = batch.column("tc_text").to_pylist(), batch.column("tc_pieces").to_pylist()
            whole, heads, tails = [], [], []
            for i, (text, n) in enumerate(zip(pieces, many, strict=True)):
                at = ends_of(text) if n > 1 else None
                whole.append(n > 1 and at is None)
                heads.append(None if n == 1 else text if at is None else text[: at[0]])
                tails.append(None if at is None else text[at[1] :])
                if n > 1:
                    pieces[i] = "" if at is None else text[at[0] : at[1]]
            made = [pa.array(whole), pa.array(heads, pa.string()), pa.array(machine.of(pa.array(pieces, pa.large_string()))), pa.array(tails, pa.string())]
            yield pa.RecordBatch.from_arrays([*rest.columns, *made], [*rest.schema.names, *_MAP.names])
        W.release()

    return run


def _joined(path: str):  # noqa: ANN202
    """Tokens of all strings of each row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in batches:
            lists = batch.column("tc_joins")
            n = machine.of(pc.list_flatten(lists).cast(pa.large_string()))
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            rest = batch.drop_columns(["tc_joins"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.bincount(row, n, len(lists)).astype(np.int64))], [*rest.schema.names, "tc_more"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, *, text: str = "text", keep: Sequence[str] = ("doc_id",), piece: int = PIECE) -> DataFrame:
    """The columns `keep` of docs with tc_bytes (UTF-8 bytes of the text), tc_tokens and tc_over (more tokens
    than limit). tokenizer: the path of a tokenizers file, on each executor."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("tc_row")
    many = F.greatest(F.lit(1), F.ceil(F.char_length(body) / piece)).cast("int")
    rows = docs.select(kept, body.alias("tc_text"), F.octet_length(body).cast("long").alias("tc_bytes"), many.alias("tc_pieces"), F.monotonically_increasing_id().alias("tc_id"))
    pieces = F.when(F.col("tc_pieces") == 1, F.array("tc_text")).otherwise(F.transform(F.sequence(F.lit(0), F.col("tc_pieces") - 1), lambda i: F.substring("tc_text", i * piece + 1, F.lit(piece))))
    rows = rows.select("tc_row", "tc_bytes", "tc_pieces", "tc_id", F.posexplode(pieces).alias("tc_part", "tc_text"))
    plain = T.StructType([f for f in rows.schema if f.name != "tc_text"])
    maps = store(rows.mapInArrow(_maps(tokenizer), T.StructType([*plain, *_MAP])), "token-maps")
    short = maps.filter("tc_pieces = 1").select("tc_row", "tc_bytes", F.col("tc_n").alias("tc_tokens"))
    # A text's maps in order, a row for each piece: what lies between two safe places across pieces is joined.
    parts = F.array_sort(F.collect_list(F.struct("tc_part", "tc_whole", "tc_head", "tc_tail")))
    long = maps.filter("tc_pieces > 1").groupBy("tc_id").agg(F.first("tc_row").alias("tc_row"), F.first("tc_bytes").alias("tc_bytes"), F.sum("tc_n").alias("tc_n"), parts.alias("tc_parts"))
    nothing = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def compose(so_far, part):  # noqa: ANN001, ANN202
        met = F.concat(so_far["open"], part["tc_head"])
        return F.when(part["tc_whole"], F.struct(so_far["done"].alias("done"), met.alias("open"))).otherwise(
            F.struct(F.array_append(so_far["done"], met).alias("done"), part["tc_tail"].alias("open"))
        )

    joins = F.aggregate("tc_parts", nothing, compose, lambda x: F.array_append(x["done"], x["open"]))
    long = long.select("tc_row", "tc_bytes", "tc_n", joins.alias("tc_joins"))
    plain = T.StructType([f for f in long.schema if f.name != "tc_joins"])
    long = long.mapInArrow(_joined(tokenizer), T.StructType([*plain, T.StructField("tc_more", T.LongType())]))
    long = long.select("tc_row", "tc_bytes", (F.col("tc_n") + F.col("tc_more")).alias("tc_tokens"))
    names = unused(ADDED, keep)
    found = (F.col("tc_bytes"), F.col("tc_tokens"), F.col("tc_tokens") > limit)
    return short.unionByName(long).select("tc_row.*", *[c.alias(names[n]) for n, c in zip(ADDED, found, strict=True)])
