"""Quality rules as a short-circuit cascade.

Each rule rejects documents by a measurement of the whole text. On a sample (about SAMPLE documents
of all) every rule's cost and share of rejections are measured; the rules then run in
order of rejection per cost (as for independent filters, highest first), and each sees only the
documents that the rules before it have let pass. A document is kept when no rule rejects it, so the
order changes the cost and never the verdict.

Measurements are numpy passes over the batch's bytes, one for all its documents.

Cases: null and empty text have no words and are rejected for that; ties and repeated rows are
judged each; a very long text is a batch of its own; an empty table gives an empty result; all
other columns pass through, and added columns start with ql_ (where docs has such a name, they get
'_' behind it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shirabe.llm import words as W
from shirabe.llm.storage import unused

#: Documents measured to order the rules: about so many of any table, chosen by the hash of their text. Equal texts are
#: chosen together.
SAMPLE = 2000
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Texts:
    """Some documents of a batch; measurements are made once, when a rule asks."""

    words: W.Words

    def __post_init__(self) -> None:
        self._made: dict[str, np.ndarray] = {}

    def get(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = MEASURES[name](self.words)
        return self._made[name]

    @property
    def size(self) -> int:
        return self.words.hi - self.words.lo

    def take(self, keep: np.ndarray) -> Texts:
        """The documents keep (ascending numbers) alone."""
        w = self.words
        if len(keep) == self.size:
            return self
        one = np.zeros(self.size, bool)
        one[keep] = True
        sizes, counts = np.diff(w.bounds), np.diff(w.first)
        shift = np.concatenate([[0], np.cumsum(np.where(one, 0, sizes))[:-1]])
        own = np.repeat(one, counts)
        move = np.repeat(shift, counts)[own]
        part = W.Words(
            0, len(keep), w.data[np.repeat(one, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]), w.starts[own] - move,
            w.ends[own] - move, np.concatenate([[0], np.cumsum(counts[keep])]), None if w.hashes is None else w.hashes[own],
        )
        made = Texts(part)
        made._made = {k: v[keep] for k, v in self._made.items()}
        return made


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def n_words(w: W.Words) -> np.ndarray:
    return np.diff(w.first).astype(np.int64)


def word_chars(w: W.Words) -> np.ndarray:
    """Code points in words: bytes that begin one and aren't white space."""
    return _per_doc(W._WORD[w.data] & ((w.data & 0xC0) != 0x80), w.bounds)


def n_symbols(w: W.Words) -> np.ndarray:
    return _per_doc(_SYMBOL[w.data], w.bounds)


def _later(keys: np.ndarray) -> np.ndarray:
    """True for keys that equal one before them."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return same


def _of_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _lines(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line that has a word."""
    breaks = np.append(np.flatnonzero(w.data == 10), len(w.data))
    starts = np.union1d(w.bounds[:-1], breaks[:-1] + 1)
    starts = starts[starts < len(w.data)]
    ends = np.minimum(breaks[np.searchsorted(breaks, starts, "left")], w.bounds[np.searchsorted(w.bounds, starts, "right")])
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(w.bounds, starts, "right") - 1


def n_lines(w: W.Words) -> np.ndarray:
    return np.bincount(_lines(w)[2], minlength=w.hi - w.lo).astype(np.int64)


def n_dup_lines(w: W.Words) -> np.ndarray:
    starts, ends, doc = _lines(w)
    keys = _of_doc(W.byte_hashes(w.data, starts, ends), doc)
    return np.bincount(doc[_later(keys)], minlength=w.hi - w.lo).astype(np.int64)


def n_repeat_words(w: W.Words) -> np.ndarray:
    """Words that lie in a window of WINDOW words found twice or more in their text."""
    n, out = len(w.starts), np.zeros(w.hi - w.lo, np.int64)
    if n < WINDOW:
        return out
    doc = w.doc
    grams = W.gram_hashes(w.hashes, WINDOW, 1)
    valid = np.flatnonzero(doc[: len(grams)] == doc[WINDOW - 1 :])
    keys = _of_doc(grams[valid], doc[valid])
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, valid[twice], 1)
    np.add.at(change, valid[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=w.hi - w.lo).astype(np.int64)


def n_echo_words(w: W.Words) -> np.ndarray:
    """Words that equal the word before them."""
    same = np.zeros(len(w.starts), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    return _per_doc(same, w.first)


def _capital(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Capital and small letters of ASCII and Latin-1, the latter by their second byte."""
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    lower = ((data >= 97) & (data <= 122)) | (after & (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7))
    return upper, lower


def n_upper(w: W.Words) -> np.ndarray:
    return _per_doc(_capital(w.data)[0], w.bounds)


def n_lower(w: W.Words) -> np.ndarray:
    return _per_doc(_capital(w.data)[1], w.bounds)


MEASURES: dict[str, Callable[[W.Words], np.ndarray]] = {
    f.__name__: f for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_echo_words, n_upper, n_lower)
}


def _sorting(n: int) -> float:
    return n * max(1.0, np.log2(max(n, 2)))


#: Elements that each measure's passes go over.
WORK: dict[str, Callable[[W.Words], float]] = {
    "n_words": lambda w: w.hi - w.lo,
    "word_chars": lambda w: 3.0 * len(w.data),
    "n_symbols": lambda w: 1.0 * len(w.data),
    "n_lines": lambda w: 1.0 * len(w.data),
    "n_dup_lines": lambda w: 2.0 * len(w.data) + _sorting(int((w.data == 10).sum())),
    "n_repeat_words": lambda w: 4.0 * WINDOW * len(w.starts) + _sorting(len(w.starts)),
    "n_echo_words": lambda w: 1.0 * len(w.starts),
    "n_upper": lambda w: 5.0 * len(w.data),
    "n_lower": lambda w: 5.0 * len(w.data),
}


@dataclass(frozen=True)
class Rule:
    """rejects(texts) gives True for each document that the rule rejects; needs: its measures."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Texts], np.ndarray]


#: The rules; limits are far from what prose reaches.
FEW_WORDS = Rule("few_words", ("n_words",), lambda t: t.get("n_words") < 20)
REPEATS = Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda t: 100 * t.get("n_repeat_words") > 30 * t.get("n_words"))
RULES = (
    FEW_WORDS,
    REPEATS,
    Rule("symbols", ("n_words", "n_symbols"), lambda t: 100 * t.get("n_symbols") > 30 * t.get("n_words")),
    Rule("shouting", ("n_upper", "n_lower"), lambda t: t.get("n_upper") > t.get("n_lower")),
    Rule("echo", ("n_words", "n_echo_words"), lambda t: 100 * t.get("n_echo_words") > 30 * t.get("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda t: (t.get("n_dup_lines") >= 5) & (2 * t.get("n_dup_lines") > t.get("n_lines"))),
    Rule("word_length", ("n_words", "word_chars"), lambda t: (t.get("word_chars") < 2 * t.get("n_words")) | (t.get("word_chars") > 20 * t.get("n_words"))),
)


def judge(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """Number of the first of the ordered rules that rejects each document; -1: kept."""
    verdict = np.full(texts.size, -1, np.int32)
    alive, left = np.arange(texts.size), texts
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        out = rule.rejects(left)
        verdict[alive[out]] = i
        alive, left = alive[~out], left.take(np.flatnonzero(~out))
    return verdict


def order(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Rule]:
    """The rules by rejection per cost on a sample of about SAMPLE documents, chosen by a hash of the text before any
    reaches Python, so it depends on no order, partition or batch. Costs are the elements that a rule's measures go over
    (WORK), so reruns agree. A row for each rule reaches the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for w in W.word_chunks(batch.column(0)):
                seen += w.hi - w.lo
                for i, rule in enumerate(rules):
                    rejected[i] += int(rule.rejects(Texts(w)).sum())
                    work[i] += sum(WORK[m](w) for m in rule.needs)
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "work": work, "rejected": rejected, "seen": [seen] * len(rules)})

    one = docs.select(F.col(f"`{text}`").alias("text"))
    one = one.filter(F.pmod(F.xxhash64("text"), F.lit(max(1, one.count() // SAMPLE))) == 0)
    got = one.mapInArrow(measure, "rule bigint, work double, rejected bigint, seen bigint")
    rows = got.groupBy("rule").agg(F.sum("work").alias("s"), F.sum("rejected").alias("r"), F.sum("seen").alias("n")).collect()
    gain = {r["rule"]: (r["r"] / r["n"]) / max(r["s"] / r["n"], 1e-9) if r["n"] else 0.0 for r in rows}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i))]


def cascade(docs: DataFrame, measures: Sequence[str] = (), rules: Sequence[Rule] = RULES, text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns `only`) with ql_rejected_by (name of the first rule that rejects; null: kept)
    and, as ql_*, the measures asked for."""
    ordered = order(docs, rules, text)
    fields = [f for f in docs.schema if only is None or f.name in only]
    added = unused(("ql_rejected_by", *(f"ql_{m}" for m in measures)), [f.name for f in fields])
    rule_names = pa.array([r.name for r in ordered])
    packed = F.struct(*[F.col(f"`{f.name}`") for f in fields]).alias("row") if fields else F.lit(None).cast("int").alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in W.word_chunks(batch.column(1)):
                texts = Texts(w)
                made = [pa.array(texts.get(m)) for m in measures]
                verdict = judge(texts, ordered)
                by = rule_names.take(pa.array(verdict, mask=verdict < 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), by, *made], ["row", "by", *(f"m{i}" for i in range(len(made)))])
        W.release()

    own = docs.select(packed, F.col(f"`{text}`").alias("text"))
    out = StructType([StructField("row", own.schema["row"].dataType), StructField("by", StringType()), *(StructField(f"m{i}", LongType()) for i in range(len(measures)))])
    found = own.mapInArrow(run, out)
    named = [F.col("by").alias(added["ql_rejected_by"]), *(F.col(f"m{i}").alias(added[f"ql_{m}"]) for i, m in enumerate(measures))]
    return found.select(*[F.col("row").getField(f.name).alias(f.name) for f in fields], *named)


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    by = unused(("ql_rejected_by",), docs.columns)["ql_rejected_by"]
    return cascade(docs, (), rules, text).filter(F.col(by).isNull()).drop(by)
