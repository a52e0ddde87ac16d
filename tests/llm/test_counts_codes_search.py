"""op11 to op13: against the library, against plain Python, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shirabe.llm import queries as Q
from shirabe.llm import ranking, tokencount, veccodes
from shirabe.llm.storage import table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXT = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# --- op11 ----------------------------------------------------------------------------------------


def odd_texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "b", "'", "s", "re", "ll", " ", "1", "é", "É", "ん", "。", "<|endoftext|>", "<|", "İ", "Σ", "!", "_", " ", "ǅ", "😀", "xxx", "the", "ing", "\n", "̀", "ß", "Å", "Å", "²", "Ⅷ", "'S", "'Ve", "゙"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(1, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(n // 5)]
    return texts + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 300))) for _ in range(n // 5)]


def test_counts_equal_the_library(library):
    texts = odd_texts(5, 3000)
    assert tokencount.Counter(WORD_BPE).count(texts).tolist() == lengths(library, texts)


@pytest.mark.parametrize("word", ["a", "ab", "ha", "aab", "ー", "é", "xyz"])
def test_words_longer_than_chunks(library, word):
    """Words of one repeated pattern never settle, so guessed entries are often wrong."""
    texts = [word * n for n in (1, 127, 255, 256, 257, 700, 3001)]
    assert tokencount.Counter(WORD_BPE).count(texts).tolist() == lengths(library, texts)


def test_states_are_dropped_and_compiled_again(library, monkeypatch):
    monkeypatch.setattr(tokencount, "MOST_STATES", 50)
    monkeypatch.setattr(tokencount, "RUN", 64)
    texts = odd_texts(6, 300)
    assert tokencount.Counter(WORD_BPE).count(texts).tolist() == lengths(library, texts)


def test_emitted_counts_add_up(library):
    machine = tokencount.Counter(WORD_BPE).machine
    for word in ("internationalization", "thethethe", "zzzqx"):
        state, total = 0, 0
        for byte in word.encode():
            key = np.array([state << 8 | byte])
            if machine.edges.find(key.copy())[0] < 0:
                machine.compile(state, byte)
            slot = machine.edges.find(key)[0]
            state, total = int(machine.edges.targets[slot]), total + int(machine.edges.emits[slot])
        assert total + machine.ending(state) == lengths(library, [word])[0]


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_pieces_of_texts(spark, library, piece):
    texts = ["日本語" * 50 + "。" + "あ" * 30, "<|endoftext|>" * 5 + "it's we'll" * 9, "", None, "a" * 100, "é" * 50 + " " + "é" * 9, "1.2.3 " * 30, "x"]
    texts += ["x"]  # a repeated row
    docs = spark.createDataFrame([(i if i < 8 else 7, t) for i, t in enumerate(texts)], TEXT)
    rows = tokencount.count_tokens(docs, WORD_BPE, limit=40, piece=piece).collect()
    want = sorted(zip([0, 1, 2, 3, 4, 5, 6, 7, 7], [len((t or "").encode()) for t in texts], lengths(library, texts), strict=True))
    assert sorted((r["doc_id"], r["tc_bytes"], r["tc_tokens"]) for r in rows) == want
    assert all(r["tc_over"] == (r["tc_tokens"] > 40) for r in rows)


def test_counts_over_the_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = Q.op11_token_counts(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {i: (len((t or "").encode()), n, n > 2048) for (i, t), n in zip(texts.items(), lengths(library, texts.values()), strict=True)}
    assert len(rows) == len(texts)


def test_counts_of_odd_tables(spark):
    empty = tokencount.count_tokens(spark.createDataFrame([], TEXT), WORD_BPE)
    assert empty.collect() == [] and empty.columns == ["doc_id", "tc_bytes", "tc_tokens", "tc_over"]
    clash = spark.createDataFrame([(None, "a b", "x", "y")], "doc_id long, text string, tc_tokens string, TC_Bytes string")
    row = tokencount.count_tokens(clash, WORD_BPE, keep=("doc_id", "tc_tokens", "TC_Bytes")).first()
    assert (row["doc_id"], row["tc_tokens"], row["TC_Bytes"], row["tc_tokens_"], row["tc_bytes_"]) == (None, "x", "y", 2, 3)
    with pytest.raises(ValueError, match="not BPE with word ends"):
        tokencount.Counter(public_tokenizers.path("byte_bpe_50k.json"))


# --- op12 ----------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error)} and the codebooks, by Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in kept}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut.values():
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[p])]
    found = {i: [near(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    return {i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for i, f in found.items()}, books


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n, size=16, scale=1.0, ties=False):
    r = random.Random(seed)
    pick = (lambda: r.choice([-0.5, 0.0, 0.25])) if ties else (lambda: r.gauss(0, 1) * scale)
    return [(i, [float(np.float32(pick())) for _ in range(size)], r.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize(("n", "scale", "ties"), [(60, 0.2, False), (60, 1.0, True), (5, 1.0, False), (40, 1e6, False), (20, 1e15, False)])
def test_codes_equal_plain_integers(spark, n, scale, ties):
    rows = vectors(n, n, scale=scale, ties=ties)
    want, books = plain_codes([(i, v) for i, v, _ in rows])
    bad = [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 0)]
    got = {r["vec_id"]: r for r in veccodes.compress(spark.createDataFrame([*rows, *bad], VECTORS)).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    assert {i: (r["vc_code"], r["vc_error"]) for i, r in got.items()} == {i: (c, fits(e)) for i, (c, e) in want.items()}
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    assert {r["vc_codebooks"] for r in got.values()} == {digest}
    if all(e < 1 << 62 for _, e in want.values()):
        sums = {}
        for i, _, label in rows:
            sums[label] = sums.get(label, 0) + want[i][1]
        assert {i: got[i]["vc_label_error"] for i, _, _ in rows} == {i: sums[label] for i, _, label in rows}


def test_trees_visit_what_may_tie():
    r = np.random.default_rng(3)
    for size, spread in ((2, 3), (4, 9), (8, 1 << 22)):
        parts, entries = r.integers(-spread, spread + 1, (500, size)), r.integers(-spread, spread + 1, (16, size))
        entries[7] = entries[2]  # a tie goes to the lower index
        all_ = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        best, least = veccodes.nearest(parts, entries)
        assert (best == all_.argmin(1)).all() and (least == all_.min(1)).all()


def test_codes_of_odd_tables(spark):
    assert veccodes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [*vectors(4, 20), (20, [1.0, 2.0], 1), (None, [0.5] * 16, None), (3, [0.5] * 16, 1)]
    clash = spark.createDataFrame(rows, VECTORS).withColumn("vc_code", F.lit("own"))
    got = veccodes.compress(clash, keep=("vec_id", "vc_code")).collect()
    assert len(got) == 23 and all(r["vc_code"] == "own" for r in got)
    assert [(r["vc_code_"], r["vc_error"]) for r in got if r["vec_id"] == 20] == [(None, None)]
    assert sum(r["vec_id"] == 3 for r in got) == 2
    none = veccodes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VECTORS)).collect()
    assert [(r["vc_code"], r["vc_error"]) for r in none] == [(None, None)]


# --- op13 ----------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranks(docs, items, k=10):
    counts = [(d, terms_of(t)) for d, t in docs]
    counts = [(d, len(ts), {t: ts.count(t) for t in set(ts)}) for d, ts in counts if ts]
    n_docs, length = len(counts), sum(n for _, n, _ in counts)
    df = {}
    for _, _, c in counts:
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, n, c in counts:
            m = 10 + 90 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score:
                found.append((-score, d is not None, d or 0))
        out += [(item, rank + 1, d if some else None, -s) for rank, (s, some, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


ITEMS = "item_id long, text string"


@pytest.mark.parametrize(("block", "waves", "section", "most"), [(64, (2, 16), 1 << 18, 1 << 20), (3, (1, 2), 40, 1 << 20), (2, (1, 3), 1 << 18, 0)])
def test_ranks_equal_plain_scores(spark, monkeypatch, block, waves, section, most):
    for name, value in (("BLOCK", block), ("WAVES", waves), ("SECTION_TERMS", section), ("MOST_PAIRS", most)):
        monkeypatch.setattr(ranking, name, value)
    r = random.Random(block)
    vocabulary = [f"w{i}" for i in range(40)] + ["Zwei", "ÄÖ", "日本", "x_y", "3.14"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.randint(3, 45)]) for _ in range(n))
    docs = [(i, r.choice([None, "", "... !"]) if i % 17 == 0 else text(r.randint(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(20)] + [(None, docs[5][1]), (5, docs[5][1])]  # ties, a null id, a repeated row
    items = [(i, text(r.randint(1, 12))) for i in range(12)] + [(50, None), (51, "--"), (52, "unknownword"), (53, docs[5][1]), (53, docs[5][1])]
    got = ranked(ranking.search(spark.createDataFrame(docs, TEXT).repartition(3), spark.createDataFrame(items, ITEMS)))
    assert got == plain_ranks(docs, items)


def test_blocks_are_passed_over(spark, sf_dir, monkeypatch):
    """Bounds let most blocks go unscored, and the result stays whole."""
    pairs, scored = [], ranking.scored

    def counted(found, queries, some, k):
        some = some.select("rk_at", "rk_block").distinct()
        pairs.append(some.count())
        return scored(found, queries, some, k)

    monkeypatch.setattr(ranking, "BLOCK", 4)
    monkeypatch.setattr(ranking, "scored", counted)
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = ranked(ranking.search(docs, items))
    assert got == plain_ranks([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sum(pairs) < items.count() * (docs.count() // 4)


def test_search_in_odd_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], TEXT), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.withColumn("text", F.lit("--")))):
        found = ranking.search(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    same = ranking.search(docs.withColumnRenamed("doc_id", "rank"), items.withColumn("score", F.lit("x")), doc_id="rank")
    assert same.columns == ["item_id", "rank", "rank_", "score"] and same.count() == 1
    long = spark.createDataFrame([(1, "needle " + "hay " * 300_000), (2, "needle"), (3, "other")], TEXT)
    assert [r["doc_id"] for r in ranking.search(long, spark.createDataFrame([(1, "Needle")], ITEMS)).orderBy("rank").collect()] == [2, 1]
