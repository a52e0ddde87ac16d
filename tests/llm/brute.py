"""Plain definitions of what the operators compute, for small tables."""

import re
import zlib
from array import array
from collections import Counter, defaultdict
from functools import cache

from shirabe.llm import credentials, encoding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.public_path(name))


def ids_of(name, text):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids


def shingles(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, percent=80):
    """{id: smallest id reachable}."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = [k for k in sorted(sets) if sets[k]]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= percent * large and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def good(text):
    """Whether no quality rule rejects a text."""
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    grams = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover = {j for i in range(n - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    duplicates, chars = len(lines) - len(set(lines)), sum(map(len, w))
    upper, lower = len(re.findall("[A-ZÀ-ÖØ-Þ]", t)), len(re.findall("[a-zß-öø-ÿ]", t))
    echo = sum(a == b for a, b in zip(w, w[1:]))
    return not (
        n < 20 or 100 * len(cover) > 30 * n or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 30 * n or upper > lower or 100 * echo > 30 * n
        or (duplicates >= 5 and 2 * duplicates > len(lines)) or chars < 2 * n or chars > 20 * n
    )


def secrets(text):
    """(start, end) of strong matches and of weak ones with their complement within SCOPE."""
    found = []
    for kind in credentials.KINDS:
        for m in re.finditer(kind.pattern.replace(r"\b", r"(?a:\b)"), text):
            if len(m[kind.group]) >= kind.least and all(re.search(p, m[0]) for p in kind.must):
                found.append((kind, m.start(), m.end()))
    near = lambda at, role: any(k.role == role and abs(a - at) <= credentials.SCOPE for k, a, _ in found)
    I, S = credentials.IDENTIFIER, credentials.SECRET  # noqa: E741
    needs = {I: (S,), S: (I,), credentials.ENDPOINT: (I, S)}
    return sorted((a, b) for k, a, b in found if k.strong or all(near(a, r) for r in needs[k.role]))


def redacted(text, mark=credentials.MARK):
    joined = []
    for a, b in secrets(text):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, at = "", 0
    for a, b in joined:
        out, at = out + text[at:a] + mark, b
    return out + text[at:]


def pieces(name, text, capacity, end):
    """(piece, start, length, checksum) of a document."""
    ids = [*ids_of(name, text), end]
    first = (len(ids) - 1) % capacity + 1
    bounds = [0, *range(first, len(ids) + 1, capacity)]
    return [(i, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def check_packing(rows, texts, capacity=2048, end=0, name="byte_bpe_50k.json"):
    """rows of the packing of texts (a list of (id, text)): pieces as they must be, sequences without gaps,
    and hardly more of them than the ids need."""
    want = Counter((k, *p) for k, t in texts for p in pieces(name, t, capacity, end))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(p[3] for p in want.elements()) // capacity) * 1.02 + 2


def targets(sizes, cap=3):
    """Targets of sources: shares by weight 1, 2, 3, ..., the excess over cap times a size given to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        level = (sum(sizes.values()) - sum(cap * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: level * weight[s] if s in free else float(cap * sizes[s]) for s in order}
        capped |= over
