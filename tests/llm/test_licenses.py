"""License matches against brute force over every stretch of text and every order of words."""

import random

import numpy as np
import pyarrow as pa

from shirabe.llm import licenses
from shirabe.llm import words as W


def hashed(text):
    chunks = list(W.word_chunks(pa.array([text]), lower=True, hashed=False))
    return licenses._trimmed(chunks[0]).hashes


def named(text, **more):
    index = licenses.Index(licenses.TEMPLATES, **more)
    return [(index.names[t], a, b) for t, a, b, _ in licenses.matches(index, hashed(text))]


def ending(t, part):
    """Most words of t in order in the part, whose last word is matched."""
    row, best = [0] * (len(t) + 1), 0
    for k, x in enumerate(part):
        if k == len(part) - 1:
            best = max(row[i] + 1 for i in range(len(t)) if t[i] == x)
        new = [0]
        for i, y in enumerate(t):
            new.append(row[i] + 1 if x == y else max(row[i + 1], new[i]))
        row = new
    return best


def brute(index, h, least=licenses.LEAST):
    found = []
    for n, words in enumerate(index.words):
        t = words.tolist()
        for b in range(len(h)):
            if h[b] in t:
                k, a = max(((ending(t, h[a : b + 1]), a) for a in range(b + 1)), key=lambda m: (3 * m[0] + m[1], m[0]))
                if k >= least * len(t) and all(any(h[i : i + len(x)] == x.tolist() for i in range(a, b + 2 - len(x))) for x in index.required[n]):
                    found.append((n, a, b, k))
    new = []
    for m in sorted(found, key=lambda m: (-m[3], len(index.words[m[0]]), m[2] - m[1], m[1], m[0])):
        if not any(m[1] <= k[2] and k[1] <= m[2] for k in new):
            new.append(m)
    if not new:
        return []
    cuts = [0, *(x for m in sorted(new, key=lambda m: m[1]) for x in (m[1], m[2] + 1)), len(h)]
    for a, b in zip(cuts[::2], cuts[1::2]):
        new += [(n, a + x, a + y, k) for n, x, y, k in brute(index, h[a:b], least)]
    return sorted(new, key=lambda m: (m[1], m[0]))


def test_adjacent_repeats():
    for notice in ("mit-notice", "gpl-3.0-notice"):
        n = len(hashed(licenses.TEMPLATES[notice]))
        for between in range(20):
            text = " ".join([licenses.TEMPLATES[notice], *["word"] * between] * 3)
            assert named(text) == [(notice, k * (n + between), k * (n + between) + n - 1) for k in range(3)]


def test_matches_equal_brute_force():
    rng = random.Random(3)
    short = {k: v for k, v in licenses.TEMPLATES.items() if k in ("mit-notice", "apache-2.0-notice", "cc-by-4.0-notice", "cc-by-nc-4.0-notice")}
    index = licenses.Index(short)
    pool = sorted({x for v in short.values() for x in v.split()})
    some = 0
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = rng.choice(list(short.values())).split()
            own = [x for x in own if rng.random() > 0.08]
            if rng.random() < 0.4:
                own.insert(rng.randint(0, len(own)), rng.choice([*pool, "new"]))
            words += own + [rng.choice(["word", *pool]) for _ in range(rng.choice([0, 0, 1, 4]))]
        h = hashed(" ".join(words))
        got = licenses.matches(index, h)
        assert got == brute(index, h.tolist())
        some += len(got)
    assert some > 40


def test_long_templates_equal_short_ones_word_for_word():
    index = licenses.Index({"long": " ".join(f"w{k % 50}" for k in range(90))})
    rng = random.Random(4)
    words = [x for x in index.words[0].tolist() if rng.random() > 0.1]
    words = words[:30] + [1, 2, 3] + words[30:]
    h = np.array(words * 2, np.uint64)
    t = index.words[0].tolist()
    for n, a, b in list(index.ends(0, h))[::17]:
        assert (n, a) == max(((ending(t, h[x : b + 1].tolist()), x) for x in range(b + 1)), key=lambda m: (3 * m[0] + m[1], m[0]))


def test_each_match_is_a_candidate(spark):
    """One word of each notice changed or missing, at each place: what aligns is found by the scan."""
    short = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) < 20}
    index = licenses.Index(short)
    texts = ["Released under an MIT License."]
    for v in short.values():
        own = v.split()
        texts += [" ".join([*own[:k], *by, *own[k + 1 :]]) for k in range(len(own)) for by in (["changed"], [])]
    want = sorted((i, index.names[t], a, b) for i, x in enumerate(texts) for t, a, b, _ in licenses.matches(index, hashed(x)))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), short).collect()
    assert sorted((r["doc_id"], r["license"], r["first_word"], r["last_word"]) for r in rows) == want
    assert want[0] == (0, "mit-notice", 0, 4)
    for i, x in enumerate(texts):
        assert sorted(m[1:] for m in want if m[0] == i) == sorted((index.names[t], a, b) for t, a, b, _ in brute(index, hashed(x).tolist()))


def test_other_licenses_and_prose_have_no_match():
    others = (
        "Released under the BSD License.", "Released under the new license.", "Licensed under the Educational Community License, Version 2.0",
        "Licensed under the Apache License, Version 1.1.", "Licensed under the Academic Free License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the GNU Foo General Public License, version 3.",
        "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "Licensed under the BSD 4-Clause License.", "Licensed under the new 3-Clause License.",
        "The film was released under the old license of the studio, and dedicated to the public domain under law.",
    )
    assert [named(x) for x in others] == [[]] * len(others)
    for name, (first, *rest) in licenses.REQUIRED.items():
        assert licenses.Index({name: licenses.TEMPLATES[name]}).bears(0, hashed(licenses.TEMPLATES[name])), (name, first, rest)
    assert [x for x, *_ in named("Released under the MIT license. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.")] == ["mit-notice", "cc-by-4.0-notice", "cc-by-nc-4.0-notice"]


def test_whole_texts():
    for name, text in licenses.WHOLE.items():
        words = text.split()
        n = len(words)
        assert [x for x, *_ in named(f"Some words before. {text} Some words behind.")] == [name]
        assert [x for x, *_ in named(text, least=0.8)][:1] == [name]
        # The later part is not the whole.
        assert name not in [x for x, *_ in named(" ".join(words[n // 2 :]))]
    affero = licenses.WHOLE["gpl-3.0"].replace("Use with the GNU Affero General Public License", "Remote Network Interaction; Use with the GNU General Public License")
    assert "gpl-3.0" not in [x for x, *_ in named(affero.replace("GNU GENERAL", "GNU AFFERO GENERAL"))]
    assert {"gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "cc-by-sa-4.0", "unlicense", "zlib", "bsd-2", "bsd-3", "apache-2.0"} <= set(licenses.WHOLE)


def test_whole_texts_changed_or_commented(spark):
    rng = random.Random(6)
    cases = {}
    for name in ("mit", "bsd-2", "bsd-3", "isc", "zlib", "unlicense", "lgpl-3.0", "apache-2.0"):
        text = licenses.WHOLE[name]
        cases[name] = "\n".join(f" * {x}" for x in text.splitlines())
        words = [x if rng.random() > 0.02 or x.lower() in ("neither", "name", "the", "apache", "license") else "other" for x in text.split()]
        cases[name + " changed"] = " ".join(words)
    rows = licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == sorted((k, k.split()[0]) for k in cases)


def changed(rng, words, share):
    """Words of a template with some missing, changed or added."""
    out = []
    for x in words:
        r = rng.random()
        out += [] if r < share / 3 else ["other"] if r < 2 * share / 3 else [x, "added"] if r < share else [x]
    return out


def test_fingerprints_and_bands_find_what_the_exact_way_finds():
    """Whole texts with up to a fourth of their words edited, between prose and pieces of others."""
    rng = random.Random(8)
    names = ["mit", "bsd-2", "bsd-3", "isc", "zlib", "unlicense", "0bsd", "ncsa", "unicode-3.0", "ofl-1.1"]
    index = licenses.Index({n: licenses.WHOLE[n] for n in names} | {k: v for k, v in licenses.NOTICES.items() if k in ("mit-notice", "mit-opening", "bsd-opening", "apache-2.0-header")})
    prose = [f"word{i}" for i in range(60)] + "the of this license software and or to in any copyright".split()
    all_, got, same, wrong = 0, 0, 0, 0
    for k in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = licenses.WHOLE[rng.choice(names)].split()
            own = changed(rng, own, rng.choice([0, 0.05, 0.15, 0.25]))
            if rng.random() < 0.2:
                own = own[: len(own) // 2]
            words += [rng.choice(prose) for _ in range(rng.choice([0, 5, 300]))] + own
        h = hashed(" ".join(words))
        want, found = licenses.matches(index, h, exact=True), licenses.matches(index, h)
        all_ += len(want)
        # Without a band an alignment may draw a last word or two from far behind; the stretch is then longer.
        got += sum(any(f[0] == w[0] and f[1] <= w[2] and w[1] <= f[2] and f[3] >= 0.97 * w[3] for f in found) for w in want)
        same += len(set(want) & set(found))
        wrong += sum(f[0] not in [m[0] for m in licenses.matches(index, h[f[1] : f[2] + 1], exact=True)] for f in found)
    assert all_ > 120 and got == all_ and same >= 0.97 * all_ and not wrong, (all_, got, same, wrong)


def test_winnowing_leaves_no_gap():
    rng = random.Random(9)
    for n in (1, 2, 3, 50):
        h = np.array([rng.randrange(6) for _ in range(n)], np.uint64)
        at = set(licenses.winnowed(h).tolist())
        for i in range(max(1, n - licenses.WINDOW + 1)):
            window = h[i : i + licenses.WINDOW].tolist()
            assert any(i + k in at and window[k] == min(window) for k in range(len(window)))


def test_banded_alignment_equals_the_unbanded_one_within_its_band():
    index = licenses.Index({"long": " ".join(f"w{k % 70}" for k in range(200))})
    rng = random.Random(10)
    words = [x for x in index.words[0].tolist() if rng.random() > 0.1]
    h = np.array([1, 2, 3, *words[:90], 4, 5, *words[90:]], np.uint64)
    assert list(index.ends(0, h, (-300, 300))) == list(index.ends(0, h))
    best = lambda found: max(found, key=lambda m: (m[0], -m[2]))
    assert best(index.ends(0, h, (-30, 10))) == best(index.ends(0, h))


def test_licenses_in_odd_tables(spark):
    """Nulls, repeated rows, clashing names, a very long text, templates that repeat."""
    mit = licenses.WHOLE["mit"]
    rows = [(1, None, "x"), (2, "", "x"), (3, mit, "x"), (3, mit, "x"), (None, "Released under the MIT License.", "y"), (4, "hay " * 200_000 + mit + " hay" * 1000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license string").withColumnRenamed("license", "coverage")
    got = licenses.scan(df).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in got) == [("3", "mit"), ("3", "mit"), ("4", "mit"), ("None", "mit-notice")]
    assert [r["first_word"] for r in got if r["doc_id"] == 4] == [200_000]
    assert licenses.scan(df.limit(0)).collect() == []
    twice = licenses.Index({"one": mit, "two": mit})
    assert [twice.names[m[0]] for m in licenses.matches(twice, hashed(mit))] == ["one"]
