"""License scans: winnowed fingerprints of templates in an inverted index, and banded alignment.

Templates and texts are sequences of normal words (lower-case, marks at the ends dropped). Of a long template (more
than LONG words) every GRAM words in a row are hashed, of every WINDOW hashes in a row the least is a fingerprint, and
the index has for each fingerprint its templates and places. A text's own hashes are looked up there: a stretch of
GRAM + WINDOW - 1 words that text and template share has a fingerprint, and as a match may lack a fifth of the
template's words, some four in a row are left unless words were added between them. Hits of a template on neighbouring
diagonals (place in the text less place in the template) make a candidate: the stretch of text that a match around
those diagonals can take, if it has enough of the template's words in any order. It is aligned in a band of BAND of
the template's words around the diagonals, and at least BAND_LEAST.

Short templates (notices, headers) are too short for fingerprints: of the longest words, one more than a match may lack
go to the index, so each match has one of them, however it is changed, and they are aligned without a band. The
index, whose size is that of the templates and never of the corpus, goes to the executors.

An alignment is, for each word where one can end, the one with the highest 2 * words matched - words added between them,
of equals that with more words. This tolerates added, missing and changed words, and never joins two copies into
one. Alignments that cover LEAST of the template's words are matches, with the span of the words they aligned, if the
span holds the words that tell the license from others (`required`: name, number of clauses, version), each phrase
unbroken; where they overlap, the better one stays, and the words between those that stay are searched again until
nothing is found. `matches(..., exact=True)` aligns every template with enough words, without fingerprints and bands.

The templates here are whole license texts (folder license_texts), and short notices, headers and
opening words as further ones; `templates` takes any others. Templates that repeat a text each match it; of equals the
first stays.

Cases: null and empty text have no match; repeated rows are scanned each; of overlapping
matches the one with most words stays, of equals that of the shorter template, then the first; a very
long text is scanned as a whole, its candidates each in time linear in their words; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shirabe.llm import words as W

LEAST = 0.8
_SHIFT = 1 << 31  # a score and a first word in one number

#: Short notices, headers of source files and opening words of public license texts.
NOTICES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc0-notice": "Dedicated to the public domain under CC0 1.0.",
    "bsd-3-notice": "Licensed under the BSD 3-Clause License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "bsd-2-notice": "Licensed under the BSD 2-Clause License.",
    "isc-notice": "Released under the ISC License.",
    "zlib-notice": "Released under the zlib License.",
    "epl-2.0-notice": "This program is made available under the terms of the Eclipse Public License 2.0.",
    "gpl-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-opening": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
#: Whole license texts, one for each license and version, without title and copyright lines where those
#: are the holder's own.
WHOLE: dict[str, str] = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files("shirabe.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name)}
TEMPLATES: dict[str, str] = NOTICES | WHOLE

#: What a match's stretch of text must hold, word for word, to bear the template's name.
REQUIRED: dict[str, tuple[str, ...]] = {
    "mit-notice": ("MIT",),
    "apache-2.0-notice": ("Apache License", "2.0"),
    "gpl-3.0-notice": ("GNU General Public License", "version 3"),
    "cc-by-nc-4.0-notice": ("CC BY-NC 4.0",),
    "cc-by-4.0-notice": ("CC BY 4.0",),
    "cc0-notice": ("CC0",),
    "bsd-3-notice": ("BSD 3-Clause",),
    "mpl-2.0-notice": ("Mozilla Public License", "2.0"),
    "gpl-2.0-notice": ("GNU General Public License", "version 2"),
    "lgpl-2.1-notice": ("GNU Lesser General Public License", "version 2.1"),
    "lgpl-3.0-notice": ("GNU Lesser General Public License", "version 3"),
    "agpl-3.0-notice": ("GNU Affero General Public License", "version 3"),
    "cc-by-sa-4.0-notice": ("CC BY-SA 4.0",),
    "cc-by-nc-sa-4.0-notice": ("CC BY-NC-SA 4.0",),
    "cc-by-nc-nd-4.0-notice": ("CC BY-NC-ND 4.0",),
    "bsd-2-notice": ("BSD 2-Clause",),
    "isc-notice": ("ISC",),
    "zlib-notice": ("zlib",),
    "epl-2.0-notice": ("Eclipse Public License", "2.0"),
    "gpl-2.0-header": ("GNU General Public License", "version 2"),
    "gpl-3.0-header": ("GNU General Public License", "version 3"),
    "lgpl-2.1-header": ("GNU Lesser General Public License", "version 2.1"),
    "lgpl-3.0-header": ("GNU Lesser General Public License", "version 3"),
    "agpl-3.0-header": ("GNU Affero General Public License", "version 3"),
    "apache-2.0-header": ("Apache License", "2.0"),
    "mit": ("shall be included in all copies",),
    "isc": ("appear in all copies",),
    "bsd-3": ("neither the name",),
    "gpl-3.0": ("Use with the GNU Affero General Public License",),
    "apache-2.0": ("Apache License",),
    "cc-by-sa-4.0": ("Attribution-ShareAlike 4.0",),
    "mpl-1.1": ("Mozilla Public License",),
}

_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'()[]{}<>.,;:!?*#/|`~-_=")] = True


def _trimmed(w: W.Words) -> W.Words:
    """Words without marks at their ends (a word of marks alone keeps its first), hashed."""
    starts, ends = w.starts.copy(), w.ends.copy()
    while len(m := np.flatnonzero((ends - starts > 1) & _EDGE[w.data[starts]])):
        starts[m] += 1
    while len(m := np.flatnonzero((ends - starts > 1) & _EDGE[w.data[ends - 1]])):
        ends[m] -= 1
    return W.Words(w.lo, w.hi, w.data, w.bounds, starts, ends, w.first, W.byte_hashes(w.data, starts, ends))


def _words(text: str) -> W.Words:
    (w,) = W.word_chunks(pa.array([text]), lower=True, hashed=False)
    return _trimmed(w)


LONG = 64  #: words of a long template
#: Words that a hash is of, and hashes in a row of which the least is a fingerprint.
GRAM, WINDOW = 3, 2
#: Half the width of a band: a share of the template's words, and the least.
BAND, BAND_LEAST = 0.25, 48


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: in every WINDOW hashes the least, of equals the last."""
    if len(hashes) <= WINDOW:
        return np.arange(len(hashes))[np.argmin(hashes) :][:1] if len(hashes) else np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(rows)) + WINDOW - 1 - rows.argmin(axis=1))


def _grams(hashes: np.ndarray) -> np.ndarray:
    return W.gram_hashes(hashes, GRAM, 7)


def _certain(words: np.ndarray, lengths: np.ndarray, least: float) -> np.ndarray:
    """The longest words of a short template, one more than a match may lack, so that it has one."""
    spare = len(words) - int(np.ceil(least * len(words)))
    return words[np.argsort(-lengths, kind="stable")[: spare + 1]]


class Index:
    """Templates' word hashes; postings of the long ones' fingerprints; words of the short ones that a match has one of."""

    def __init__(self, templates: Mapping[str, str], least: float = LEAST, required: Mapping[str, Sequence[str]] = REQUIRED) -> None:
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        keys, posted = [np.zeros(0, np.uint64)], []
        for t, text in enumerate(templates.values()):
            w = _words(text)
            self.words.append(w.hashes)
            if len(w.hashes) > LONG:
                grams = _grams(w.hashes)
                at = winnowed(grams)
                posted.append((grams[at], np.full(len(at), t), at))
            else:
                keys.append(_certain(w.hashes, w.ends - w.starts, least))
        self.keys = np.unique(np.concatenate(keys))
        prints, owner, place = (np.concatenate(x) for x in zip(*posted, strict=True)) if posted else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(prints, kind="stable")
        self.prints, self.owner, self.place = prints[order], owner[order], place[order]
        self.required = [[_words(x).hashes for x in required.get(n, ())] for n in self.names]
        self.sets = [np.unique(w) for w in self.words]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.bags = [(np.searchsorted(self.vocabulary, v), n) for v, n in (np.unique(w, return_counts=True) for w in self.words)]
        self.places: dict[int, dict] = {}

    def possible(self, w: W.Words) -> np.ndarray:
        """The documents of a chunk with a word of a short template's index or a fingerprint of a long one."""
        found = w.doc[np.isin(w.hashes, self.keys)]
        grams = np.flatnonzero(np.isin(_grams(w.hashes), self.prints))
        doc = w.doc
        grams = grams[doc[grams] == doc[grams + GRAM - 1]] if len(grams) else grams
        return np.union1d(found, doc[grams])

    def candidates(self, hashes: np.ndarray, least: float = LEAST) -> list[tuple[int, int, int, int, int]]:
        """(template, first, end, lowest and highest diagonal of the band) of each stretch of a text that may hold a match
        with a long template."""
        grams = _grams(hashes)
        lo, hi = np.searchsorted(self.prints, grams, "left"), np.searchsorted(self.prints, grams, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(grams)), n)
        posting = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        owner, diagonal = self.owner[posting], at - self.place[posting]
        found = []
        for t in np.unique(owner).tolist():
            size = len(self.words[t])
            band = max(BAND_LEAST, int(BAND * size))
            own = np.unique(diagonal[owner == t])
            cut = np.flatnonzero(np.diff(own) > band) + 1
            for group in np.split(own, cut):
                low, high = int(group[0]) - band, int(group[-1]) + band
                first, end = max(0, low), min(len(hashes), high + size)
                if self.enough(t, hashes[first:end], least):
                    found.append((t, first, end, low, high))
        return found

    def enough(self, template: int, hashes: np.ndarray, least: float = LEAST) -> bool:
        """Whether a text has enough of a template's words, whatever their order."""
        need = least * len(self.words[template])
        if len(hashes) < need:
            return False
        own = hashes[np.isin(hashes, self.sets[template])]
        ids, n = self.bags[template]
        counts = np.bincount(np.searchsorted(self.vocabulary, own), minlength=len(self.vocabulary))
        return bool(np.minimum(counts[ids], n).sum() >= need)

    def _places(self, template: int) -> dict:
        """Where the template has each of its words; from the last place in short templates."""
        if template not in self.places:
            w = self.words[template]
            found = {int(x): np.flatnonzero(w == x) for x in self.sets[template]}
            self.places[template] = found if len(w) > LONG else {x: at[::-1].tolist() for x, at in found.items()}
        return self.places[template]

    def present(self, hashes: np.ndarray, least: float = LEAST) -> list[int]:
        """The templates of which a text has enough words, whatever their order."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        counts = np.bincount(at[self.vocabulary[at] == hashes], minlength=len(self.vocabulary))
        return [t for t, (ids, n) in enumerate(self.bags) if len(hashes) >= least * len(self.words[t]) and np.minimum(counts[ids], n).sum() >= least * len(self.words[t])]

    def ends(self, template: int, hashes: np.ndarray, band: tuple[int, int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(words matched, first, last) of the best alignment that ends at each word of the text that
        the template has, within a band of diagonals if one is given (long templates). best[i] is the best with the template's first i words: 3 * matched + first
        orders alignments as 2 * matched - added does wherever they end, and of equals the one with
        more words has the earlier first word."""
        at, m = self._places(template), len(self.words[template])
        long = m > LONG
        best = np.full(m + 1, -_SHIFT, np.int64) if long else [-_SHIFT] * (m + 1)
        reach = 0
        for p in np.flatnonzero(np.isin(hashes, self.sets[template])).tolist():
            fresh = (3 + p) * _SHIFT + _SHIFT - 1 - p
            where = at[int(hashes[p])]
            if long:
                end = m
                if band:
                    # Only the template's words within the band; best is up to date as far as the band has reached.
                    end = min(m, p - band[0] + 1)
                    if end > reach:
                        rest = best[reach : end + 1]
                        np.maximum.accumulate(rest, out=rest)
                        reach = end
                    where = where[np.searchsorted(where, p - band[1]) : np.searchsorted(where, end)]
                    if not len(where):
                        continue
                values = np.maximum(best[where] + 3 * _SHIFT, fresh)
                best[where + 1] = np.maximum(best[where + 1], values)
                rest = best[where[0] + 1 : end + 1]
                np.maximum.accumulate(rest, out=rest)
                top = int(values.max())
            else:
                top = fresh
                for i in where:  # from the last place: each takes the values before this word
                    value = max(best[i] + 3 * _SHIFT, fresh)
                    top = max(top, value)
                    while i < m and best[i + 1] < value:
                        i += 1
                        best[i] = value
            first = _SHIFT - 1 - top % _SHIFT
            yield (top // _SHIFT - first) // 3, first, p

    def bears(self, template: int, stretch: np.ndarray) -> bool:
        """Whether a stretch of text holds what the template's name requires."""
        return all(any((stretch[i : i + len(x)] == x).all() for i in np.flatnonzero(stretch[: len(stretch) - len(x) + 1] == x[0])) for x in self.required[template])

    def align(self, template: int, hashes: np.ndarray, start: int) -> tuple[int, int, int]:
        """(words matched, first, last) of the alignment with most words in the text from start."""
        found = [(n, a + start, b + start) for n, a, b in self.ends(template, hashes[start:])]
        return max(found, key=lambda m: (m[0], m[1] - m[2]), default=(0, 0, 0))


def matches(index: Index, hashes: np.ndarray, least: float = LEAST, exact: bool = False) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, words matched) of each match in a text; exact: without fingerprints and bands."""
    kept: list[tuple[int, int, int, int]] = []
    regions = [(0, len(hashes))]
    while regions:
        lo, hi = regions.pop()
        part = hashes[lo:hi]
        tried = [(t, 0, len(part), None) for t in index.present(part, least) if exact or len(index.words[t]) <= LONG]
        if not exact:
            tried += [(t, a, b, (low - a, high - a)) for t, a, b, low, high in index.candidates(part, least)]
        found = []
        for t, begin, end, band in tried:
            need = least * len(index.words[t])
            found += [(t, begin + a, begin + b, n) for n, a, b in index.ends(t, part[begin:end], band) if n >= need and index.bears(t, part[begin + a : begin + b + 1])]
        found = list(dict.fromkeys(found))
        taken = np.zeros(hi - lo, bool)
        new = []
        for m in sorted(found, key=lambda m: (-m[3], len(index.words[m[0]]), m[2] - m[1], m[1], m[0])):
            if not taken[m[1] : m[2] + 1].any():
                taken[m[1] : m[2] + 1] = True
                new.append((m[0], lo + m[1], lo + m[2], m[3]))
        if new:
            # What lies between may hold matches whose alignments were drawn into those taken.
            kept += new
            cuts = [lo, *(x for m in sorted(new, key=lambda m: m[1]) for x in (m[1], m[2] + 1)), hi]
            regions += [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b]
    return sorted(kept, key=lambda m: (m[1], m[0]))


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", required: Mapping[str, Sequence[str]] = REQUIRED) -> DataFrame:
    """doc_id, license, coverage (share of the template's words), n_matched, first_word, last_word and
    start and end (code points) of each match."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    index = Index(templates, least, required)
    names = ["doc_id", "license", "coverage", "n_matched", "first_word", "last_word", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in W.word_chunks(batch.column(1), lower=True, hashed=False):
                w = _trimmed(raw)
                rows = []
                for d in index.possible(w):
                    a, b = w.first[d], w.first[d + 1]
                    for t, first, last, n in matches(index, w.hashes[a:b], least):
                        begin = w.bounds[d]
                        chars = lambda at: int(((w.data[begin:at] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                        rows.append((w.lo + int(d), index.names[t], n / len(index.words[t]), n, first, last, chars(w.starts[a + first]), chars(w.ends[a + last])))
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(rest[0]), pa.array(rest[1], pa.float64()), *(pa.array(c, pa.int64()) for c in rest[2:])], names)

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {id_type}, license string, coverage double, n_matched bigint, first_word bigint, last_word bigint, start bigint, `end` bigint")
