"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them (operator 8).

A text's five-word shingles are cut into windows of w = 8, 16, 32, ... shingles that overlap by half, so an occurrence of a template of
w / 2 shingles or fewer lies whole in one of them. A template is looked up among the windows of its own size (the least
w that is twice its shingles or more). Of a window that holds 0.8 of the template, the Jaccard similarity with it is 0.8 m / (w + 0.2 m) or
more: a fifth or so, for the smallest window and a template of one shingle an eighth. Bands have one row each, and with
64 of them such a window misses its template with a chance of (1 - 1/8)^64 = 0.0002 at most, and 10^-6 for
templates of over w / 4 shingles. What the bands retrieve is verified exactly.

Everything happens where the text is read; the templates are a list of fixed size.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, table
from .words import PUNCTUATION, plain_words, ranges, seeds_of, slices

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, SMALLEST = 64, 8
#: Templates go to every task.
MAX_TEMPLATES = 10_000
#: A notice of up to so many words is found only with its version; a text from so many words on takes the place of what it overlaps.
NOTICE_WORDS, WHOLE_WORDS = 12, 100
#: Words that alone tell a shorter text from that of another license: it is found only with them, and takes the other's place.
MARKS = {"affero", "lesser", "sharealike", "attribution-sharealike", "attribution-noncommercial"}

#: Notices by which licenses are given, with their SPDX names.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0 International.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
for _name, _more in {
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
}.items():
    TEMPLATES.setdefault(_name, []).extend(_more)
#: Whole texts, a file for each SPDX name.
for _file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text())


class Templates:
    """The templates' shingles and, by window size, their band values."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, texts = zip(*((k, t) for k, own in templates.items() for t in own), strict=True) if templates else ((), ())
        if len(texts) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        words, starts = plain_words(pa.array(texts, pa.string()))
        self.words = np.diff(starts)
        if (self.words < SHINGLE).any():
            raise ValueError(f"a template of fewer than {SHINGLE} words")
        h, at = seeds_of(words, starts, SHINGLE)
        own = np.searchsorted(starts, at, side="right") - 1
        self.shingles = [np.unique(h[own == i]) for i in range(len(texts))]
        # the shingles of shorter texts that hold a mark, else of one-line notices those that hold a word with a digit
        plain = [x for t in texts for x in (y.strip(PUNCTUATION) for y in t.lower().split()) if x]
        digit = np.array([any(c.isdigit() for c in x) for x in plain], bool)
        versioned = np.array([digit[i : i + SHINGLE].any() for i in at], bool)
        mark = np.array([x in MARKS for x in plain], bool)
        marking = np.array([mark[i : i + SHINGLE].any() for i in at], bool)
        self.marked = [self.words[i] < WHOLE_WORDS and bool((marking & (own == i)).any()) for i in range(len(texts))]
        self.version = [h[(own == i) & (marking if self.marked[i] else versioned)] if self.marked[i] or self.words[i] <= NOTICE_WORDS else h[:0] for i in range(len(texts))]
        self.factors = np.random.default_rng(11).integers(0, 1 << 63, BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.level = [max(0, int(np.ceil(np.log2(2 * len(s) / SMALLEST)))) for s in self.shingles]
        self.levels = 1 + max(self.level, default=-1)
        self.bands: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        for f in self.factors:
            row = []
            for k in range(self.levels):
                mine = np.array([i for i, x in enumerate(self.level) if x == k], np.int64)
                value = np.array([(self.shingles[i] * f).min() for i in mine], np.uint64)
                order = np.argsort(value, kind="stable")
                bits = np.zeros(1 << 16, bool)
                bits[value >> np.uint64(48)] = True
                row.append((value[order], mine[order], bits))
            self.bands.append(row)


def _windows(count: np.ndarray, half: int) -> np.ndarray:
    """Half windows of each text."""
    return -(-count // half)


def candidates(h: np.ndarray, first: np.ndarray, count: np.ndarray, t: Templates) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h: shingles of texts, text i's count[i] from first[i] on. Distinct (text, template, first and last shingle of the window)."""
    half = SMALLEST // 2
    blocks = _windows(count, half)
    # each text's shingles up to whole half windows; the last one is repeated, which no minimum minds
    pad = np.minimum(ranges(np.zeros(len(count), np.int64), blocks * half), np.repeat(count - 1, blocks * half)) + np.repeat(first, blocks * half)
    padded = h[pad]
    layout = []  # by level: half windows of each text, where they start, which of them pair up
    n = blocks
    for _ in range(t.levels):
        start = np.concatenate([[0], np.cumsum(n)])
        layout.append((n, start, np.repeat(np.arange(len(n)), n)))
        n = -(-n // 2)
    found = set()
    for f, row in zip(t.factors, t.bands, strict=True):
        v = padded * f
        low = np.minimum(np.minimum(v[0::4], v[1::4]), np.minimum(v[2::4], v[3::4]))
        for k, (value, mine, bits) in enumerate(row):
            n, start, text = layout[k]
            if k:
                before, before_start, _ = layout[k - 1]
                a = np.repeat(before_start[:-1] - 2 * start[:-1], n) + 2 * np.arange(len(text))
                b = np.minimum(a + 1, np.repeat(before_start[1:] - 1, n))
                low = np.minimum(low[a], low[b])
            if not len(value):
                continue
            window = low.copy()
            same = text[1:] == text[:-1]
            window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
            at = np.flatnonzero(bits[window >> np.uint64(48)])
            for i in at:
                x, y = np.searchsorted(value, window[i], "left"), np.searchsorted(value, window[i], "right")
                for m in mine[x:y]:
                    found.add((int(text[i]), int(m), k, int(i - start[text[i]])))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, template, level, place = np.array(sorted(found), np.int64).T
    size = half << level
    # a window with its neighbours, so that an occurrence that bands found by a part is seen whole
    return text, template, np.maximum((place - 1) * size, 0), np.minimum((place + 3) * size, count[text])


def licenses_of(texts: pa.Array, t: Templates) -> list[tuple[int, int, float, int, int]]:
    """(text, template, containment, first word, end word) of each verified occurrence."""
    words, starts = plain_words(texts)
    h, at = seeds_of(words, starts, SHINGLE)
    if not len(h) or not t.names:
        return []
    own = np.searchsorted(starts, at, side="right") - 1
    full, first, count = np.unique(own, return_index=True, return_counts=True)
    out: dict[tuple[int, int], list] = {}
    for i, m, lo, hi in zip(*candidates(h, first, count, t), strict=True):
        part = h[first[i] + lo : first[i] + hi]
        hits = np.flatnonzero(np.isin(part, t.shingles[m]))
        # occurrences lie apart: a new one begins where the hits are further apart than the template is long
        for group in np.split(hits, np.flatnonzero(np.diff(hits) > t.words[m]) + 1):
            share = len(np.unique(part[group])) / len(t.shingles[m])
            if share >= CONTAINMENT and (not len(t.version[m]) or np.isin(t.version[m], part[group]).any()):
                out.setdefault((int(full[i]), int(m)), []).append((int(lo + group[0]), int(lo + group[-1]) + SHINGLE, share))
    rows = []
    for (text, m), spans in sorted(out.items()):
        now = None
        for a, b, share in sorted(spans):
            if now and a < now[1]:
                now = (now[0], max(now[1], b), max(now[2], share))
            else:
                if now:
                    rows.append((text, m, now[2], now[0], now[1]))
                now = (a, b, share)
        rows.append((text, m, now[2], now[0], now[1]))
    return _without_covered(rows, t)


def _without_covered(rows: list[tuple[int, int, float, int, int]], t: Templates) -> list[tuple[int, int, float, int, int]]:
    """rows without those that lie by half or more in an occurrence of a whole or marked text that has more of its shingles there."""
    held = [r[2] * len(t.shingles[r[1]]) for r in rows]
    whole: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        if t.words[r[1]] >= WHOLE_WORDS or t.marked[r[1]]:
            whole.setdefault(r[0], []).append(i)
    covered = lambda i, j: held[j] > held[i] and 2 * (min(rows[i][4], rows[j][4]) - max(rows[i][3], rows[j][3])) >= rows[i][4] - rows[i][3]
    return [r for i, r in enumerate(rows) if not any(covered(i, j) for j in whole.get(r[0], []))]


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each stretch that a template covers: doc_id, license, template (its number), containment, first_word, end_word.

    Copies of a template that follow each other within its own length are one stretch.

    Words are compared in lower case and without ASCII punctuation around them; places count such words, ends exclusive. Null texts and
    texts of fewer than five words hold nothing; repeated documents have their own rows.
    """
    own = TEMPLATES if templates is None else templates

    def run(batches):
        t = Templates(own)
        for b in slices(batches):
            rows = licenses_of(b["text"], t)
            if rows:
                text, m, share, first, end = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(text)), pa.array([t.names[i] for i in m]), pa.array(m, pa.int32()), pa.array(share), pa.array(first), pa.array(end)], ["doc_id", "license", "template", "containment", "first_word", "end_word"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, license string, template int, containment double, first_word long, end_word long")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, template, containment, first_word, end_word of all license texts and notices in every document; a null text holds none, rows of a repeated doc_id have their own rows."""
    return license_scan(table(spark, sf_dir, "documents"))
