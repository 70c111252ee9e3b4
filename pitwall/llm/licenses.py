"""License scans: winnowed template fingerprints pick candidates, banded alignment reports them.

Templates are cut into words like documents (lower-cased runs of letters and digits).
Their winnowed k-gram fingerprints form an inverted index from hash to template and
place. A document's fingerprints are looked up in it; hits of one template near one
diagonal are a candidate. Around its diagonal, template and document words are
aligned within a band, matches counting for and gaps and mismatches against. The
candidate is reported if the matched share of the template's words, its coverage,
reaches ``least``, with the span from the first to the last matched word.

Templates of up to ``SHORT`` words are fingerprinted by all grams as long as the run of
words that ``least`` guarantees to be left unchanged, so that coverage decides. In those of up to ``span`` words the
words that no such template of another license has, its name above all, must match. A
match with changes that lies within a span of the same license with more matched words
is left out. A template without words is ignored, as is one whose text or name is null. The index goes to
every task, so templates may hold ``MAX_BYTES`` at most (an error else). Null and
empty texts have no license. Rows with one doc_id twice are scanned each on its own.
Equal spans of two templates are two rows. Empty tables give no rows. Only doc_id and
text of documents, and license and text of templates, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwall.llm.common import slices, texts_of
from pitwall.llm.words import LOWER, classes, grams, hashes, runs, winnow

MAX_BYTES = 16 << 20
SHORT = 40
PARAGRAPH = 20
WORD = classes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
FOUND = "doc_id long, license string, template int, matched int, coverage double, start int, end int"

# Notices by which licenses are usually declared.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                         "of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
HEADERS = [
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                          "the GNU Affero General Public License as published by the Free Software Foundation, either "
                          "version 3 of the License, or (at your option) any later version."),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def templates(spark: SparkSession) -> DataFrame:
    """Notices, headers, the bodies in ``license_texts`` and each of their paragraphs of ``PARAGRAPH`` words or more."""
    rows = NOTICES + HEADERS
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        body = path.read_text(encoding="utf-8")
        parts = [" ".join(p.split()) for p in body.replace("\f", "\n").split("\n\n")]
        rows = rows + [(path.stem, x) for x in [body, *parts] if len(x.split()) >= PARAGRAPH]
    return spark.createDataFrame(list(dict.fromkeys(rows)), "license string, text string")


class Index:
    """Templates' words and, by fingerprint class, sorted hashes with template and place."""

    def __init__(self, templates: list[tuple[str, str]], k: int, span: int, least: float):
        self.names, self.words, self.classes = [], [], []
        each: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, text in templates:
            data, starts, ends, doc = _cut(pa.array([text]))
            if not len(starts):
                continue
            words = hashes(data, starts, ends)
            size = min(span, len(words))
            kind = min(k, size), size
            if len(words) <= SHORT:
                kept = max(1, math.ceil(least * len(words)))
                run = -(-kept // (len(words) - kept + 1))
                kind = min(k, run), min(span, run)
            h = grams(words, *kind)
            at = winnow(h, doc, kind[0], kind[1] - kind[0] + 1)
            each.setdefault(kind, []).append((h[at], np.stack([np.full(len(at), len(self.names)), at], 1)))
            self.names.append(name)
            self.words.append(words)
        owners: dict[int, set[str]] = {}
        short = [t for t, words in enumerate(self.words) if len(words) <= span]
        for t in short:
            for w in self.words[t].tolist():
                owners.setdefault(w, set()).add(self.names[t])
        self.naming = {t: {i for i, w in enumerate(self.words[t].tolist()) if len(owners[w]) == 1} for t in short}
        for kind, parts in each.items():
            h, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.classes.append((kind, h[order], place[order]))


def _cut(texts: pa.Array):
    data, offsets = texts_of(texts)
    data = LOWER[data]
    return data, *runs(WORD[data], offsets)


def align(a: np.ndarray, b: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of the best alignment of a with a part of b.

    Place j of b is within ``band`` of ``diagonal`` plus the place in a. A match scores
    2, a mismatch or a gap -1; what a leaves over at its ends is free.
    """
    width = 2 * band + 1
    score = np.zeros((len(a) + 1, width + 1), np.int64)  # cell (i, d): a[:i] with b[:i + diagonal + d - band]
    step = np.zeros((len(a) + 1, width + 1), np.int8)
    best, end = (0, 0), None
    for i in range(1, len(a) + 1):
        for d in range(width):
            j = i + diagonal + d - band
            if not 0 < j <= len(b):
                continue
            value, way = 0, 0
            x = score[i - 1, d] + (2 if a[i - 1] == b[j - 1] else -1)
            if x > value:
                value, way = x, 1
            if score[i - 1, d + 1] - 1 > value and d + 1 < width:  # a word of a left out
                value, way = score[i - 1, d + 1] - 1, 2
            if d and score[i, d - 1] - 1 > value:  # a word of b left out
                value, way = score[i, d - 1] - 1, 3
            score[i, d], step[i, d] = value, way
            if value and (value, -abs(d - band)) > best:  # of equals the one nearest to the diagonal
                best, end = (value, -abs(d - band)), (i, d)
    out = []
    while end and step[end]:
        i, d = end
        j = i + diagonal + d - band
        if step[end] == 1 and a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
        end = {1: (i - 1, d), 2: (i - 1, d + 1), 3: (i, d - 1)}[int(step[end])]
    return out[::-1]


def _most(a: np.ndarray, b: np.ndarray, diagonal: int, band: int) -> int:
    """Words of a that are somewhere in their band of b: no alignment matches more."""
    found = np.zeros(len(a), bool)
    for d in range(diagonal - band, diagonal + band + 1):
        low, high = max(0, -d), min(len(a), len(b) - d)
        if low < high:
            found[low:high] |= a[low:high] == b[low + d:high + d]
    return int(found.sum())


def _fullest(found: list[tuple]) -> list[tuple]:
    """Without matches with changes that lie within a span of their license with more matched words."""
    groups: dict[tuple, list[tuple]] = {}
    for x in found:
        groups.setdefault(x[:2], []).append(x)
    return [x for x in found if x[4] == 1 or not any(
        y[3] > x[3] and y[5] <= x[5] and x[6] <= y[6] for y in groups[x[:2]])]


def _candidates(template: np.ndarray, doc: np.ndarray, diagonal: np.ndarray, band: int) -> Iterator[tuple[int, int, int]]:
    """(document, template, diagonal): hits of a template on diagonals that are close make one."""
    order = np.lexsort((diagonal, template, doc))
    last = None
    for t, d, g in zip(template[order].tolist(), doc[order].tolist(), diagonal[order].tolist()):
        if last is None or (d, t) != last[:2] or g - last[2] > band // 2:
            last = d, t, g
            yield d, t, g


def scan_licenses(docs: DataFrame, templates: DataFrame, k: int = 5, span: int = 8, band: int = 8,
                  least: float = 0.8) -> DataFrame:
    """One row per reported template and span: see ``FOUND``; spans are in code points, end exclusive."""
    named = templates.where("license IS NOT NULL AND text IS NOT NULL").select(
        F.col("license").cast("string"), F.col("text").cast("string"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"templates hold {size} bytes, more than {MAX_BYTES}")
    index = Index([tuple(r) for r in named.orderBy("license", "text").collect()], k, span, least)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        lengths = np.array([len(w) for w in index.words], np.int64)
        for batch in slices(batches):
            data, starts, ends, doc = _cut(batch.column("text"))
            words = hashes(data, starts, ends)
            first, last = np.searchsorted(doc, np.arange(batch.num_rows)), np.searchsorted(doc, np.arange(batch.num_rows), "right")
            hits = []
            for (size_k, size), known, place in index.classes:
                h = grams(words, size_k, size)
                at = winnow(h, doc, size_k, size - size_k + 1)
                low, high = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
                for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                    hits += [(t, doc[p], p - first[doc[p]] - q) for t, q in place[a:b].tolist()]
            out = []
            if hits:
                t, d, g = (np.array(x) for x in zip(*hits))
                offsets = texts_of(batch.column("text"))[1]
                for d, t, g in _candidates(t, d, g, band):
                    if _most(index.words[t], words[first[d]:last[d]], g, band) < least * lengths[t]:
                        continue
                    pairs = align(index.words[t], words[first[d]:last[d]], g, band)
                    if len(pairs) >= least * lengths[t] and index.naming.get(t, set()) <= {i for i, _ in pairs}:
                        a, b = starts[first[d] + pairs[0][1]], ends[first[d] + pairs[-1][1]]
                        text = data[offsets[d]:b]
                        chars = np.cumsum((text & 0xC0) != 0x80)
                        out.append((d, index.names[t], t, len(pairs), len(pairs) / lengths[t],
                                    int(chars[a - offsets[d] - 1]) if a > offsets[d] else 0, int(chars[b - offsets[d] - 1])))
            out = _fullest(list(dict.fromkeys(out)))  # two diagonals of one candidate
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            arrays[0] = batch.column("doc_id").take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FOUND)
