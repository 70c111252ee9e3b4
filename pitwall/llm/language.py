"""Language identification of mixed text: script ranges, word scores and Viterbi spans.

Words are runs of letters and marks, lower-cased. The scripts of a word's letters
narrow its candidates to the languages that were seen in all of them. A word's score
for a language is the log likelihood of its hashed character trigrams and of the
whole word under counts from labelled documents. Viterbi over the words of a document,
with a penalty for every change of language, labels spans; the language that covers
most letters is the document's, and its share of the letters is the score.

Null text and text without a letter are ``und`` with score 0. A document none of
whose words has a candidate gets the language with the most training documents, as
do ties. Without any labelled text all documents are ``und``. Rows with one doc_id
twice are labelled each on its own; empty tables give no rows. Only doc_id, text
and, for learning, lang are read. The languages are collected: they are assumed to
be few (at most ``MAX_LANGUAGES``, else an error).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitwall.llm.common import slices, texts_of
from pitwall.llm.words import hashes, mix, runs

MAX_LANGUAGES = 1000
BITS = 16  # counters for trigrams, and as many for words
BUCKETS = 1 << BITS
# First and last code point of the scripts told apart. Others share one number.
SCRIPTS = {
    "Latin": [(0x41, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: its lower case if that is one code point, whether it is part of a word, its script's bit."""
    top = 0x110000
    lower, word, script = np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8), np.ones(top, np.uint32)
    for c in range(top):
        if unicodedata.category(s := chr(c))[0] in "LM":
            word[c] = 1
            if len(low := s.lower()) == 1:
                lower[c] = ord(low)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b + 1] = 2 << i
    return lower, word, script


def _features(texts: pa.Array):
    """Words of a batch: starts, ends, document, scripts; trigram counter of each letter; word counter."""
    lower, is_word, script = _tables()
    data, offsets = texts_of(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    if len(points) != len(data):
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    kind = is_word[points]
    starts, ends, doc = runs(kind, offsets)
    points = np.where(kind, lower[points], 0).astype(np.uint64)
    before, after = np.zeros_like(points), np.zeros_like(points)
    before[1:], after[:-1] = points[:-1], points[1:]
    before[starts], after[ends - 1] = 0, 0
    at = kind.astype(bool)
    tri = mix((before[at] << np.uint64(42)) | (points[at] << np.uint64(21)) | after[at]) >> np.uint64(64 - BITS)
    word = hashes(points, starts, ends) >> np.uint64(64 - BITS)
    marks = np.bitwise_or.reduceat(script[points], starts) if len(starts) else np.empty(0, np.uint32)
    return starts, ends, doc, marks, tri.astype(np.int64), word.astype(np.int64)


class Model:
    """Log likelihoods of the counters and the scripts of every language, most common language first."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, least_share: float):
        self.languages = languages
        total = counts.reshape(len(languages), 2, BUCKETS)
        n = total.sum(axis=2, keepdims=True)
        log = np.log((total + 0.5) / (n + 0.5 * BUCKETS)).astype(np.float32)
        self.tri, self.word = np.ascontiguousarray(log[:, 0].T), np.ascontiguousarray(log[:, 1].T)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.scripts = ((share >= least_share) & (scripts > 0)) @ (1 << np.arange(scripts.shape[1], dtype=np.int64))


def learn(docs: DataFrame, least_share: float = 1e-4) -> Model | None:
    """Count n-grams and scripts by language over rows of (text, lang); rows without either are skipped."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    languages = [r["lang"] for r in common]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return None
    width, n_scripts = 2 * BUCKETS, len(SCRIPTS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: i for i, name in enumerate(languages)}
        counts = {}
        for batch in slices(batches):
            langs = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            starts, ends, doc, marks, tri, word = _features(batch.column("text"))
            of = langs[doc]
            letter = np.repeat(of, ends - starts)
            for i in np.unique(of).tolist():
                mine = counts.setdefault(i, np.zeros(width + n_scripts, np.int64))
                mine[:BUCKETS] += np.bincount(tri[letter == i], minlength=BUCKETS)
                mine[BUCKETS:width] += np.bincount(word[of == i], minlength=BUCKETS)
                for s in range(n_scripts):
                    mine[width + s] += int((ends - starts)[(of == i) & (marks >> np.uint32(s) & np.uint32(1) == 1)].sum())
        for i, mine in counts.items():
            some = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i), pa.int32()), pa.array(some, pa.int32()),
                                              pa.array(mine[some])], names=["language", "counter", "n"])

    sums = rows.mapInArrow(count, "language int, counter int, n long").groupBy("language", "counter").agg(
        F.sum("n").alias("n")).toPandas()  # at most languages x counters
    counts = np.zeros((len(languages), width + n_scripts), np.int64)
    counts[sums["language"].to_numpy(), sums["counter"].to_numpy()] = sums["n"].to_numpy()
    return Model(languages, counts[:, :width], counts[:, width:], least_share)


def _word_scores(model: Model, texts: pa.Array):
    starts, ends, doc, marks, tri, word = _features(texts)
    if not len(starts):
        return starts, ends, doc, np.zeros((0, len(model.languages)), np.float32)
    first = np.cumsum(ends - starts) - (ends - starts)
    score = np.add.reduceat(model.tri[tri], first, axis=0) + model.word[word]
    out = (marks[:, None].astype(np.int64) & ~model.scripts[None, :]) != 0
    none = out.all(axis=1)
    score[out] = -1e6
    score[none] = 0
    return starts, ends, doc, score


def viterbi(score: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every word of many sequences at once; ``lengths`` words each, one after the other."""
    states = np.zeros(len(score), np.int16)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return states
    first, length = (np.cumsum(lengths) - lengths)[order], lengths[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than t
    best = score[first].astype(np.float64)
    came = [None] * steps  # for each step the state a change comes from, and which states were kept
    for t in range(1, steps):
        n = active[t]
        v = best[:n]
        top = v.argmax(axis=1)
        jump = v[np.arange(n), top] - penalty
        stay = v >= jump[:, None]
        came[t] = top.astype(np.int16), stay
        best[:n] = np.where(stay, v, jump[:, None]) + score[first[:n] + t]
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        states[first[:n] + t] = now[:n]
        if t:
            top, stay = came[t]
            now[:n] = np.where(stay[np.arange(n), now[:n]], now[:n], top)
    return states


def label(docs: DataFrame, model: Model | None, penalty: float = 10.0) -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end in code points, lang) of every row."""
    kind = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    if model is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.array().cast("array<struct<start:int,end:int,lang:string>>").alias("spans"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x counters floats

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array([*model.languages, "und"])
        for batch in slices(batches, max_bytes=8 << 20):
            parts, rows = [], 0
            for piece in slices(iter([batch]), max_bytes=1 << 20):
                s, e, d, x = _word_scores(model, piece.column("text"))
                parts.append((s, e, d + rows, x))
                rows += piece.num_rows
            starts, ends, doc, score = (np.concatenate(x) for x in zip(*parts))
            states = viterbi(score, np.bincount(doc, minlength=rows), penalty)
            yield _result(batch, parts, starts, ends, doc, states, names, rows)

    def _result(batch, parts, starts, ends, doc, states, names, rows) -> pa.RecordBatch:
        n = len(names) - 1
        letters = np.bincount(doc * n + states, ends - starts, rows * n).reshape(rows, n)
        total = letters.sum(axis=1)
        pred = np.where(total > 0, letters.argmax(axis=1), n)
        share = letters.max(axis=1) / np.maximum(1, total)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (states[1:] != states[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1 if len(at) else at
        base = np.concatenate([_bases(p) for p in _pieces(batch)])
        spans = pa.StructArray.from_arrays(
            [pa.array(starts[at] - base[doc[at]], pa.int32()), pa.array(ends[last] - base[doc[at]], pa.int32()),
             names.take(pa.array(states[at]))], names=["start", "end", "lang"])
        counts = np.bincount(doc[at], minlength=rows)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), spans)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), names.take(pa.array(pred)), pa.array(share), lists],
            names=["doc_id", "lang_pred", "score", "spans"])

    def _pieces(batch):
        return slices(iter([batch]), max_bytes=1 << 20)

    def _bases(piece) -> np.ndarray:
        data, offsets = texts_of(piece.column("text"))
        return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets[:-1]]

    rows = docs.select(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).cast("string").alias("text"))
    return rows.mapInArrow(scan, kind)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0; rows without an id are neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, folds: int = 5, penalty: float = 10.0) -> DataFrame:
    """Learn from the rows that are not held out and label all: doc_id, held_out, lang_pred, score, spans."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)))
    return label(docs, model, penalty).select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score", "spans")
