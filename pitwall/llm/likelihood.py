"""Quality rules: repetition rules and a hashed n-gram log-likelihood ratio.

Terms are lower-cased runs of letters and digits, and runs of other visible characters;
n-grams are terms and pairs of terms. For each order two multinomials over the same
hashed counters are compared: the trusted target's counts, and the raw corpus's counts
scaled to the target's total, both with ``smoothing`` added to every counter. A
document's score of an order is the mean, over its n-grams, of the log of target to raw.
It is kept if no base rule fails and each score reaches that order's cut.

The target are documents labelled of good quality and not toxic; of the labelled rows a
bounded sample is used, ``max_labelled`` of them by the hash of their ids, labels of one
id merged to the worst. A fifth of it by another hash is held out of the target: on it,
and on the bad labelled documents, the cut of each order is the score with the largest
share of bad documents below it less ``loss`` times the share of good ones, taken at its
upper confidence limit, so that few labels make a careful cut: first that of pairs, then that of terms among the documents that pass. Documents that a base rule
fails take no part in that choice. Raw counts cover every document.

Each term has a counter in two tables, and the log ratio nearer to zero counts, so that a
good term that shares one counter with a bad one takes no harm; pairs have one. Tables
grow with the corpus as its vocabulary does: the power of two above ``load`` times the
root of its bytes. A task holds ``PART`` counters of each table at a time; a larger table
is applied in as many passes, each adding to the sums of the one before.

Base rules: under 50 words (runs of other than space and \\t to \\r), or more than half
of the words in three-word windows that the text has twice or more. Lines and windows of
a text are compared by 64-bit hashes.

Null and empty texts have no words and fail the first rule. Very long texts are taken
whole, one at a time. Equal texts have equal scores and a score equal to the cut passes,
so ties are kept together; repeated rows each have their own result. Without good
labelled rows, or without bad ones that pass the base rules, only the base rules decide.
Empty tables give no rows. Labels of a null id are not used; documents with one are
judged like any other. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitwall.llm.common import slices, stored, texts_of
from pitwall.llm.words import LOWER, classes, grams, hashes, mix, runs

PART = 1 << 24
TABLES = ((0, 1), (2,))  # numbers of the tables of terms and of pairs
CHUNK = 1 << 16          # counters that travel together
_SPACE = classes((0x09, 0x0D), (0x20, 0x20))
_WORD = (~_SPACE).astype(np.uint8)
_TERM = classes((0x21, 0x7E)).astype(np.uint8) * 2
_TERM[classes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))] = 1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SALTS = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STRUCT = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ",terms:bigint,pairs:bigint,term_sum:double,pair_sum:double>"


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For each key how often it occurs."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


def rule_counts(texts: pa.Array) -> list[np.ndarray]:
    """The counts named in FIELDS of each text."""
    data, offsets = texts_of(texts)
    n = len(offsets) - 1
    starts, ends, doc = runs(_WORD[data], offsets)
    seen = np.zeros(len(data) + 1, np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=seen[1:])
        return seen[offsets[1:]] - seen[offsets[:-1]]

    chars = per_text((data & 0xC0 != 0x80) & ~_SPACE[data])
    symbols = per_text(_SYMBOL[data])

    words = hashes(data, starts, ends)
    inside = doc[2:] == doc[:-2]
    window, at = grams(words, 3)[inside], np.flatnonzero(inside)
    twice = at[_repeats(mix(window + doc[at].astype(np.uint64) * _SALTS[0])) > 1]
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[twice + j] = True

    # lines: between line feeds and the ends of texts; a line with a word is known by the word starts in it
    line_starts = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    some = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[some], line_ends[some], line_doc[some]
    closed = data[line_ends - 1] == 10
    line = mix(hashes(data, line_starts, line_ends - closed) + line_doc.astype(np.uint64) * _SALTS[1])
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    return [np.bincount(doc, minlength=n), chars, symbols, np.bincount(line_doc[again], minlength=n),
            np.bincount(doc[covered], minlength=n)]


def ngrams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Document and hash of every term, and of every pair of terms."""
    data, offsets = texts_of(texts)
    data = LOWER[data]
    starts, ends, doc = runs(_TERM[data], offsets)
    terms = hashes(data, starts, ends)
    joined = doc[1:] == doc[:-1]
    return [(doc, terms), (doc[1:][joined], grams(terms, 2)[joined])]


def counters(table: int, h: np.ndarray, size: int, part: int) -> np.ndarray:
    """The counter of each n-gram; those in the tables of one order lie in the same part. Sizes are powers of two."""
    inner, first = np.uint64(part - 1), next(t[0] for t in TABLES if table in t)
    outer = mix(h ^ _SALTS[first]) & np.uint64(size - 1) & ~inner
    return (outer | mix(h ^ _SALTS[table]) & inner).astype(np.int64)


def table_size(docs: DataFrame, load: int) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return 1 << max(10, int(np.ceil(np.log2(max(1, load * np.sqrt(total))))))


def _labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """id, good and held (out of the target) of the labelled sample."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    good = (F.min(F.coalesce("quality", F.lit(1))) > 0) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    merged = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(good.alias("good"))
    sample = merged.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    return stored(sample.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(5)) == 0), "labelled")


def _counts(marked: DataFrame, size: int) -> DataFrame:
    """counter, raw and target: counters of all orders and tables numbered through. ``marked`` has text and target."""
    hold, part = 1 << 20, min(size, PART)

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, raw, target = (np.concatenate(x) for x in zip(*parts))
        keys, inverse = np.unique(key, return_inverse=True)
        return keys, np.bincount(inverse, raw).astype(np.int64), np.bincount(inverse, target).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)], names=["counter", "raw", "target"])

        parts, held = [], 0
        for batch in slices(batches):
            target = np.asarray(batch.column("target").fill_null(False))
            for order, (doc, h) in enumerate(ngrams(batch.column("text"))):
                distinct, inverse = np.unique(h, return_inverse=True)
                raw, mine = np.bincount(inverse), np.bincount(inverse, target[doc]).astype(np.int64)
                for table in TABLES[order]:
                    at = counters(table, distinct, size, part) + table * size
                    parts.append((at, raw, mine))
                    held += len(at)
            if held > hold:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > hold // 2:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    out = marked.select("text", "target").mapInArrow(count, "counter long, raw long, target long")
    return stored(out.groupBy("counter").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "counts")


def log_ratios(docs: DataFrame, sample: DataFrame, size: int, smoothing: float = 3.0) -> DataFrame:
    """Log of the smoothed target to the smoothed raw multinomial: table, at and ``ratios``, floats of the counters from ``at`` on.

    Chunks left out, and counters that nothing fell into, have ratio zero.
    """
    target = F.broadcast(sample.select("id", (F.col("good") & ~F.col("held")).alias("target")))  # max_labelled rows of 9 bytes
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(
        target, "id", "left")
    counts = _counts(marked, size)
    table = F.floor(F.col("counter") / size)
    totals = {r["t"]: (r["raw"], r["target"]) for r in counts.groupBy(table.alias("t")).agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()}  # one row a table
    share = F.lit(0.0)
    for t, (raw, good) in totals.items():
        share = F.when(table == t, good / raw).otherwise(share)
    expected = F.col("raw") * share
    ratio = F.when(share > 0, F.log((F.col("target") + smoothing) / (expected + smoothing))).otherwise(F.lit(0.0))
    chunk = min(size, CHUNK, PART)
    rows = counts.select(F.floor(F.col("counter") / chunk).alias("chunk"), F.pmod("counter", F.lit(chunk)).alias("i"), ratio.alias("ratio"))

    def packed(rows: pa.Table) -> pa.Table:
        ratios = np.zeros(chunk, np.float32)
        ratios[np.asarray(rows.column("i"))] = np.asarray(rows.column("ratio"))
        first = rows.column("chunk")[0].as_py() * chunk
        return pa.table({"table": pa.array([first // size], pa.int32()), "at": pa.array([first % size], pa.int64()),
                         "ratios": pa.array([ratios.tobytes()])})

    return stored(rows.groupBy("chunk").applyInArrow(packed, "table int, at long, ratios binary"), "ratios")


def _scored(docs: DataFrame, name: str, ratios: DataFrame, size: int) -> DataFrame:
    """``docs`` with the struct column ``name``: rule counts, numbers of n-grams and sums of their ratios."""
    part = min(size, PART)
    for first in range(0, size, part):
        tables = np.zeros((sum(map(len, TABLES)), part), np.float32)
        inside = ratios.where((F.col("at") >= first) & (F.col("at") < first + part))
        for row in inside.collect():  # at most PART counters of each table
            chunk = np.frombuffer(row["ratios"], np.float32)
            tables[row["table"], row["at"] - first:row["at"] - first + len(chunk)] = chunk
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        @F.arrow_udf(_STRUCT)
        def score(texts: pa.Array) -> pa.Array:
            known, out = shared.value, []
            for batch in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
                text, n = batch.column("text"), batch.num_rows
                columns = rule_counts(text) if first == 0 else [np.zeros(n, np.int64)] * len(FIELDS)
                sums = []
                for order, (doc, h) in enumerate(ngrams(text)):
                    best = None
                    for table in TABLES[order]:
                        at = counters(table, h, size, part) - first
                        mine = (at >= 0) & (at < part)
                        value = np.where(mine, known[table][np.where(mine, at, 0)], 0)
                        best = value if best is None else np.where(np.abs(value) < np.abs(best), value, best)
                    sums.append(np.bincount(doc, best, n))
                    if first == 0:
                        columns.append(np.bincount(doc, minlength=n))
                    else:
                        columns.append(np.zeros(n, np.int64))
                out.append(pa.StructArray.from_arrays(
                    [pa.array(c) for c in columns + sums], names=[*FIELDS, "terms", "pairs", "term_sum", "pair_sum"]))
            return pa.concat_arrays(out) if out else pa.array([], out_type)

        out_type = pa.struct([*((f, pa.int64()) for f in (*FIELDS, "terms", "pairs")), ("term_sum", pa.float64()), ("pair_sum", pa.float64())])
        new = score(F.col("text").cast("string"))
        if first == 0:
            docs = stored(docs.withColumn(name, new), "scored")
        else:
            more = F.struct(*[F.col(name)[f].alias(f) for f in (*FIELDS, "terms", "pairs")], *[
                (F.col(name)[f] + F.col("_more")[f]).alias(f) for f in ("term_sum", "pair_sum")])
            docs = stored(docs.withColumn("_more", new).withColumn(name, more).drop("_more"), "scored")
        shared.destroy()
    return docs


def lost_at_most(below: np.ndarray, n: int, z: float = 2.0) -> np.ndarray:
    """Upper confidence limit (Wilson) of the share of all good documents below a score that ``below`` of n have."""
    share = below / n
    return (share + z * z / (2 * n) + z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _cut(scores: DataFrame, score: str, loss: float, step: float = 1 / 512) -> float:
    """The least score that is kept. ``scores`` holds good and the score of labelled documents that pass the base rules."""
    bins = scores.groupBy(F.floor(F.col(score) / step).alias("bin"), "good").count().toPandas()  # log ratios: a few thousand bins
    if bins["good"].nunique() < 2:
        return -np.inf
    table = bins.pivot_table("count", "bin", "good", "sum", fill_value=0).sort_index()
    below, n = table.cumsum(), table.sum()
    gain = (below[False] / n[False] - loss * lost_at_most(below[True].to_numpy(), n[True])).to_numpy()
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return -np.inf
    bin_ = table.index.to_numpy()
    after = bin_[best + 1] if best + 1 < len(bin_) else bin_[best] + 1
    return float((bin_[best] + 1 + after) / 2 * step)  # midway to the next score that occurs


def judge(docs: DataFrame, labels: DataFrame, smoothing: float = 3.0, load: int = 16, loss: float = 5.0,
          max_labelled: int = 500_000) -> tuple[DataFrame, str]:
    """``docs`` with a struct column, whose name is returned, too.

    The struct holds FIELDS, term_score, pair_score (mean log ratios), base_failed and kept.
    """
    name = "rules"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    sample, size = _labelled(labels, max_labelled), table_size(docs, load)
    scored = _scored(docs, name, log_ratios(docs, sample, size, smoothing), size)
    at = {f: F.col(name)[f] for f in (*FIELDS, "terms", "pairs", "term_sum", "pair_sum")}
    scores = {"term_score": F.when(at["terms"] > 0, at["term_sum"] / at["terms"]).otherwise(F.lit(0.0)),
              "pair_score": F.when(at["pairs"] > 0, at["pair_sum"] / at["pairs"]).otherwise(F.lit(0.0))}
    failed = (at["n_words"] < 50) | (100 * at["n_repeat_words"] > 50 * at["n_words"])
    asked = sample.where("held OR NOT good").select("id", "good")
    seen = stored(scored.where(~failed).select(F.col("doc_id").cast("long").alias("id"), *[v.alias(k) for k, v in scores.items()]).join(
        F.broadcast(asked), "id"), "seen")  # max_labelled rows of 9 bytes
    passed = ~failed
    for k in ("pair_score", "term_score"):
        cut = _cut(seen, k, loss)
        if np.isfinite(cut):
            passed, seen = passed & (scores[k] >= cut), seen.where(F.col(k) >= cut)
    fields = [at[f].alias(f) for f in FIELDS] + [v.alias(k) for k, v in scores.items()]
    return scored.withColumn(name, F.struct(*fields, failed.alias("base_failed"), passed.alias("kept"))), name


def kept(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    judged, name = judge(docs, labels, **settings)
    return judged.where(F.col(name)["kept"]).drop(name)
