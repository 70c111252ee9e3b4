"""Quality classifier by importance resampling over hashed n-grams.

N-grams are single words, pairs of words and the first four bytes of words. Two
generative models count, for every hashed n-gram, the documents that have it: the raw model over all documents, the target model over
those labelled good. A document's log weight is the sum, over its distinct n-grams,
of the log ratio of target to raw. Documents are drawn without replacement by
Gumbel top-k on log weight / temperature; k, unless it is given, is the number of documents whose weight
passes the cut that separates good from bad labelled rows best, where losing a share
of the good ones weighs ``loss`` times as much as keeping that share of the bad ones.

Details that matter:

* Every n-gram has a counter in two tables of its kind and the ratio nearer to
  one counts, so that a good word sharing one counter with a bad one takes no harm.
* The target's count enters as its upper confidence limit at ``z`` standard
  errors. What stays below one are n-grams that the target avoids beyond chance.
* Ratios above one are held at one: where most raw text is like the target they
  only measure length.
* Tables grow with the corpus as its vocabulary does: those of words have the power of
  two above ``load`` times the root of its bytes, 1 << ``LEAST_BITS`` at least, the others half of
  that. Counts and ratios are tables that Spark holds; a task holds ``PART`` counters of a
  table of words at a time, and larger tables are applied in as many passes.
* Words are lower-cased runs of letters and digits, punctuation runs are words,
  and a word met three times in a row makes the pair "repeat".

The labelled rows used are a bounded sample, ``max_labelled`` of them by the hash of
their ids; counts cover every document. Labels of one doc_id are merged to the worst
of them. Null, empty and wordless texts have weight one. Equal rows have equal keys;
documents tied at the k-th key are all drawn. Without good labelled rows, or without
bad ones, all documents are drawn. Rows with a null doc_id are never labelled. Empty
tables give no rows. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitwall.llm.common import slices, stored, texts_of
from pitwall.llm.words import LOWER, classes, hashes, mix, runs

LEAST_BITS = 17
PART = 1 << 22
CHUNK = 1 << 16          # counters that travel together
_KIND = classes((0x21, 0x7E)).astype(np.uint8) * 2
_KIND[classes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))] = 1
_REPEAT = np.uint64(0x5265706561740001)
_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89,
                                  0x452821E638D01377, 0xBE5466CF34E90C6C)]


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each document: document, kind (0 to 2) and hash."""
    data, offsets = texts_of(texts)
    data = LOWER[data]
    starts, ends, doc = runs(_KIND[data], offsets)
    words = hashes(data, starts, ends)
    joined = doc[1:] == doc[:-1]
    a, b, where = words[:-1][joined], words[1:][joined], doc[1:][joined]
    pairs = mix(a * np.uint64(3) + b)
    pairs[1:][(a[1:] == b[1:]) & (b[:-1] == a[1:]) & (a[:-1] == b[:-1]) & (where[1:] == where[:-1])] = _REPEAT
    first = hashes(data, starts, np.minimum(ends, starts + 4))
    out = []
    for order, (d, h) in enumerate(((doc, words), (where, pairs), (doc, first))):
        # the same document and hash twice: sort by a key of both, compare neighbours in full
        by = np.argsort(mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        d, h = d[by], h[by]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        out.append((d[new], np.full(int(new.sum()), order), h[new]))
    return tuple(np.concatenate(x) for x in zip(*out))


def table_size(docs: DataFrame, load: int) -> int:
    """Counters of a table of words."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return 1 << max(LEAST_BITS, int(np.ceil(np.log2(max(1, load * np.sqrt(total))))))


def _counters(order: np.ndarray, h: np.ndarray, size: int, part: int) -> list[np.ndarray]:
    """Each n-gram's two counters, numbered part by part; a part holds ``part`` of each table of words, 4 * part in all."""
    out = [np.empty(len(h), np.int64) for _ in range(2)]
    for o in range(3):
        mine = order == o
        width = part if o == 0 else part // 2
        first = 2 * part * (o > 0) + part * (o == 2)
        for k in range(2):
            mixed = mix(h[mine] ^ _SALTS[2 * o + k])
            if k == 0:
                outer = (mixed & np.uint64(size // part - 1)).astype(np.int64) * (4 * part)
            inner = mixed >> np.uint64(64 - (width.bit_length() - 1))
            out[k][mine] = outer + first + k * width + inner.astype(np.int64)
    return out


def _marked(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[DataFrame, DataFrame]:
    """Text with ``good`` (1, 0 or null) and the labelled sample itself."""
    merged = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        ((F.min(F.coalesce("quality", F.lit(1))) > 0) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).cast("int").alias("good"))
    sample = stored(merged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labelled")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.join(F.broadcast(sample), "doc_id", "left"), sample  # at most max_labelled rows of 12 bytes


def _counts(marked: DataFrame, size: int) -> DataFrame:
    """counter, raw and target: documents with the counter's n-grams, and those of them labelled good; -1 counts all documents."""
    hold, part = 1 << 21, min(size, PART)

    def merged(parts: list) -> list[tuple]:
        key, raw, target = (np.concatenate(x) for x in zip(*parts))
        keys, inverse = np.unique(key, return_inverse=True)
        return [(keys, np.bincount(inverse, raw).astype(np.int64), np.bincount(inverse, target).astype(np.int64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(parts)[0]], names=["counter", "raw", "target"])

        parts, held = [], 0
        for batch in slices(batches):
            good = np.asarray(batch.column("good").fill_null(0)) == 1
            doc, order, h = _ngrams(batch.column("text"))
            parts.append((np.array([-1]), np.array([batch.num_rows]), np.array([good.sum()])))
            for at in _counters(order, h, size, part):
                # one sort for both counts: the last bit says good
                keys, n = np.unique(2 * at + good[doc], return_counts=True)
                parts.append((keys >> 1, n, n * (keys & 1)))
                held += len(keys)
            if held > hold:
                parts = merged(parts)
                held = len(parts[0][0])
                if held > hold // 2:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    out = marked.select("text", "good").mapInArrow(count, "counter long, raw long, target long")
    return out.groupBy("counter").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio_table(docs: DataFrame, labels: DataFrame, size: int, max_labelled: int = 500_000, z: float = 3.5) -> DataFrame:
    """Log ratio of target to raw, at most zero: ``ratios`` holds, as floats, those of the counters from ``at`` on.

    Counters left out have ratio zero.
    """
    marked, _ = _marked(docs, labels, max_labelled)
    counts = stored(_counts(marked, size), "counts")
    n = counts.where("counter = -1").first()
    share = n["target"] / n["raw"] if n and n["target"] else None
    chunk = min(CHUNK, 4 * min(size, PART))
    raw, target = F.col("raw"), F.col("target")
    upper = target + z * z / 2 + z * F.sqrt(target + z * z / 4)
    ratio = F.lit(0.0) if share is None else F.least(F.lit(0.0), F.log(upper / (raw * share)))
    rows = counts.where("counter >= 0").select("counter", ratio.alias("ratio")).where("ratio < 0")

    def packed(rows: pa.Table) -> pa.Table:
        at = np.asarray(rows.column("counter"))
        first = int(at[0]) // chunk * chunk
        ratios = np.zeros(chunk, np.float32)
        ratios[at - first] = np.asarray(rows.column("ratio"))
        return pa.table({"at": pa.array([first]), "ratios": pa.array([ratios.tobytes()])})

    return stored(rows.groupBy(F.floor(F.col("counter") / chunk)).applyInArrow(packed, "at long, ratios binary"), "ratios")


def log_weights(docs: DataFrame, ratios: DataFrame, size: int, name: str) -> DataFrame:
    """Add the log weight of each row's whole text as column ``name``."""
    part = min(size, PART)
    width = 4 * part
    for first in range(0, size // part * width, width):
        table = np.zeros(width, np.float32)
        for row in ratios.where((F.col("at") >= first) & (F.col("at") < first + width)).collect():  # one part's counters
            ratio, at = np.frombuffer(row["ratios"], np.float32), row["at"] - first
            table[at:at + len(ratio)] = ratio
        shared = docs.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("double")
        def weight(text: pa.Array) -> pa.Array:
            known, out = shared.value, []
            whole = pa.RecordBatch.from_arrays([text], names=["text"])
            for batch in slices(iter([whole])):
                doc, order, h = _ngrams(batch.column("text"))
                a, b = (at - first for at in _counters(order, h, size, part))
                if part < size:  # both counters of an n-gram lie in one part
                    mine = (a >= 0) & (a < width)
                    doc, a, b = doc[mine], a[mine], b[mine]
                out.append(np.bincount(doc, np.maximum(known[a], known[b]), batch.num_rows))
            return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

        more = weight(F.col("text").cast("string"))
        docs = docs.withColumn(name, more if first == 0 else F.col(name) + more)
        if first + width < size // part * width:
            docs = stored(docs, "weighed")
    return docs


def _free_names(df: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        taken.add(n)
        out.append(n)
    return out


def _cut(weights: DataFrame, weight: str, sample: DataFrame, loss: float) -> float:
    """The weight above which labelled rows count as good.

    Best is the largest share of bad rows below it, less ``loss`` times the share of good rows below it.
    """
    step = 0.125
    bins = weights.join(F.broadcast(sample), "doc_id").groupBy(
        F.greatest(F.floor(F.col(weight) / step), F.lit(-8000)).alias("bin"), "good").count().toPandas()
    if bins["good"].nunique() < 2:
        return -np.inf
    table = bins.pivot_table("count", "bin", "good", "sum", fill_value=0).sort_index()
    below = table.cumsum() / table.sum()  # share of each class at or below a bin
    gain = (below[0] - loss * below[1]).to_numpy()
    if gain.max() <= 0:
        return -np.inf
    return float((table.index[int(np.argmax(gain))] + 1) * step)


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a double column, by counting in ever narrower bins."""
    low, high, parts = None, None, 4096
    while True:
        side = values if low is None else values.where((F.col(column) >= low) & (F.col(column) <= high))
        n, least, most = side.agg(F.count(column), F.min(column), F.max(column)).first()
        if n <= 10_000 or least == most:
            return most if least == most else side.select(column).toPandas()[column].nlargest(k).iloc[-1]
        width = (most - least) / parts
        bin_ = F.least(F.floor((F.col(column) - least) / width), F.lit(parts - 1))
        bins = side.groupBy(bin_.alias("bin")).agg(
            F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in bins.orderBy(F.desc("bin")).collect():
            if row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = 500_000, z: float = 3.5,
             temperature: float = 0.05, loss: float = 10.0, seed: int = 7, k: int | None = None,
             load: int = 4) -> tuple[DataFrame, str, str]:
    """The drawn rows of ``docs`` with their log weight and key, and the names of these two columns."""
    size = table_size(docs, load)
    ratios = ratio_table(docs, labels, size, max_labelled, z)
    weight, key = _free_names(docs, "log_weight", "gumbel_key")
    scored = log_weights(docs, ratios, size, weight)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = stored(scored.withColumn(key, F.col(weight) / temperature - F.log(-F.log(uniform))), "scored")
    if k is None:
        _, sample = _marked(docs, labels, max_labelled)
        cut = _cut(scored.select(F.col("doc_id").cast("long"), weight), weight, sample, loss)
        k = scored.where(F.col(weight) >= cut).count()
    k = min(k, scored.count())
    if k == 0:
        return scored.limit(0), weight, key
    return scored.where(F.col(key) >= kth_largest(scored.select(key), key, k)), weight, key
