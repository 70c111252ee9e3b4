"""Benchmark decontamination by winnowing.

Words are lower-cased runs of ASCII letters and digits and of all characters above
ASCII. Every window of ``k + w - 1`` words has a least k-gram hash among its w
grams, so a shared span of that many words has a fingerprint in common on both
sides. Training and benchmark fingerprints are joined on the hash, then extended
word by word to both sides; a span of ``window`` equal words or more is a hit. An
item with fewer words is one window of its own length, with its own fingerprints.

The scan keeps only fingerprints found in a bitmap of the benchmark's hashes. The
bitmap never exceeds ``2 ** MAX_BITS`` bits, however large the benchmark is; false
matches in it are dropped by the join.

Null text has no words, no hits and is not contaminated; null item text has no
window. Items with equal ids count once per document. Rows with one doc_id twice
are documents of their own. Empty tables give no rows, or no hits. Columns other
than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pitwall.llm.common import slices, stored, texts_of
from pitwall.llm.words import LOWER, classes, grams, hashes, runs, winnow

MAX_BITS = 27
BROADCAST_BYTES = 16 << 20
WORD = classes((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))  # after lower-casing
_PRINT = "size:int,hash:bigint,at:bigint,grams:string,left:array<string>,right:array<string>"


def _cut(batch: pa.RecordBatch):
    data, offsets = texts_of(batch.column("text"))
    data = LOWER[data]
    starts, ends, doc = runs(WORD[data], offsets)
    return data, starts, ends, doc, hashes(data, starts, ends)


def _selected(words: np.ndarray, doc: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints for windows of ``size`` words."""
    k = min(k, size)
    h = grams(words, k, size)
    at = winnow(h, doc, k, size - k + 1)
    return at, h[at]


class _Prints:
    """Fingerprint rows of one slice: the gram's words and up to size - k words on either side."""

    def __init__(self, data, starts, ends, doc):
        self.text = data.tobytes()
        self.starts, self.ends, self.doc = starts.tolist(), ends.tolist(), doc
        self.first = np.searchsorted(doc, doc)
        self.last = np.searchsorted(doc, doc, "right")

    def row(self, size: int, k: int, at: int, h: int) -> dict:
        k = min(k, size)
        a, b = max(self.first[at], at + k - size), min(self.last[at], at + size)
        words = [self.text[s:e].decode() for s, e in zip(self.starts[a:b], self.ends[a:b])]
        mid = at - a
        return {"size": size, "hash": h, "at": int(at - self.first[at]), "grams": " ".join(words[mid:mid + k]),
                "left": words[:mid][::-1], "right": words[mid + k:]}


def _benchmark_prints(items: DataFrame, window: int, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            data, starts, ends, doc, words = _cut(batch)
            rows = _Prints(data, starts, ends, doc)
            ids, out = batch.column("item_id").to_pylist(), []
            counts = np.bincount(doc, minlength=batch.num_rows)[doc] if len(doc) else doc
            for size in np.unique(np.minimum(counts, window)).tolist():
                at, h = _selected(words, doc, size, k)
                ok = np.minimum(counts[at], window) == size
                out += [{"item_id": ids[doc[p]], **rows.row(size, k, p, x)}
                        for p, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist())]
            yield pa.RecordBatch.from_pylist(out, schema)

    names = [("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("grams", pa.string()),
             ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]
    schema = pa.schema([("item_id", pa.string()), *names])
    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        scan, "item_id string, " + _PRINT.replace(":", " ", 1).replace(",", ", "))


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """One bit per hash value modulo the number of bits, as 64-bit words."""
    place = F.pmod("hash", F.lit(bits))
    words = prints.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {bits}) % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _scan(sizes: list[int], k: int, bits: int, bitmap):
    """A column function: a text's number of words and its fingerprints that the bitmap has."""
    struct = pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("at", pa.int64()), ("grams", pa.string()),
                        ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
    result = pa.struct([("n_words", pa.int64()), ("prints", pa.list_(struct))])

    @F.arrow_udf(f"struct<n_words:bigint,prints:array<struct<{_PRINT}>>>")
    def scan(text: pa.Array) -> pa.Array:
        has, n_words, found = bitmap.value, [], []
        for batch in slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
            data, starts, ends, doc, words = _cut(batch)
            rows, mine = None, [[] for _ in range(batch.num_rows)]
            for size in sizes:
                at, h = _selected(words, doc, size, k)
                place = h % np.uint64(bits)  # bits is a power of two: the same value as pmod of the signed hash
                ok = (has[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                if ok.any():
                    rows = rows or _Prints(data, starts, ends, doc)
                    for p, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist()):
                        mine[doc[p]].append(rows.row(size, k, p, x))
            n_words.append(np.bincount(doc, minlength=batch.num_rows).astype(np.int64))
            found += mine
        n = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
        return pa.StructArray.from_arrays([n, pa.array(found, result[1].type)], fields=list(result))

    return scan


def _equal_words(a: str, b: str) -> Column:
    """How many words two lists have in common from their start on."""
    equal = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1)


class _Benchmark:
    """The benchmark's fingerprints, stored, and the scan that looks for them."""

    def __init__(self, items: DataFrame, window: int, k: int):
        prints = _benchmark_prints(items, window, k).groupBy("size", "hash", "grams", "left", "right").agg(
            F.collect_set("item_id").alias("items"))
        self.k, self.prints = k, stored(prints, "benchmark")
        n, self.bytes = self.prints.agg(F.count("hash"), F.sum(
            F.length("grams") + F.length(F.concat_ws("", "left", "right")) + 16 * F.size("items") + 64)).first()
        sizes = sorted(r[0] for r in self.prints.select("size").distinct().collect())  # at most ``window`` of them
        bits = 1 << min(MAX_BITS, max(12, (32 * n).bit_length()))
        bitmap = items.sparkSession.sparkContext.broadcast(_bitmap(self.prints, bits))
        self.scan = _scan(sizes, k, bits, bitmap)

    def hits(self, rows: DataFrame) -> DataFrame:
        """``row`` and its hit spans, items and number of hit words, from rows of (row, prints)."""
        some = rows.where(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.*")
        side = self.prints.select(
            "size", "hash", "grams", "items", F.col("left").alias("left_"), F.col("right").alias("right_"))
        if (self.bytes or 0) <= BROADCAST_BYTES:
            side = F.broadcast(side)
        both = some.join(side, ["size", "hash", "grams"]).select(
            "row", "size", "items", "at", _equal_words("left", "left_").alias("l"),
            _equal_words("right", "right_").alias("r"), F.least("size", F.lit(self.k)).alias("k"))
        hit = both.where(F.col("l") + F.col("k") + F.col("r") >= F.col("size")).select(
            "row", "items", F.struct((F.col("at") - F.col("l")).alias("start"),
                                     (F.col("at") + F.col("k") + F.col("r")).alias("end")).alias("span"))
        hit = hit.groupBy("row").agg(
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        zero = F.lit(0).cast("long")
        covered = F.aggregate(
            "spans", F.struct(zero.alias("n"), zero.alias("to")),
            lambda s, x: F.struct(
                (s["n"] + F.greatest(zero, x["end"] - F.greatest(x["start"], s["to"]))).alias("n"),
                F.greatest(s["to"], x["end"]).alias("to")))
        return hit.select("row", "spans", "items", covered["n"].alias("n_hit"))


def contamination_hits(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 7,
                       share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), spans of hit words, contaminated.

    A document is contaminated if it has a hit and its hit words are 1/share of its words or more.
    """
    benchmark = _Benchmark(items, window, k)
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
                       benchmark.scan(F.col("text").cast("string")).alias("scan"))
    rows = stored(rows, "scanned").select("doc_id", "row", "scan.*")
    out = rows.select("doc_id", "row", "n_words").join(benchmark.hits(rows), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def contaminated_out(docs: DataFrame, items: DataFrame, window: int = 13, k: int = 7, share: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Only rows with a fingerprint in the benchmark's bitmap meet a join.
    """
    benchmark = _Benchmark(items, window, k)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.monotonically_increasing_id().alias("row"),
                       benchmark.scan(F.col("text").cast("string")).alias("scan"))
    rows = stored(rows, "scanned").select("doc", "row", "scan.*")
    hits = benchmark.hits(rows.select("row", "prints"))
    bad = rows.where(F.size("prints") > 0).select("row", "n_words").join(hits, "row").where(
        share * F.col("n_hit") >= F.col("n_words")).select("row")
    clean = rows.where(F.size("prints") == 0).select("doc.*")
    return clean.unionByName(rows.where(F.size("prints") > 0).join(bad, "row", "left_anti").select("doc.*"))
