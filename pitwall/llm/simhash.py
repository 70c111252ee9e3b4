"""SimHash near-duplicates by a byte-position index with count filtering.

A fingerprint has eight bytes. If two differ in at most d bits, at least 8 - d of
their positional bytes are equal. Lists of single positional bytes hold 1/256 of
all rows, so the index stores their intersections: the positions form d + 2 blocks
and an entry holds two blocks' bytes. Two fingerprints within d bits agree on at
least two blocks and so meet in an entry. For each pair that meets, the shared
positional bytes are tallied, pairs below 8 - d are dropped, and the bits of the
rest are compared.

Entries with more than ``long_list`` fingerprints (large groups of near copies)
emit no pairs. Each of their fingerprints visits itself and its neighbours at one
bit outside the entry's bytes. Two fingerprints are within two bits exactly if they
visit a common value, and a value has at most 65 visitors, so tying visitors to the
least of them keeps every component. For d = 1 only values that are fingerprints
themselves tie. Larger d have no such exact way for long entries and are refused.

Exact copies share one fingerprint and one node. Null and empty text have
fingerprint zero, linked like any other. Rows with one doc_id twice are fingerprinted
each on its own. A null doc_id is never a component's id unless all its members'
are null. An empty table gives no rows. Columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_digest

from pitwall.llm.common import slices, stored
from pitwall.llm.components import components

SEED = 42
HOT = 1000


def _shingle_digests(text: str | None, size: int) -> list[bytes]:
    words = text.encode().lower().split() if text else []
    if len(words) <= size:
        return [xxh64_digest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-size]]]
    return [xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1:])]


def _majority(digests: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Fingerprint per document from its shingles' digests, zero without any."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64)
        first = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` of each row's whole text, with the longs in ``carried``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 20):
            each = [_shingle_digests(t, shingle) for t in batch.column("text").to_pylist()]
            counts = np.array([len(d) for d in each], np.int64)
            fp = _majority([x for d in each for x in d], counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp.view(np.int64)), *[batch.column(c) for c in carried]],
                names=["doc_id", "fp", *carried])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried)
    return rows.mapInArrow(scan, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def _blocks(max_bits: int) -> list[int]:
    """Bit mask of each of the max_bits + 2 blocks of whole bytes."""
    cuts = np.linspace(0, 8, max_bits + 3).astype(int)
    return [sum(0xFF << 8 * p for p in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _shared_bytes(a: str, b: str) -> Column:
    """Tally of the byte positions at which two fingerprints agree."""
    differ = F.col(a).bitwiseXOR(F.col(b))
    return sum((differ.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0).cast("int") for p in range(8))


def _pairs(entries: DataFrame, max_bits: int, long_list: int) -> DataFrame:
    lists = entries.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = lists.select(F.posexplode("fps").alias("i", "a"), "fps").select(
        "a", F.explode(F.expr(f"slice(fps, i + 2, {long_list})")).alias("b"))
    return pairs.where(_shared_bytes("a", "b") >= 8 - max_bits).where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def links(nodes: DataFrame, max_bits: int = 2, long_list: int = 64) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` reachable by links of max_bits or fewer."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keys = [m | n for m, n in combinations(_blocks(max_bits), 2)]
    entry = F.array(*[F.struct(F.lit(_signed(k)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("bytes"))
                      for k in keys])
    entries = nodes.select("fp", F.explode(entry).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("fp").alias("n")).where("n > 1")
    entries = stored(entries.join(sizes, "key"), "entries")
    short = _pairs(entries.where(F.col("n") <= long_list), max_bits, long_list)

    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    free = F.filter(flips, lambda x: x.bitwiseAND(F.col("key.mask")) == 0)
    visits = entries.where(F.col("n") > long_list).select(
        "fp", F.explode(F.transform(free, lambda x: F.col("fp").bitwiseXOR(x))).alias("value")).distinct()
    hubs = visits.groupBy("value").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    if max_bits == 1:  # a value ties its visitors only to itself
        hubs = hubs.where(F.array_contains("fps", F.col("value"))).withColumn("a", F.col("value"))
    else:
        hubs = hubs.withColumn("a", F.array_min("fps"))
    long = hubs.select("a", F.explode("fps").alias("b")).where("a != b")
    return short.unionByName(long).distinct()


def simhash_rows(docs: DataFrame, shingle: int = 3, max_bits: int = 2, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id, root (the component's least fingerprint) and the longs in ``carried`` of each row."""
    prints = stored(fingerprints(docs, shingle, carried), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes, max_bits))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id", "root")
    classes = stored(nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), "n"), "classes")
    # fingerprints with over 1/HOT of all rows are fewer than HOT, and their rows need no shuffle
    often = F.col("n") * HOT > prints.count()
    hot, others = (classes.where(c).select("fp", "component_id", "root") for c in (often, ~often))
    hot = F.broadcast(hot)
    rows = prints.join(hot, "fp").unionByName(prints.join(hot, "fp", "left_anti").join(others, "fp"))
    return rows.select("doc_id", "fp", "component_id", "root", *carried)


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach."""
    rows = simhash_rows(docs, shingle, max_bits)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
