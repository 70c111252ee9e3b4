"""Removal of byte strings that repeat across documents, by bounded Burrows-Wheeler transforms.

A byte goes if it lies in a ``length``-byte string that also starts in a document with
a smaller doc_id. Strings are judged on the input; matches never cross documents.

1. Every ``length``-byte window has an anchor: the least hash of the 16-byte grams in
   it. Equal windows have equal anchors, so windows are dealt by the anchor's hash.
   Neighbouring windows with one anchor form a context, whose hash and the hashes of
   its sides go along; a slice's equal contexts are reduced to their least document
   before they are dealt.
2. Where an anchor's contexts are met, equal contexts are settled: all but the least
   document lose them whole. Contexts that differ but share a side are asked for at
   their places in their least documents.
3. Their bytes are cut out of the texts and dealt by anchor again.
   A Burrows-Wheeler transform of each part is expanded up to ``length``, see ``bwt``;
   places with a common prefix of that length share their least document.
4. The covered ranges of a document are joined to its text and cut out.

An anchor that one document in ``COMMON`` has would bring a share of the corpus to one
task. Such anchors are found in a sample and dealt by their contexts, so that equal
ones still meet. They, and anchors with more than ``long_group`` different contexts,
are not put in one transform: the windows of its contexts are grouped by their bytes, which Spark
reduces before the shuffle. Transforms are built for whole anchors, about
``part_bytes`` at a time.

Rows with a null doc_id are left whole and are no reason to cut others. Rows of one
doc_id never cut each other; each is cut on its own. Null and empty texts have no
bytes. Repeated rows are cut alike. An empty table gives no rows. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from pitwall.llm.bwt import STOP, repeats
from pitwall.llm.common import partition_keys, ragged, rows_per_group, slices, stored, texts_of
from pitwall.llm.words import _BASE, _INVERSE, _VALUE, _power, mix

GRAM = 16
SAMPLE = 64
COMMON = 200
PIECE = 1 << 19
_LOW = np.uint64((1 << 22) - 1)  # bits of a position in a piece
RANGES = "doc_id long, tag long, start int, end int"
_DEALT = [("doc", "<u4"), ("start", "<u4"), ("n", "u1"), ("hash", "<u4"), ("left", "u1"), ("right", "u1"),
          ("low", "<u4"), ("high", "<u2"), ("common", "u1")]


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Contexts of a batch: document, start, windows, anchor hash, hashes of the whole, left and right.

    Over ``PIECE`` bytes are cut into pieces that overlap by length - 1 bytes, so every window is in one of them.
    """
    if len(data) <= PIECE:
        return _contexts(data, offsets, length)
    parts = []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b - length + 1, PIECE - length + 1):
            piece = data[at:min(b, at + PIECE)]
            doc, start, *others = _contexts(piece, np.array([0, len(piece)]), length)
            parts.append((doc + row, start + at - a, *others))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _contexts(data: np.ndarray, offsets: np.ndarray, length: int):
    n = len(data)
    grams, m = _VALUE[data], 1
    while m < GRAM:
        grams = grams[:-m] * np.uint64(pow(0xD6E8FEB86659FD93, m, 1 << 64)) + grams[m:]
        m *= 2
    grams = mix(grams)
    width = length - GRAM + 1  # grams in a window
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    s = 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if width > s:
        least = np.minimum(least[:s - width], least[width - s:])
    lengths = np.diff(offsets)
    starts = ragged(offsets[:-1], np.maximum(0, lengths - length + 1))
    doc = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - length + 1))
    anchor = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    p, a, b, doc = anchor[first], starts[first], starts[last] + length, doc[first]

    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, n), out=total[1:])
    back = _power(_INVERSE, n + 1)

    def of(i, j):
        return mix((total[j] - total[i]) * back[i])

    side = (length - GRAM) // 2
    whole = mix(of(a, b) + ((p - a) * 1009 + (b - a)).astype(np.uint64))
    left = np.where(p - side >= a, of(np.maximum(p - side, 0), p), 0)
    right = np.where(p + GRAM + side <= b, of(p, np.minimum(p + GRAM + side, n)), 0)
    return doc, a - offsets[doc], b - a - length + 1, grams[p], whole, left, right


def _side(h: np.ndarray) -> np.ndarray:
    """A byte of a side's hash; 0 is for a context that ends before the side does."""
    return np.where(h == 0, 0, h % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def _pack(ids: np.ndarray, tags: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    """Columns of one bucket with the documents they refer to, compressed."""
    docs, columns["doc"] = np.unique(columns["doc"], return_inverse=True)
    columns["doc"] = np.diff(columns["doc"], prepend=0)
    parts = [np.array([len(docs), len(columns["doc"])], "<i8"), np.diff(ids[docs], prepend=0).astype("<i8"),
             tags[docs].astype("<i8"), *[columns[name].astype(t) for name, t in _DEALT]]
    return zstandard.ZstdCompressor(1).compress(b"".join(x.tobytes() for x in parts))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n_docs, n = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16
    ids = np.cumsum(np.frombuffer(raw, "<i8", n_docs, at))
    tags = np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    columns = {}
    for name, t in _DEALT:
        columns[name] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    doc = np.cumsum(columns["doc"].view("<i4").astype(np.int64))
    return ids[doc], tags[doc], columns


def _common(docs: DataFrame, length: int, least: int) -> np.ndarray:
    """Anchors met in over 1/COMMON of a sample of the documents, and in ``least`` of them at least.

    Which anchors are named only decides how they are dealt, so the sample changes no result.
    Documents have anchors in proportion to their bytes, so there are at most COMMON times
    as many as in a mean document.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=PIECE):
            data, offsets = texts_of(batch.column("text"))
            if len(data) >= length:
                doc, _, _, anchor, *_ = _anchors(data, offsets, length)
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                found, n = np.unique(anchor[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(scan, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    many = counts.where(F.col("n") * COMMON > some.count()).select("anchor").toPandas()
    return np.sort(many["anchor"].to_numpy(np.int64).view(np.uint64))


def _deal(docs: DataFrame, length: int, buckets: int, common: np.ndarray) -> DataFrame:
    """Contexts by bucket of their anchor, a bucket to each partition. Equal contexts of a slice are there once, but for rows of one document.

    Contexts settled within a slice come along with hash, left and right of zero and an own bucket.
    """
    keys = partition_keys(docs.sparkSession, buckets)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=8 << 20):
            ids, tags = np.asarray(batch.column("doc_id")), np.asarray(batch.column("tag"))
            parts, rows = [], 0
            for piece in slices(iter([batch]), max_bytes=PIECE):
                data, offsets = texts_of(piece.column("text"))
                if len(data) >= length:
                    got = _anchors(data, offsets, length)
                    parts.append((got[0] + rows, *got[1:]))
                rows += piece.num_rows
            if not parts:
                continue
            doc, start, n, anchor, whole, left, right = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids[doc], whole))
            w, d = whole[order], ids[doc[order]]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = np.zeros(len(w), bool)
            settled[order] = d != least
            bucket = (anchor >> np.uint64(32)) % np.uint64(buckets)
            frequent = np.isin(anchor, common)
            apart = settled | frequent  # common anchors are dealt by their contexts
            bucket[apart] = whole[apart] % np.uint64(buckets)
            hash_ = np.where(settled, 0, (anchor & np.uint64(0xFFFFFFFF)) | np.uint64(1))
            columns = {"doc": doc, "start": start, "n": n, "hash": hash_, "left": _side(left), "right": _side(right),
                       "low": whole & np.uint64(0xFFFFFFFF), "high": whole >> np.uint64(48), "common": frequent}
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
            out = [(keys[i], _pack(ids, tags, {c: v[by[a:b]] for c, v in columns.items()}))
                   for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())],
                names=["bucket", "packed"])

    return docs.mapInArrow(scan, "bucket int, packed binary").repartition(buckets, "bucket")


def _shared(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Whether a row's keys are met in more than one document."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.lexsort((doc, *keys))
    new = np.ones(len(doc), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    out = np.empty(len(doc), bool)
    out[order] = (doc[order][first] != doc[order][last])[np.cumsum(new) - 1]
    return out


def _meet(dealt: DataFrame, length: int, long_group: int) -> DataFrame:
    """Settled ranges (kind 0) and contexts to be asked for (kind 1, or 2 for long groups)."""
    def one(parts: list[bytes], bucket: int) -> pa.RecordBatch:
        each = [_unpack(p) for p in parts]
        ids, tags = np.concatenate([e[0] for e in each]), np.concatenate([e[1] for e in each])
        c = {name: np.concatenate([e[2][name] for e in each]) for name, _ in _DEALT}
        kind = np.full(len(ids), -1, np.int8)
        kind[c["hash"] == 0] = 0
        live = np.flatnonzero(c["hash"] != 0)
        live = live[_shared([c["hash"][live]], ids[live]) | (c["common"][live] > 0)]
        h, doc = c["hash"][live], ids[live]
        whole = c["low"][live].astype(np.int64) << 16 | c["high"][live]
        order = np.lexsort((doc, whole, h))
        live, h, doc, whole = live[order], h[order], doc[order], whole[order]
        new = np.ones(len(live), bool)
        new[1:] = (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
        kind[live[doc != least]] = 0
        # of each context that shares a side with a context of another document, all places in its least document
        side = np.zeros(len(live), bool)
        for name in ("left", "right"):
            has = c[name][live] > 0
            side[has] |= _shared([h[has], c[name][live][has]], doc[has])
        groups, size = np.unique(h[new & side], return_counts=True)
        rep = np.flatnonzero(side & (doc == least))
        n = size[np.searchsorted(groups, h[rep])] if len(rep) else rep
        kind[live[rep]] = np.where(n > long_group, 2, np.where(n > 1, 1, -1))
        kind[live[(c["common"][live] > 0) & (doc == least)]] = 2  # others may be in other buckets
        some = np.flatnonzero(kind >= 0)
        key = (np.int64(bucket) << 32) | c["hash"][some].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(tags[some]), pa.array(c["start"][some].astype(np.int32)),
             pa.array((c["start"][some] + c["n"][some] + np.uint32(length - 1)).astype(np.int32)),
             pa.array(kind[some], pa.int8()), pa.array(key)], names=["doc_id", "tag", "start", "end", "kind", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                parts.setdefault(b, []).append(p)
        while parts:
            bucket, packed = parts.popitem()
            yield one(packed, bucket)

    return dealt.mapInArrow(run, RANGES + ", kind byte, key long")


def _cut_out(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of every context that is asked for."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=1 << 19):
            data, offsets = texts_of(batch.column("text"))
            lists = batch.column("asked")
            flat, n = lists.flatten(), np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(batch.num_rows), n)
            start, end = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("end")).astype(np.int64)
            bytes_ = data[ragged(offsets[row] + start, end - start)].tobytes()
            bounds = pa.array(np.concatenate([[0], np.cumsum(end - start)]), pa.int32())
            context = pa.Array.from_buffers(pa.binary(), len(row), [None, bounds.buffers()[1], pa.py_buffer(bytes_)])
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(index), batch.column("tag").take(index), flat.field("start"),
                 flat.field("kind"), flat.field("key"), context],
                names=["doc_id", "tag", "start", "kind", "key", "context"])

    lists = asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end", "kind", "key")).alias("asked"))
    return docs.join(lists, ["doc_id", "tag"]).mapInArrow(
        cut, "doc_id long, tag long, start int, kind byte, key long, context binary")


def _expanded(contexts: DataFrame, length: int, part_bytes: int) -> DataFrame:
    """Ranges of contexts that a smaller document has, too, by one transform for some whole anchors at a time."""
    def ranges(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        context = table.column("context").combine_chunks()
        data, offsets = _bytes(context)
        n, ids = np.diff(offsets), np.asarray(table.column("doc_id"))
        text = np.full(len(data) + len(n), STOP, np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        text[np.arange(len(data)) + row] = data
        base = offsets[:-1] + np.arange(len(n))
        order, same = repeats(text, length)
        row = np.append(np.repeat(np.arange(len(n)), n + 1), 0)[order]
        at = order - base[row]
        whole = at + length <= n[row]  # windows inside their context
        group = np.cumsum(~same)[whole]
        row, at = row[whole], at[whole]
        doc = ids[row]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(doc) else doc
        hit = doc > least
        row, at = row[hit], at[hit]
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        start = np.asarray(table.column("start")).astype(np.int64)[row[first]]
        index = pa.array(row[first])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[row[first]]), table.column("tag").combine_chunks().take(index),
             pa.array((start + at[first]).astype(np.int32)), pa.array((start + at[last] + length).astype(np.int32))],
            names=["doc_id", "tag", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            at = 0
            while at < len(keys):
                # rows up to the first change of anchor after the part is full
                if size >= part_bytes and keys[at] != last:
                    yield ranges(held)
                    held, size = [], 0
                upto = min(len(keys), at + 1024)
                if size >= part_bytes:
                    upto = at + int(np.searchsorted(keys[at:upto], last, "right"))
                piece = batch.slice(at, upto - at)
                held.append(piece)
                size, last, at = size + piece.column("context").nbytes, keys[upto - 1], upto
        if held:
            yield ranges(held)

    order = contexts.repartition("key").sortWithinPartitions("key")
    return order.select("doc_id", "tag", "start", "key", "context").mapInArrow(run, RANGES)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[offsets[0]:offsets[-1]], offsets - offsets[0]


def _by_window(contexts: DataFrame, length: int) -> DataFrame:
    """The same for long groups: windows grouped by their bytes."""
    at = F.explode(F.sequence(F.lit(1), F.length("context") - length + 1))
    windows = contexts.select("doc_id", "tag", "start", "context", at.alias("at")).select(
        "doc_id", "tag", (F.col("start") + F.col("at") - 1).alias("start"),
        F.substring("context", F.col("at"), F.lit(length)).alias("window"))
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    return windows.join(least, "window").where("doc_id > least").select(
        "doc_id", "tag", F.col("start").cast("int"), (F.col("start") + length).cast("int").alias("end"))


def _kept(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = texts_of(batch.column("text"))
            lists = batch.column("ranges").fill_null([])
            flat, n = lists.flatten(), np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(batch.num_rows), n)
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, offsets[row] + np.asarray(flat.field("start")).astype(np.int64), 1)
            np.add.at(depth, offsets[row] + np.asarray(flat.field("end")).astype(np.int64), -1)
            gone = np.cumsum(depth)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            begins[inner] = gone[inner]  # a run ends with its document
            begun = np.concatenate([[0], np.cumsum(begins)])
            kept = data[~gone].tobytes()
            cuts = (offsets - total[offsets]).tolist()
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])),
                 pa.array(np.diff(begun[offsets])), pa.array(sha),
                 pa.array([kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    lists = ranges.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    return docs.join(lists, ["doc_id", "tag"], "left").select("doc_id", "text", "ranges").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = 50, bucket_bytes: int = 8 << 20, long_group: int = 2000,
                   part_bytes: int = 1 << 20, common_least: int = 4) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and the kept bytes of every row."""
    if not GRAM <= length <= 250:
        raise ValueError(f"length is {GRAM} to 250")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    total, repeated = ids.agg(F.sum("bytes"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))).first()
    # rows of one doc_id are told apart by their texts' hash
    docs = docs.withColumn("tag", F.xxhash64("text") if (repeated or 0) > 1 else F.lit(0).cast("long"))
    named = docs.where("doc_id IS NOT NULL")
    buckets = rows_per_group(total or 0, bucket_bytes)
    common = _common(named, length, common_least)
    met = stored(_meet(_deal(named, length, buckets, common), length, long_group), "contexts")
    contexts = stored(_cut_out(named.dropDuplicates(["doc_id", "tag"]) if (repeated or 0) > 1 else named,
                               met.where("kind > 0")), "asked")
    ranges = met.where("kind = 0").select("doc_id", "tag", "start", "end").unionByName(
        _expanded(contexts.where("kind = 1"), length, part_bytes)).unionByName(
        _by_window(contexts.where("kind = 2"), length))
    return _kept(docs, stored(ranges, "ranges"))
