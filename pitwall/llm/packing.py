"""Best-fit packing of token sequences by hierarchical residual packing.

Documents longer than the capacity are cut into full pieces and a rest. Full
pieces are sequences of their own. The others are dealt into groups; each group
packs its pieces best-fit, largest first, emits the bins that are nearly full and
passes on the underfull ones as items. Groups then merge, ``fan_in`` at a time,
and pack again until one group is left.

Best fit leaves at most one bin of a group half empty or more; a bin passed on
can only meet such a bin. So a group passes on its emptiest bins, at most
``per_group / fan_in`` of them, and a merged group is never larger than
``per_group``. Bins beyond that are emitted as they are: every piece is placed
once, whatever is passed on.

Rows with one doc_id twice are documents of their own. Null text is an empty
document, which still has its end id. An empty table gives no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitwall.llm.common import ragged, rows_per_group, slices, stored
from pitwall.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = f"size long, members array<struct<{PIECES.replace(' long', ':long').replace(' int', ':int')}>>, offsets array<long>, sequence_id long, done boolean"


def token_pieces(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1,
                 capacity: int = 4096) -> DataFrame:
    """One row per piece of a document's ids, the end id included."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for batch in slices(batches):
            coded = enc.encode(["" if t is None else t for t in batch.column("text").to_pylist()])
            n = np.array([len(c) // width + 1 for c in coded], np.int64)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = ragged(np.zeros(len(n), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            ids = np.frombuffer(end.join(coded) + end, enc.dtype).astype("<u4").data.cast("B")
            at = 4 * ((np.cumsum(n) - n)[doc] + start)
            crc = [zlib.crc32(ids[a:a + k]) for a, k in zip(at.tolist(), (4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items taken as they come; each goes to the fullest bin that has room."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    some = 0  # bit r: a bin with free room r is open
    out = np.empty(len(sizes), np.int64)
    n = 0
    for i, size in enumerate(sizes.tolist()):
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            room, bin_, n = capacity, n, n + 1
        out[i] = bin_
        room -= size
        if room:
            rooms[room].append(bin_)
            some |= 1 << room
    return out


def _pack(capacity: int, slack: int, keep: int, level: int):
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        size = table.column("size").to_numpy()
        lists = table.column("members").combine_chunks()
        members, bounds = lists.values, np.asarray(lists.offsets).astype(np.int64)
        first = members.take(pa.array(bounds[:-1]))
        ids = first.field("doc_id")
        known = np.asarray(ids.fill_null(0))
        order = np.lexsort((np.asarray(first.field("start")), known, np.asarray(ids.is_null()), -size))
        bins = np.empty(len(size), np.int64)
        bins[order] = best_fit(size[order], capacity)
        by_bin = order[np.argsort(bins[order], kind="stable")]
        held = np.bincount(bins, size).astype(np.int64)
        counts = np.bincount(bins, np.diff(bounds)).astype(np.int64)
        flat = ragged(bounds[:-1][by_bin], np.diff(bounds)[by_bin])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        lists = pa.array(bounds, pa.int32())
        members = members.take(pa.array(flat))
        before = np.cumsum(length := np.asarray(members.field("length"))) - length
        before -= np.repeat(before[bounds[:-1]], counts)
        done = capacity - held <= slack
        open_ = np.flatnonzero(~done)
        if len(open_) > keep:
            done[open_[np.argsort(held[open_], kind="stable")[keep:]]] = True
        ids = (level << 57) + (group << 32) + np.arange(len(held))
        return pa.table({
            "size": pa.array(held),
            "members": pa.ListArray.from_arrays(lists, members),
            "offsets": pa.ListArray.from_arrays(lists, pa.array(before, pa.int64())),
            "sequence_id": pa.array(ids, pa.int64()), "done": pa.array(done)})
    return pack


def pack(pieces: DataFrame, capacity: int = 4096, per_group: int = 20_000, fan_in: int = 8,
         slack: int = 8) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``capacity``.

    Adds sequence_id and offset. ``slack``: a bin with no more free room than this is nearly full.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stored(pieces.select(*columns), "pieces")
    full = pieces.where(F.col("length") >= capacity).select(
        *columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    groups = rows_per_group(rest.count(), per_group)
    items = rest.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("g"), F.col("length").alias("size"),
        F.array(F.struct(*columns)).alias("members"))
    out, level = full, 1
    while True:
        keep = per_group // fan_in if groups > 1 else 0
        bins = stored(items.groupBy("g").applyInArrow(_pack(capacity, slack, keep, level), BINS), f"bins{level}")
        placed = bins.where("done").select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("m"))
        out = out.unionByName(placed.select("m.members.*", "sequence_id", F.col("m.offsets").alias("offset")))
        if groups == 1:
            return out
        g = F.shiftrightunsigned(F.col("sequence_id"), 32).bitwiseAND((1 << 25) - 1)
        items = bins.where("not done").select((g / fan_in).cast("long").alias("g"), "size", "members")
        groups, level = -(-groups // fan_in), level + 1


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 1,
                   capacity: int = 4096, **options) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and offset."""
    return pack(token_pieces(docs, vocabulary, kind, end_id, capacity), capacity, **options)
