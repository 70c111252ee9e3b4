"""Exact top-k inner products by block-at-a-time pruning.

Vectors of whole numbers are put in ranges of similar documents, in blocks. A block
stores its vectors (the forward index) and, for every term, the largest and least
value in it. For a query the sum over its terms of value times maximum (or minimum,
where the query's value is negative) bounds every score in the block.

Queries are taken in blocks, too. First each query block scores the few blocks with
the largest summed bounds, which gives every query a k-th score to beat. Then a
query block meets the blocks in which some query's bound reaches its k-th score,
largest bounds first; a query is scored in a block only if its bound still reaches
its own k-th score, which rises on the way. Bounds equal to it are scored, so ties
are settled by the smaller id.

No block is left out but by its bound, so the result is exact. Rows of one vec_id
count once, with the least of their vectors. Vectors that are null or hold a null
or non-finite component, and rows without an id, take no part. A vector shorter
than others ends in zeros. Scores are 64-bit; beyond that they are undefined. With
fewer than k candidates a query returns them all; empty tables give no rows. Columns
other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.llm.common import rows_per_group, stored

RESULT = "query_id long, vec_id long, score long"
_BLOCK = "block long, n int, ids binary, vectors binary, high binary, low binary"


def whole_vectors(table: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and floor(scale * x) of every component, one row per id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & usable)
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(scale * v)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _sketch(width: int):
    """Signs of a few fixed random projections; similar vectors share them."""
    @F.arrow_udf("long")
    def sketch(v: pa.Array) -> pa.Array:
        planes = np.random.default_rng(64).standard_normal((width, 10))
        signs = _matrix(v, width) @ planes > 0
        return pa.array(signs @ (1 << np.arange(10)), pa.int64())
    return sketch


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    n = len(lists)
    out = np.zeros((n, width), np.int64)
    lengths = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    rows = np.repeat(np.arange(n), lengths)
    first = np.cumsum(lengths) - lengths
    out[rows, np.arange(len(rows)) - first[rows]] = np.asarray(lists.flatten())
    return out


def _blocks(rows: DataFrame, width: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` neighbours in the order of sketch and id."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, rest = TaskContext.get().partitionId(), 0, []

        def block(table: pa.Table) -> pa.RecordBatch:
            m = _matrix(table.column("v").combine_chunks(), width)
            ids = np.asarray(table.column("vec_id"))
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + i, "n": len(ids), "ids": ids.astype("<i8").tobytes(),
                "vectors": m.astype("<i8").tobytes(), "high": m.max(axis=0).astype("<i8").tobytes(),
                "low": m.min(axis=0).astype("<i8").tobytes()}], schema)

        for batch in batches:
            rest.append(batch)
            while sum(b.num_rows for b in rest) >= size:
                table = pa.Table.from_batches(rest)
                yield block(table.slice(0, size))
                i, rest = i + 1, table.slice(size).to_batches()
        if sum(b.num_rows for b in rest):
            yield block(pa.Table.from_batches(rest))

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _BLOCK.split(", "))])
    order = rows.withColumn("s", _sketch(width)("v")).repartitionByRange("s", "vec_id")
    return order.sortWithinPartitions("s", "vec_id").select("vec_id", "v").mapInArrow(build, _BLOCK)


def _array(binary: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(binary, "<i8")
    return out if width is None else out.reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers; by floating point where no sum can reach 2 ** 53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2 ** 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries by blocks: the sum of the terms' largest products."""
    return _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        lowest = np.iinfo(np.int64).min
        self.kth = np.full(len(ids), lowest) if floor is None else floor.copy()
        self.q = self.id = self.score = np.empty(0, np.int64)

    def add(self, active: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, col = np.nonzero((scores >= self.kth[active][:, None]) & (ids[None, :] != self.ids[active][:, None]))
        q = np.concatenate([self.q, active[row]])
        id_ = np.concatenate([self.id, ids[col]])
        score = np.concatenate([self.score, scores[row, col]])
        order = np.lexsort((id_, -score, q))
        q, id_, score = q[order], id_[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[q[last]] = np.maximum(self.kth[q[last]], score[last])
        self.q, self.id, self.score = q[keep], id_[keep], score[keep]


def _scored(pairs: DataFrame, width: int, k: int) -> DataFrame:
    """Run query blocks over their blocks, largest summed bound first. ``pairs`` is dealt and sorted for that."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, queries = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("qb", "slot", "block", "ids", "vectors", "high", "low")}
                if (row["qb"], row["slot"]) != now:
                    if best is not None:
                        yield result(best)
                    now = row["qb"], row["slot"]
                    queries = _array(batch.column("q_vectors")[r].as_py(), width)
                    floor = batch.column("floor")[r].as_py()
                    best = _Best(_array(batch.column("q_ids")[r].as_py()), k, None if floor is None else _array(floor))
                bound = _bounds(queries, _array(row["high"], width), _array(row["low"], width))[:, 0]
                active = np.flatnonzero(bound >= best.kth)
                if len(active):
                    best.add(active, _array(row["ids"]), _product(queries[active], _array(row["vectors"], width)))
        if best is not None:
            yield result(best)

    def result(best: _Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(best.ids[best.q]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, RESULT)


def _pairs(queries: DataFrame, summaries: DataFrame, width: int) -> DataFrame:
    """(qb, block, total): blocks in which some query's bound reaches its floor, with the block's summed bound.

    A row of ``summaries`` holds the term maxima of a group of blocks; every query block
    is sent to every group by the group's number.
    """
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _array(r["q_vectors"], width)
                high = np.concatenate([_array(x["high"], width) for x in r["of"]])
                low = np.concatenate([_array(x["low"], width) for x in r["of"]])
                bounds = _bounds(q, high, low)
                floor = -np.inf if r["floor"] is None else _array(r["floor"])[:, None]
                some = np.flatnonzero((bounds >= floor).any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), r["qb"])), pa.array([r["of"][i]["block"] for i in some], pa.int64()),
                     pa.array(bounds.sum(axis=0, dtype=np.float64)[some])], names=["qb", "block", "total"])

    groups = summaries.count()
    sent = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1)))))
    return sent.join(summaries, "group").select("qb", "q_vectors", "floor", "of").mapInArrow(
        bound, "qb long, block long, total double")


def _dealt(pairs: DataFrame, blocks: DataFrame, queries: DataFrame, slot: Column) -> DataFrame:
    both = pairs.withColumn("slot", slot).join(blocks, "block").join(queries, "qb")
    return both.repartition("qb", "slot").sortWithinPartitions("qb", "slot", F.desc("total"), "block")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, block: int = 512, query_block: int = 1024,
          seeds: int = 8, group: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates but itself.

    Both tables hold vec_id and ``v``, an array of longs; see ``whole_vectors``.
    """
    candidates, queries = stored(candidates.select("vec_id", "v"), "candidates"), stored(queries.select("vec_id", "v"), "queries")
    width = max(1, *[df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (candidates, queries)])
    blocks = stored(_blocks(candidates, width, block), "blocks")
    asked = stored(_blocks(queries, width, query_block), "asked").select(
        F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    # blocks are numbered part by part; only the groups' two numbers, one row for ``group`` blocks, are put in one order
    place = F.shiftright("block", 32).alias("part"), F.floor(F.col("block").bitwiseAND((1 << 32) - 1) / group).alias("place")
    grouped = stored(blocks.groupBy(*place).agg(F.collect_list(F.struct("block", "high", "low")).alias("of")), "groups")
    numbered = grouped.select("part", "place", (F.row_number().over(W.orderBy("part", "place")) - 1).alias("group"))
    summaries = stored(grouped.join(numbered, ["part", "place"]).select("group", "of"), "summaries")

    open_ = asked.withColumn("floor", F.lit(None).cast("binary"))
    first = W.partitionBy("qb").orderBy(F.desc("total"), "block")
    seeded = _pairs(open_, summaries, width).withColumn("n", F.row_number().over(first)).where(F.col("n") <= seeds).drop("n")
    found = _scored(_dealt(seeded, blocks, open_, F.lit(0)), width, k)
    floors = stored(found.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("kth")), "floors")

    lowest = int(np.iinfo(np.int64).min)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                kth = {x["query_id"]: x["kth"] for x in r["of"] if x["kth"] is not None}
                floor = np.array([kth.get(i, lowest) for i in _array(r["q_ids"]).tolist()], "<i8")
                yield pa.RecordBatch.from_pylist(
                    [{"qb": r["qb"], "q_ids": r["q_ids"], "q_vectors": r["q_vectors"], "floor": floor.tobytes()}])

    # the queries of a block, at most ``query_block`` of them, with their k-th scores
    place = F.arrow_udf(lambda x: pa.array([_array(v.as_py()).tolist() for v in x], pa.list_(pa.int64())), "array<bigint>")
    members = asked.select("qb", F.explode(place("q_ids")).alias("query_id"))
    known = members.join(floors, "query_id").groupBy("qb").agg(F.collect_list(F.struct("query_id", "kth")).alias("of"))
    ready = asked.join(known, "qb", "left").withColumn("of", F.coalesce("of", F.array().cast("array<struct<query_id:bigint,kth:bigint>>")))
    ready = stored(ready.mapInArrow(pack, "qb long, q_ids binary, q_vectors binary, floor binary"), "ready")

    slots = rows_per_group(blocks.count(), group)
    pairs = _pairs(ready, summaries, width)
    best = _scored(_dealt(pairs, blocks, ready, F.pmod(F.xxhash64("block"), F.lit(slots))), width, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
