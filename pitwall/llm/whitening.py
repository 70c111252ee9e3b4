"""Whitening of embeddings from a covariance weighted by multiplicity.

Equal vectors of whole numbers are one row with a count. The covariance is a centred
product of matrices over these distinct rows, each weighted by its count (or by one:
``weights="distinct"``), added up over tasks; its eigenvectors, d by d numbers, are
found on the driver. Every distinct vector is whitened once and joined back to the rows
that have it. Vectors that a thousandth of all rows or more share, so a thousand at
most, meet their rows without a shuffle; no other key holds more than that share.

Sums are whole numbers: n, S and the deviations (the sum over dimensions of
(n * x - S) ** 2) are exact. Where a deviation passes 64 bits it is null; sums of x beyond
64 bits are an error. Vectors are centred as (n * x - S) / n before they are multiplied.

Rows whose vector is null or holds a null or non-finite component take no part; rows
with a null id do, and every repeated row has its own result. A vector shorter than
others counts as one that ends in zeros. Directions in which the vectors do not differ,
as far as double precision tells, have no whitened value and are left out; if no vector
differs from another, or the table is empty, there are no rows. The width is at most
``MAX_WIDTH``. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pitwall.llm.common import stored
from pitwall.llm.topk import _matrix

MAX_WIDTH = 4096
HOT_SHARE = 1000
_ROWS = 2048  # rows multiplied at a time


def whole_rows(table: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of every row that takes part, padded to the longest with c = 0."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(usable)
    rows = rows.select("vec_id", F.transform("c", lambda v: F.floor(scale * v) + F.lit(shift).cast("long")).alias("x"))
    rows = stored(rows, "rows")
    least, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if width and width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} components; at most {MAX_WIDTH} can be whitened")
    if least == width:
        return rows
    rest = F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.concat("x", rest))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """The distinct x with ``times``, the number of rows that have it, and a hash to sort by."""
    return rows.groupBy(F.xxhash64("x").alias("h"), "x").agg(F.count(F.lit(1)).alias("times"))


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with x as a matrix and the weights."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            yield piece, _matrix(piece.column("x"), width), np.asarray(piece.column("weight")).astype(np.int64)


def _sums(weighted: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of each dimension, exact."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, w in _pieces(batches, width):
            most = float(np.abs(x).max(initial=0)) * float(w.sum())
            total = (x * w[:, None]).sum(axis=0) if most < 2 ** 62 else [
                sum(int(a) * int(b) for a, b in zip(column, w)) for column in x.T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width), pa.int32()), pa.array([int(t) for t in total], pa.int64())], names=["i", "s"])

    n = weighted.agg(F.sum("weight")).first()[0]
    sums = weighted.select("x", "weight").mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    return n, sums.sort_values("i")["s"].to_numpy(np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S of each row, exact: in longs where these hold it, in Python's whole numbers otherwise."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) < 2 ** 62:
        return x * n - sums
    return x.astype(object) * n - sums.astype(object)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, null beyond 64 bits."""
    if float(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2 ** 62:
        return (centred * centred).sum(axis=1).tolist()
    exact = (centred.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _second_moments(rows: DataFrame, pieces, width: int) -> np.ndarray:
    """The sum of weight * row * row', rows as given by ``pieces``; one matrix a task, added up by its rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for m, w in pieces(batches):
            total += (m * w[:, None]).T @ m
            some = True
        if some:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "c"])

    parts = rows.mapInArrow(add, "i int, c array<double>")
    entries = parts.select("i", F.posexplode("c").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros((width, width))
    out[entries["i"].to_numpy(), entries["j"].to_numpy()] = entries["c"].to_numpy()
    return out


def whiten(rows: DataFrame, components: int = 32, weights: str = "rows") -> DataFrame:
    """vec_id, n, deviation, ``whitened`` and ``explained`` (arrays over the components) and identity_error.

    ``rows`` holds vec_id and x, an array of longs of one length; see ``whole_rows``.
    """
    rows = stored(rows.select("vec_id", "x"), "rows")
    weight = F.col("times") if weights == "rows" else F.lit(1).cast("long")
    distinct = stored(distinct_rows(rows).withColumn("weight", weight), "distinct")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    result = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if width == 0:
        return rows.sparkSession.createDataFrame([], result)
    n, sums = _sums(distinct, width)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, x, w in _pieces(batches, width):
            yield _centred(x, n, sums).astype(np.float64) / n, w

    covariance = _second_moments(distinct.select("x", "weight"), centred, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * width * 1e-14).sum())
    if k == 0:
        return rows.sparkSession.createDataFrame([], result)
    explained = (values[:k] / np.trace(covariance)).tolist()
    projection = vectors[:, :k] / np.sqrt(values[:k])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x, _ in _pieces(batches, width):
            c = _centred(x, n, sums)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), piece.column(2), piece.column(3), pa.array(_deviations(c), pa.int64()),
                 pa.array(list(c.astype(np.float64) / n @ projection), pa.list_(pa.float64()))],
                names=["h", "x", "times", "weight", "deviation", "whitened"])

    once = stored(distinct.select("h", "x", "times", "weight").mapInArrow(
        project, "h long, x array<bigint>, times long, weight long, deviation long, whitened array<double>"), "whitened")

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            m = np.asarray(batch.column("whitened").flatten()).reshape(-1, k)
            yield m, np.asarray(batch.column("weight")).astype(np.float64)

    mean = once.select(*[F.sum(F.col("whitened")[i] * F.col("weight")).alias(f"c{i}") for i in range(k)]).first()
    mean = np.array(mean, float) / n
    moments = _second_moments(once.select("whitened", "weight"), whitened, k) / n - np.outer(mean, mean)
    error = float(np.abs(moments - np.eye(k)).max())

    common = once.where(F.col("times") * HOT_SHARE >= n if weights == "rows" else F.col("times") * HOT_SHARE >= rows.count())
    shared = common.select("x", "deviation", "whitened").withColumn("common", F.lit(True))
    rest = once.join(F.broadcast(common.select("x")), "x", "left_anti")
    marked = rows.join(F.broadcast(shared), "x", "left")
    own = marked.where("common IS NULL").select("vec_id", F.xxhash64("x").alias("h"), "x").join(
        rest.select("h", "x", "deviation", "whitened"), ["h", "x"])
    both = own.select("vec_id", "deviation", "whitened").unionByName(
        marked.where("common").select("vec_id", "deviation", "whitened"))
    return both.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.array(*[F.lit(e) for e in explained]).alias("explained"), F.lit(error).alias("identity_error"))


def components_of(whitened: DataFrame) -> DataFrame:
    """One row for each component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return whitened.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"), "identity_error")
