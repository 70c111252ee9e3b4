"""Helpers the operators share: storage in the shared folder and bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwall.plans.lake import shared_root

SLICE_BYTES = 1 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets into them; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches at whole rows so that a slice holds about ``max_bytes`` of text or one row."""
    for batch in batches:
        offsets = texts_of(batch.column(column))[1]
        at, n = 0, batch.num_rows
        while at < n:
            upto = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
            upto = min(n, max(at + 1, upto))
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs start .. start + length - 1."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """An int for each of n partitions that Spark's hash sends there: equal shares for n buckets."""
    keys = spark.range(50 * n + 100).select(F.col("id").cast("int").alias("k"))
    rows = keys.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    return [found.get(p, -1 - p) for p in range(n)]


def rows_per_group(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))


def same(a: str, b: str):
    """Join condition under which nulls meet."""
    return F.col(a).eqNullSafe(F.col(b))
