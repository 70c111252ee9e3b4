"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A shard holds one range of the ascending doc_id order, in three little-endian files:

    <shard>.bin   token ids, 2 bytes wide if the vocabulary fits, else 4
    <shard>.idx   n + 1 uint64: where each document starts in the whole corpus, and the shard's end
    <shard>.doc   n int64 document ids

The table ``manifest`` names the shards in order with their documents, tokens and
bases. A base is the prefix sum of the tokens of all shards before. Documents with
a null doc_id come first; the manifest says how many a shard has.

Rows with one doc_id twice are documents of their own, next to each other. Null
text is an empty document and consists of the end id alone. An empty table gives
no shard. Columns other than doc_id and text are not read. A task writes under a
name of its own and only a finished task's name reaches the manifest, so lost or
repeated tasks do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pitwall.llm.common import shared_path, slices
from pitwall.llm.tokens import encoder

MANIFEST = "shard int, name string, n_docs long, n_null long, n_tokens long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def write_tokens(docs: DataFrame, root: str, vocabulary: str, kind: str = "byte", end_id: int = 2) -> DataFrame:
    """Encode every document into shard files under ``root`` and return the manifest with bases.

    ``root`` is a folder that driver and executors share, as a URI or absolute path.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        end = np.array([end_id], enc.dtype).tobytes()
        fs, base = _open(root)
        fs.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"{shard:07d}-{uuid.uuid4().hex}"
        n, nulls, total = 0, 0, 0
        with fs.open_output_stream(f"{base}/{name}.bin") as ids, \
                fs.open_output_stream(f"{base}/{name}.len") as lens, \
                fs.open_output_stream(f"{base}/{name}.doc") as names:
            for batch in slices(batches):
                column = batch.column("doc_id")
                coded = enc.encode(["" if t is None else t for t in batch.column("text").to_pylist()])
                lengths = np.array([len(c) // enc.dtype.itemsize + 1 for c in coded], "<u8")
                ids.write(end.join(coded) + end)
                lens.write(lengths.tobytes())
                names.write(np.asarray(column.fill_null(0), "<i8").tobytes())
                n, nulls, total = n + len(coded), nulls + column.null_count, total + int(lengths.sum())
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), *[pa.array([v], pa.int64()) for v in (n, nulls, total)]],
                names=["shard", "name", "n_docs", "n_null", "n_tokens"])

    order = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = order.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    order = order.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    path = f"{root}/manifest"
    order.mapInArrow(write, MANIFEST).write.parquet(path)
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    return spark.read.schema(MANIFEST).parquet(path).withColumn(
        "base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _range(fs: pafs.FileSystem, path: str, dtype, start: int, count: int) -> np.ndarray:
    if count == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", start * np.dtype(dtype).itemsize, (count,))
    with fs.open_input_file(path) as f:
        size = np.dtype(dtype).itemsize
        return np.frombuffer(f.read_at(count * size, start * size), dtype)


def read_tokens(manifest: DataFrame, root: str, dtype: str, block: int = 1 << 20) -> DataFrame:
    """Write each shard's 64-bit offsets from its base, then read the shard back by memory map.

    One row per document: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base_dir = _open(root)
        for batch in batches:
            for shard in batch.to_pylist():
                path, n = f"{base_dir}/{shard['name']}", shard["n_docs"]
                offsets = np.zeros(n + 1, "<u8")
                np.cumsum(_range(fs, f"{path}.len", "<u8", 0, n), out=offsets[1:])
                offsets += np.uint64(shard["base"])
                part = f"{path}.idx-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(offsets.tobytes())
                fs.move(part, f"{path}.idx")
                yield from _documents(fs, path, shard, dtype, block)

    rows = manifest.select("name", "n_docs", "n_null", "base")
    shards = max(1, manifest.count())
    return rows.repartition(shards).mapInArrow(read, TOKENS)


def _documents(fs, path: str, shard: dict, dtype: str, block: int) -> Iterator[pa.RecordBatch]:
    n, base = shard["n_docs"], shard["base"]
    offsets = np.asarray(_range(fs, f"{path}.idx", "<u8", 0, n + 1)).astype(np.int64)
    names = np.asarray(_range(fs, f"{path}.doc", "<i8", 0, n))
    at = 0
    while at < n:
        upto = max(at + 1, min(n, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1))
        ids = _range(fs, f"{path}.bin", dtype, int(offsets[at] - base), int(offsets[upto] - offsets[at]))
        ids = np.asarray(ids).astype("<u4").data.cast("B")
        cuts = 4 * (offsets[at:upto + 1] - offsets[at])
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        unknown = np.arange(at, upto) < shard["n_null"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[at:upto], pa.int64(), mask=unknown), pa.array(offsets[at:upto], pa.int64()),
             pa.array(np.diff(offsets[at:upto + 1]), pa.int64()), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])
        at = upto


def token_table(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 2,
                root: str | None = None) -> DataFrame:
    """Encode, write and read back. See ``write_tokens`` and ``read_tokens``."""
    root = root or shared_path(docs.sparkSession, "tokens")
    manifest = write_tokens(docs, root, vocabulary, kind, end_id)
    return read_tokens(manifest, root, encoder(vocabulary, kind).dtype.str)
