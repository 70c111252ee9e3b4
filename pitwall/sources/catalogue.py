"""A table of session files: what is there, how each is typed and which days it covers.

``refresh`` lists folders through Spark, compares the listing with the table and opens
only files that are new or have changed since; their footers are read by executors. The
table is appended to, so what was known stays known, and reading it is reading a table.
A file's row is its newest one; files that are gone leave the table's view.

Files reach Python as the bytes that Spark's own reader gives, so any store that Spark
reads will do. A file larger than ``LARGEST`` is not taken whole: its schema is read by
Spark and its days are left open, which keeps it in every scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwall.plans.lake import cut
from pitwall.sources.sessions import as_raw

LARGEST = 64 << 20
AT_ONCE = 10_000  # files named to one scan
COLUMNS = "file string, size long, modified timestamp, kind string, n_rows long, first_day date, last_day date"
EMPTY = "no Parquet files"


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """file, size and modified of every Parquet file below ``folders``; no file is opened."""
    if not folders:
        raise ValueError(EMPTY)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folders)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(COLUMNS).parquet(f"{table}/run=*")


def known(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of every file ever seen."""
    rows = _stored(spark, table)
    if rows is None:
        return spark.createDataFrame([], COLUMNS)
    names = [c for c in rows.columns if c != "file"]
    return rows.groupBy("file").agg(F.max(F.struct("modified", "size", *[n for n in names if n not in ("modified", "size")])).alias("r")).select(
        "file", *[F.col("r")[n].alias(n) for n in names])


def _days(source: BytesIO, footer: pq.FileMetaData, schema: pa.Schema) -> tuple:
    """First and last day of a file: from the statistics of its row groups, else from the column of dates alone."""
    at = schema.get_field_index("Date")
    if at < 0 or not pa.types.is_timestamp(schema.field(at).type):
        return None, None
    column = [footer.schema.column(c).path for c in range(footer.num_columns)].index("Date")
    stats = [footer.row_group(g).column(column).statistics for g in range(footer.num_row_groups)]
    if stats and all(s is not None and s.has_min_max for s in stats):
        return min(s.min for s in stats).date(), max(s.max for s in stats).date()
    ends = pc.min_max(pq.read_table(source, columns=["Date"]).column("Date").cast(pa.timestamp("us"), safe=False)).as_py()
    return (ends["min"].date(), ends["max"].date()) if ends["min"] else (None, None)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Schema, rows and days of files given as bytes."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            source = BytesIO(batch.column("content")[i].as_buffer())
            footer = pq.read_metadata(source)
            schema = footer.schema.to_arrow_schema().remove_metadata()
            first, last = _days(source, footer, schema)
            out.append({"file": batch.column("path")[i].as_py(), "kind": str(schema), "n_rows": footer.num_rows,
                        "first_day": first, "last_day": last})
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("file", pa.string()), ("kind", pa.string()), ("n_rows", pa.int64()), ("first_day", pa.date32()), ("last_day", pa.date32())]))


def refresh(spark: SparkSession, folders: list[str], table: str) -> dict[str, int]:
    """Bring the catalogue up to date: files there, and files opened. No file at all is an error."""
    there = cut(listing(spark, folders))
    n = there.count()
    if n == 0:
        raise ValueError(EMPTY)
    same = known(spark, table).select("file", "size", "modified")
    new = cut(there.join(same, ["file", "size", "modified"], "left_anti"))
    opened = new.count()
    if opened:
        parts, usual = [], new.where(F.col("size") <= LARGEST)
        for names in _chunks(usual):
            content = spark.read.format("binaryFile").load(names).select("path", "content")
            parts.append(content.repartition(max(1, min(len(names), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(
                _described, "file string, kind string, n_rows long, first_day date, last_day date"))
        for r in new.where(F.col("size") > LARGEST).select("file").toLocalIterator():
            kind = spark.read.parquet(r["file"]).schema.simpleString()
            parts.append(spark.createDataFrame([(r["file"], kind, None, None, None)],
                                               "file string, kind string, n_rows long, first_day date, last_day date"))
        run = uuid.uuid4().hex
        for i, part in enumerate(parts):
            rows = new.join(part, "file").select(*[c.split()[0] for c in COLUMNS.split(", ")])
            rows.write.parquet(f"{table}/run={run}-{i}")
    return {"files": n, "opened": opened}


def _chunks(files: DataFrame) -> Iterator[list[str]]:
    """File names a bounded number at a time, in order."""
    names: list[str] = []
    for r in files.select("file").orderBy("file").toLocalIterator():
        names.append(r["file"])
        if len(names) == AT_ONCE:
            yield names
            names = []
    if names:
        yield names


def catalogue(spark: SparkSession, folders: list[str], table: str) -> DataFrame:
    """The rows of the files that are there now, as a table."""
    return known(spark, table).join(listing(spark, folders).select("file"), "file", "left_semi")


def scan(spark: SparkSession, files: DataFrame, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """Sessions of the catalogued ``files`` as one table, one scan for each schema and ``AT_ONCE`` files.

    With days given, files whose days lie outside are not named to any scan. Rows of the
    others are not filtered.
    """
    if first_day:
        files = files.where(F.col("last_day").isNull() | (F.col("last_day") >= F.lit(first_day).cast("date")))
    if last_day:
        files = files.where(F.col("first_day").isNull() | (F.col("first_day") <= F.lit(last_day).cast("date")))
    files, out = cut(files), None
    for r in files.select("kind").distinct().orderBy("kind").collect():  # a handful of schemas
        for names in _chunks(files.where(F.col("kind") == r["kind"])):
            part = as_raw(spark.read.schema(spark.read.parquet(names[0]).schema).parquet(*names))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(EMPTY)
    return out
