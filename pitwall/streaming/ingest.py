"""Incremental ingestion: new files once, newest row per key, session weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from pitwall.operators.bronze import newest
from pitwall.plans.lake import cut


def new_files(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet",
              max_files: int = 1000) -> DataFrame:
    """Files not seen before; the checkpoint of the sink remembers which were."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", max_files).parquet(path))


def ingest(stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Append everything new to a table and stop."""
    w = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True))
    return (w.partitionBy(*partition_by) if partition_by else w).start()


def keep_newest(stream: DataFrame, path: str, checkpoint: str, key: list[str], at: str,
                partition: str) -> StreamingQuery:
    """Maintain the newest row per key in a partitioned table.

    Each batch is merged with the partitions it touches; only their folders are read
    and rewritten. Rows without a partition value are a partition, too. Running a batch
    again gives the same table.
    """
    schema = stream.schema

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(newest(batch, key, at))
        if batch.isEmpty():
            return
        # the folders this batch rewrites; whoever commits the write names each of them anyway
        touched = [r[0] for r in batch.select(partition).distinct().collect()]
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        merged = batch
        if fs.exists(folder):
            at_ = F.col(partition)
            wanted = at_.isin([v for v in touched if v is not None])
            old = spark.read.schema(schema).parquet(path).where(wanted | at_.isNull() if None in touched else wanted)
            merged = cut(newest(old.unionByName(batch), key, at))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(path))

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def session_weather_stream(stream: DataFrame, at: str, reading: str, rain: str,
                           session: str = "1 day", lateness: str = "6 hours") -> DataFrame:
    """Session means, final once the watermark has passed the session's end."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp"))
    return (timed.withWatermark(at, lateness).groupBy(F.window(at, session).alias("w"))
            .agg(F.avg(reading).alias("air_temp"), F.max(F.col(rain).cast("int")).alias("rainfall"),
                 F.count(F.lit(1)).alias("readings"))
            .select(F.to_date("w.start").alias("day"), "air_temp", "rainfall", "readings"))
