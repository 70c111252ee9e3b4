"""Streams that judge arrival: readings that come too late, rounds that come too early."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitwall.plans.lake import cut

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


# -- readings that come too late ------------------------------------------------
def split_late(stream: DataFrame, at: str, on_time: str, late: str, checkpoint: str, gap: str = "30 minutes",
               lateness: str = "6 hours") -> StreamingQuery:
    """Part a stream into the rows a session window still takes and those it would drop.

    A row is late if its own session, ``at`` plus ``gap``, ends no later than the newest
    time of all earlier batches less ``lateness``: the rule Spark's watermark follows.
    Late rows are kept with the mark they missed (``closed``); rows without a time belong
    to no session and are kept with them. Each batch is a folder of its own, so running a
    batch again replaces what it wrote.
    """
    marks = f"{on_time}_marks"

    def part(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn(at, F.col(at).cast("timestamp")))
        mark = None
        if _exists(spark, marks):
            known = spark.read.schema("newest timestamp, batch long").parquet(marks)
            mark = known.where(F.col("batch") < batch_id).agg(F.max("newest").cast("string")).first()[0]  # one row a batch
        closed = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        missed = F.col(at).isNull() | F.coalesce(F.col(at) + F.expr(f"INTERVAL {gap}") <= closed, F.lit(False))
        rows.where(missed).withColumn("closed", closed).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        rows.where(~missed).write.mode("overwrite").parquet(f"{on_time}/batch={batch_id}")
        newest = rows.agg(F.greatest(F.max(at), F.lit(mark).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, key: list[str], at: str, readings: dict[str, str], rain: str, gap: str = "30 minutes",
             lateness: str = "6 hours") -> DataFrame:
    """Readings of one key less than ``gap`` apart as one session, final once the watermark has passed its end."""
    means = [F.avg(c).alias(n) for n, c in readings.items()]
    return (stream.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), *key)
            .agg(*means, F.max(F.col(rain).cast("int")).alias("rainfall"), F.count(F.lit(1)).alias("readings"))
            .select(*key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *readings, "rainfall", "readings"))


def weather_sessions(stream: DataFrame, root: str, key: list[str], at: str, readings: dict[str, str], rain: str,
                     gap: str = "30 minutes", lateness: str = "6 hours") -> dict[str, int]:
    """Run both streams over what has arrived: tables ``on_time``, ``late`` and ``sessions`` under ``root``.

    The second stream takes all that the first one passed at once, so its watermark is
    never ahead of the mark a row was judged by, and it drops nothing. Returns the rows
    late so far and those the second stream dropped in this run (none).
    """
    spark, schema = stream.sparkSession, stream.schema
    split_late(stream, at, f"{root}/on_time", f"{root}/late", f"{root}/late_state", gap, lateness).awaitTermination()
    schema = T.StructType([T.StructField(f.name, T.TimestampType()) if f.name == at else f for f in schema.fields])
    passed = spark.readStream.schema(schema).parquet(f"{root}/on_time/batch=*")
    out = (sessions(passed, key, at, readings, rain, gap, lateness).writeStream.format("parquet")
           .option("path", f"{root}/sessions").option("checkpointLocation", f"{root}/sessions_state")
           .outputMode("append").trigger(availableNow=True).start())
    out.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in out.recentProgress for s in p["stateOperators"])
    late = spark.read.schema(schema).parquet(f"{root}/late").count() if _exists(spark, f"{root}/late") else 0
    return {"late": late, "dropped": dropped}


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


# -- rounds that come too early ---------------------------------------------------
def _waiting(schema: T.StructType, number: str, complete: str) -> StatefulProcessor:
    """Per season: the first round that is missing, and the rows of later ones.

    The class is made here so that it travels with the query: Spark starts its state
    worker without the driver's import path.
    """
    class Waiting(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.missing = handle.getValueState("missing", T.StructType([T.StructField("number", T.IntegerType())]))
            self.held = handle.getListState("held", schema)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            parts = [r[schema.names].astype(object) for r in rows]
            if self.held.exists():
                parts.append(pd.DataFrame(list(self.held.get()), columns=schema.names).astype(object))
            every = pd.concat(parts, ignore_index=True)
            there = set(every.loc[every[complete].astype(bool), number])
            missing = self.missing.get()[0] if self.missing.exists() else 1
            while missing in there:
                missing += 1
            self.missing.update((missing,))
            out = every[number] < missing
            rest = every[~out]
            if len(rest):
                self.held.put([tuple(None if pd.isna(v) else v for v in r) for r in rest.itertuples(index=False)])
            else:
                self.held.clear()
            if out.any():
                yield every[out]

        def close(self) -> None:
            pass

    return Waiting()


def in_order(stream: DataFrame, season: str, number: str, complete: Column) -> DataFrame:
    """Rows of a season up to its first missing round; later rounds wait in state until it comes.

    A round is there once a row for which ``complete`` holds has come; rounds start at 1.
    Rows of a round that is out already pass at once, and rows without a season or round never do.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("round_is_there", T.BooleanType())])
    marked = stream.where(F.col(season).isNotNull() & F.col(number).isNotNull()).withColumn("round_is_there", F.coalesce(complete, F.lit(False)))
    out = marked.groupBy(season).transformWithStateInPandas(
        statefulProcessor=_waiting(schema, number, "round_is_there"), outputStructType=schema, outputMode="Append", timeMode="None")
    return out.drop("round_is_there")


def release_in_order(stream: DataFrame, path: str, checkpoint: str, season: str, number: str, complete: Column) -> StreamingQuery:
    """Append what ``in_order`` lets out to a table, partitioned by season, and stop."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)  # the store that arbitrary state needs; a running query keeps its own
    try:
        return (in_order(stream, season, number, complete).writeStream.format("parquet").option("path", path)
                .option("checkpointLocation", checkpoint).partitionBy(season).outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(PROVIDER, before)
