"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, cores: int | None = None, name: str = "pitwall",
            **conf) -> SparkSession:
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Very wide aggregates fuse into one long method that the JIT leaves alone.
        # Above this width Spark takes its split code path: the partial sums of the
        # feature store took 1.7 s instead of 4.7 s on the sf0.1 tables.
        "spark.sql.codegen.maxFields": "60",
        "spark.sql.legacy.parquet.nanosAsLong": "true",  # raw session files hold nanoseconds
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if cores:
        settings["spark.sql.shuffle.partitions"] = str(cores)
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
