"""Ad-hoc SQL over registered layers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pitwall.plans.publish import current, read

# Table names offered to ad-hoc queries.
TABLES = (
    "results", "fs_driver_life", "fs_driver_last10", "fs_driver_last20", "fs_driver_last40",
    "fs_driver_all", "abt_champions", "abt_champions_inseason", "abt_teams",
    "abt_teams_inseason", "abt_departures", "abt_departures_inseason",
)


def register_lake(spark: SparkSession, root: str, names=TABLES) -> list[str]:
    """Make each stored layer a view; a layer that is not there is an error.

    Where runs are published, all views are of one version, the newest.
    """
    layers = current(spark, root)
    for name in names:
        df = read(spark, root, name, layers) if layers else spark.read.parquet(os.path.join(root, name))
        df.createOrReplaceTempView(name)
    return list(names)


def run_sql(spark: SparkSession, text: str, limit: int = 1000) -> DataFrame:
    """Run a query, capped for display unless its outermost step is a limit."""
    df = spark.sql(text.strip().rstrip(";"))
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "WithCTE":
        plan = plan.plan()
    return df if plan.nodeName() == "GlobalLimit" else df.limit(limit)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
