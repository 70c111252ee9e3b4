"""From raw session files to every layer, written and audited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwall.operators import standings as st
from pitwall.operators.bronze import build_results
from pitwall.operators.features import WINDOWS, driver_window, join_windows
from pitwall.plans import base_tables as bt
from pitwall.sources.sessions import scan_sessions, write_layer

SEASON = "season"


def _by_season(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with the column its folders are named by."""
    if "dt_ref" not in df.columns:
        return df, "year"
    return df.withColumn(SEASON, F.year("dt_ref")), SEASON


def build_layers(results: DataFrame, labels: dict[str, DataFrame], root: str, first_year: int = 2000,
                 closed_before: int | None = None, label_year: int | None = None) -> dict[str, dict[str, int]]:
    """Write the twelve named layers under ``root`` by season; the rows and columns of each.

    ``labels`` holds champions, team_champions and births. Every layer is read back
    before the next one is built from it, so a lost executor costs one layer's tasks.
    """
    spark, sizes = results.sparkSession, {}

    def layer(name: str, df: DataFrame) -> DataFrame:
        df, season = _by_season(df)
        path = f"{root}/{name}"
        sizes[name] = write_layer(df, path, (season,))
        back = spark.read.schema(df.schema).parquet(path).select(*df.columns)
        return back.drop(SEASON) if season == SEASON else back

    closed_before = closed_before or results.agg(F.max("year")).first()[0]
    label_year = label_year or first_year
    since = f"{first_year}-01-01"
    results = layer("results", results)
    stores = [layer(f"fs_driver_{k}", driver_window(results, n, k)) for k, n in WINDOWS.items()]
    features = layer("fs_driver_all", join_windows(stores, ["dt_ref", "driverid"]))
    tables = {key: st.standings(st.running_points(results, key), key) for key in ("driverid", "teamid")}
    layer("abt_champions", bt.champions(features, labels["champions"], first_year=label_year))
    layer("abt_champions_inseason", bt.champions_inseason(
        features, results, tables["driverid"], labels["champions"], since=since))
    layer("abt_teams", bt.teams(features, results, labels["team_champions"], first_year=label_year))
    layer("abt_teams_inseason", bt.teams_inseason(
        features, results, tables["teamid"], labels["team_champions"], first_year=first_year))
    layer("abt_departures", bt.departures(features, results, labels["births"], as_of_year=closed_before, since=since))
    layer("abt_departures_inseason", bt.departures_inseason(features, results, labels["births"], first_year=first_year))
    return sizes


def run_pipeline(spark: SparkSession, files: list[str], labels: dict[str, DataFrame], root: str, **years) -> dict[str, dict[str, int]]:
    """Scan session files or folders, clean them and write every layer. See ``build_layers``."""
    return build_layers(build_results(scan_sessions(spark, files)), labels, root, **years)


def extend_pipeline(spark: SparkSession, files: list[str], labels: dict[str, DataFrame], root: str, **years) -> dict[str, int]:
    """Scan new session files or folders, clean them and publish the lake with them. See ``incremental.update``."""
    from pitwall.plans.incremental import update
    return update(spark, root, build_results(scan_sessions(spark, files)), labels, **years)
