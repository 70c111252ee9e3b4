"""Landing, scanning and writing session files and label files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitwall.plans.lake import shared_root, small

# Columns of a raw session file.
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    *[(c, T.StringType()) for c in (
        "DriverNumber", "BroadcastName", "FullName", "Abbreviation", "DriverId", "TeamName",
        "TeamColor", "TeamId", "ClassifiedPosition", "Status")],
    *[(c, T.DoubleType()) for c in ("GridPosition", "Position", "Points")],
    *[(c, T.LongType()) for c in ("Time", "Q1", "Q2", "Q3")],
    ("Year", T.IntegerType()), ("Date", T.TimestampType()), ("Mode", T.StringType()),
    ("RoundNumber", T.IntegerType()),
    *[(c, T.StringType()) for c in ("OfficialEventName", "EventName", "Country", "Location")],
    *[(c, T.DoubleType()) for c in (
        "AirTemp", "TrackTemp", "Humidity", "Pressure", "WindSpeed", "WindDirection")],
    ("Rainfall", T.IntegerType()),
]])
SESSION = ["Year", "RoundNumber", "Mode"]
LABELS = {
    "champions": "year int, driverid string",
    "team_champions": "year int, teamid string",
    "births": "driverid string, date_of_birth date",
}
READINGS = {"AirTemp": "AirTemp", "TrackTemp": "TrackTemp", "Humidity": "Humidity",
            "Pressure": "Pressure", "WindSpeed": "WindSpeed", "WindDirection": "WindDirection"}


def as_raw(df: DataFrame) -> DataFrame:
    """Cast to the raw schema; absent columns become NULL, nanoseconds timestamps."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def one(f):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType) and isinstance(have[f.name], T.LongType):
            c = F.timestamp_micros(F.floor(c / 1000))
        if isinstance(f.dataType, T.LongType) and isinstance(have[f.name], T.DayTimeIntervalType):
            c = (F.extract(F.lit("EPOCH"), c) * 1_000_000_000)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in RAW_SCHEMA.fields])


def scan_sessions(spark: SparkSession, files: list[str], table: str | None = None) -> DataFrame:
    """Files (or folders of files) of differing schemas as one table: one scan per distinct schema.

    ``table`` is where the catalogue of files is kept, see ``sources.catalogue``: with it,
    a second scan opens the footers of new files only. Without it, one is made for this scan.
    Timestamps stored in nanoseconds are read as whole numbers, which needs
    ``spark.sql.legacy.parquet.nanosAsLong``; ``plans.session`` sets it.
    """
    from pitwall.sources import catalogue as cat
    table = table or f"{shared_root(spark)}/catalogue-{uuid.uuid4().hex}"
    cat.refresh(spark, files, table)
    return cat.scan(spark, cat.catalogue(spark, files, table))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_layer(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> dict[str, int]:
    """Write a layer and report its size, counted while writing."""
    from pyspark.sql import Observation
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    keys = {"dt_ref", "driverid"}
    return {"rows": seen.get["rows"], "columns": len(df.columns),
            "features": len([c for c in df.columns if c not in keys])}


def land_session(df: DataFrame, path: str) -> None:
    """One partition per session; landing it again replaces that session only."""
    # Rebalancing gathers a session's rows but still splits an oversized one.
    (df.hint("rebalance", *SESSION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SESSION).parquet(path))


def to_land(incoming: DataFrame, landed: DataFrame | None, force: bool = False,
            key: list[str] = SESSION) -> DataFrame:
    """Rows whose session is not landed yet; all of them when forced."""
    if force or landed is None:
        return incoming
    return incoming.join(landed.select(*key).distinct(), key, "left_anti")


def attach_session_meta(results: DataFrame, sessions: DataFrame, key: list[str]) -> DataFrame:
    return results.join(small(sessions), key)


def session_weather(readings: DataFrame, key: list[str], means: dict[str, str], rain: str) -> DataFrame:
    """Mean of each reading and whether it rained at all, per session."""
    return readings.groupBy(*key).agg(
        *[F.avg(c).alias(n) for n, c in means.items()],
        F.max(F.col(rain).cast("int")).alias("Rainfall"))


def with_weather(results: DataFrame, weather: DataFrame, key: list[str]) -> DataFrame:
    """Sessions without readings keep NULL weather."""
    return results.join(small(weather), key, "left")


def event_results(raw: DataFrame, year: int, round_number: int) -> DataFrame:
    """Race rows of one event with each entrant's qualifying, if there was any."""
    event = raw.where((F.col("Year") == year) & (F.col("RoundNumber") == round_number))
    race = event.where(F.col("Mode") == "Race")
    quali = event.where(F.col("Mode") == "Qualifying").select(
        "DriverId", F.col("Position").alias("quali_position"),
        F.coalesce("Q3", "Q2", "Q1").alias("best_quali_time"))
    return race.join(quali, "DriverId", "left").select(
        F.col("Position").alias("position"), F.col("FullName").alias("full_name"),
        F.col("TeamName").alias("team_name"), F.col("GridPosition").alias("grid_position"),
        F.col("Points").alias("points"), F.col("Status").alias("status"),
        F.col("EventName").alias("event_name"), F.to_date("Date").alias("event_date"),
        (F.col("GridPosition") - F.col("Position")).alias("positions_gained"),
        F.col("Time").alias("race_time"), "quali_position", "best_quali_time")
