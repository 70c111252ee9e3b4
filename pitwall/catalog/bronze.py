"""Sources, sinks and the cleaning of raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pitwall.catalog import explore, query, rounded, season  # noqa: F401
from pitwall.catalog.oracle import metric_columns, sql, step
from pitwall.functions import scalars as fn
from pitwall.operators import bronze
from pitwall.operators.features import driver_window
from pitwall.plans import explore as ex, publish
from pitwall.plans.incremental import update
from pitwall.plans.pipeline import build_layers
from pitwall.sources import console, sessions as src
from pitwall.sources.testbed import CLOSED_BEFORE

step("raw", """
WITH first AS (
SELECT CAST(driverid AS VARCHAR) AS DriverNumber, 'B ' || full_name AS BroadcastName, full_name AS FullName,
       upper(substr(full_name, 1, 3)) AS Abbreviation,
       CASE WHEN driverid % 29 = 7 THEN NULL WHEN driverid % 23 = 5 THEN 'nan' ELSE 'd' || driverid END AS DriverId,
       team_name AS TeamName, CASE WHEN teamid % 5 = 0 THEN 'nan' ELSE upper(team_color) END AS TeamColor,
       't' || teamid AS TeamId, CAST(position AS VARCHAR) AS ClassifiedPosition,
       CASE WHEN is_finished = 1 THEN 'Finished' WHEN driverid % 3 = 0 THEN '+1 Lap' ELSE 'Retired' END AS Status,
       CASE WHEN driverid % 11 <> 0 THEN grid_position + (driverid % 2) * CAST(0.5 AS DOUBLE) END AS GridPosition,
       CASE WHEN driverid % 13 <> 0 THEN CAST(position AS DOUBLE) END AS Position,
       CASE WHEN driverid % 17 <> 0 THEN CAST(points AS DOUBLE) END AS Points,
       CASE WHEN mode = 'Race' THEN CASE WHEN position = 1 THEN 5400250000000 ELSE CAST(position AS BIGINT) * 1370000000 END END AS Time,
       CASE WHEN mode = 'Qualifying' THEN 80000000000 + CAST(position AS BIGINT) * 137000000 END AS Q1,
       CASE WHEN mode = 'Qualifying' AND position <= 15 THEN 79000000000 + CAST(position AS BIGINT) * 130000000 END AS Q2,
       CASE WHEN mode = 'Qualifying' AND position <= 10 THEN 58500000000 + CAST(position AS BIGINT) * 120000000 END AS Q3,
       year AS Year, CAST(event_date AS TIMESTAMP) AS Date, mode AS Mode, round_number AS RoundNumber,
       'Grand ' || event_name AS OfficialEventName, event_name AS EventName, country AS Country, location AS Location,
       air_temp AS AirTemp, track_temp AS TrackTemp, humidity AS Humidity, pressure AS Pressure,
       wind_speed AS WindSpeed, wind_direction AS WindDirection,
       CASE WHEN year >= 1996 THEN rainfall END AS Rainfall
FROM results)
SELECT * FROM first
UNION ALL SELECT * REPLACE (Date + INTERVAL 12 HOURS AS Date, Position + 1 AS Position) FROM first WHERE RoundNumber = 6
""", "results")
_TEXT = ", ".join(f"{a} AS {b}" for a, b in bronze.TEXT.items())
_WEATHER = ", ".join(f"{a} AS {b}" for a, b in bronze.WEATHER.items())
step("cleaned", f"""
SELECT CAST(DriverNumber AS INT) AS driver_number, {_TEXT}, {_WEATHER},
       TRY_CAST(GridPosition AS INT) AS grid_position, TRY_CAST(Position AS INT) AS position,
       COALESCE(Points, 0) AS points, Year AS year, CAST(Date AS DATE) AS event_date,
       RoundNumber AS round_number,
       CASE WHEN Status = 'Finished' OR starts_with(Status, '+') THEN 1 ELSE 0 END AS is_finished,
       COALESCE(TRY_CAST(GridPosition AS INT) - TRY_CAST(Position AS INT), 0) AS overtakes,
       COALESCE(Rainfall, 0) AS rainfall
FROM raw r WHERE DriverId <> 'nan' AND NOT EXISTS (
    SELECT 1 FROM raw o WHERE o.DriverId = r.DriverId AND o.Year = r.Year AND o.RoundNumber = r.RoundNumber
      AND o.Mode = r.Mode AND o.Date > r.Date)""", "raw")

query("p1_build_results", sql("SELECT * FROM cleaned", "cleaned"))(lambda t: bronze.build_results(t.raw))


def _typed(t):
    return t.raw.where(fn.has_key("DriverId")).select("Date", *[c.alias(n) for n, c in bronze.projection().items()])


query("b1_rename_cast", sql("""
    SELECT CAST(DriverNumber AS INT) AS driver_number, FullName AS full_name, TeamId AS teamid, Year AS year,
           CAST(Date AS DATE) AS event_date, Mode AS mode, RoundNumber AS round_number, EventName AS event_name FROM raw""", "raw"),
    )(lambda t: t.raw.select(*[bronze.projection()[c].alias(c) for c in (
        "driver_number", "full_name", "teamid", "year", "event_date", "mode", "round_number", "event_name")]))
query("b2_safe_cast", sql("""
    SELECT TRY_CAST(GridPosition AS INT) AS grid, TRY_CAST(Position AS INT) AS place, TRY_CAST('x' || TeamName AS DOUBLE) AS not_a_number,
           TRY_CAST(CAST(GridPosition AS VARCHAR) AS INT) AS from_text FROM raw""", "raw"),
    )(lambda t: t.raw.select(fn.whole("GridPosition").alias("grid"), fn.whole("Position").alias("place"),
                             fn.number(F.concat(F.lit("x"), "TeamName")).alias("not_a_number"),
                             fn.whole(F.col("GridPosition").cast("string"), text=True).alias("from_text")))
query("b3_null_default", sql("""
    SELECT COALESCE(Points, 0) AS points, COALESCE(Rainfall, 0) AS rainfall, COALESCE(AirTemp, -1) AS air_temp FROM raw""", "raw"),
    )(lambda t: t.raw.select(fn.number_or_zero("Points").alias("points"), F.coalesce("Rainfall", F.lit(0)).alias("rainfall"),
                             F.coalesce("AirTemp", F.lit(-1.0)).alias("air_temp")))
query("b4_finished_flag", sql("""
    SELECT Status AS status, MAX(CASE WHEN Status = 'Finished' OR Status LIKE '+%' THEN 1 ELSE 0 END) AS is_finished, COUNT(*) AS n
    FROM raw GROUP BY Status""", "raw"),
    )(lambda t: t.raw.groupBy(F.col("Status").alias("status"), fn.finished("Status").alias("is_finished")).agg(F.count(F.lit(1)).alias("n")))
query("b5_positions_gained", sql("""
    SELECT DriverNumber, Year, RoundNumber, Mode,
           CASE WHEN GridPosition IS NULL OR Position IS NULL THEN 0
                ELSE TRY_CAST(GridPosition AS INT) - TRY_CAST(Position AS INT) END AS overtakes FROM raw""", "raw"),
    )(lambda t: t.raw.select("DriverNumber", "Year", "RoundNumber", "Mode",
                             fn.gained(fn.whole("GridPosition"), fn.whole("Position")).alias("overtakes")))
query("b6_key_present", sql("""
    SELECT DriverId, COUNT(*) AS n FROM raw WHERE DriverId IS NOT NULL AND DriverId <> 'nan' GROUP BY ALL""", "raw"),
    )(lambda t: t.raw.where(fn.has_key("DriverId")).groupBy("DriverId").agg(F.count(F.lit(1)).alias("n")))
query("b7_membership", sql("""
    SELECT driverid, event_date, mode FROM results WHERE mode IN ('Race', 'Sprint', 'Sprint Race')""", "results"),
    )(lambda t: ex.scoring(t.results).select("driverid", "event_date", "mode"))
query("b12_drop_missing", sql("""
    SELECT DriverNumber, GridPosition, Position FROM raw WHERE GridPosition IS NOT NULL AND Position IS NOT NULL""", "raw"),
    )(lambda t: t.raw.dropna(subset=["GridPosition", "Position"]).select("DriverNumber", "GridPosition", "Position"))
query("b19_whole_number_view", sql("""
    SELECT DriverNumber, Year, RoundNumber, Mode, CAST(Position AS BIGINT) AS position, CAST(Points AS BIGINT) AS points FROM raw""", "raw"),
    )(lambda t: t.raw.select("DriverNumber", "Year", "RoundNumber", "Mode", F.col("Position").cast("bigint").alias("position"),
                             F.col("Points").cast("bigint").alias("points")))
query("b20_display_projection", sql("""
    SELECT full_name AS "Driver", team_name AS "Team", points AS "Points", position AS "Pos" FROM races""", "races"),
    )(lambda t: ex.races(t.results).select(*[F.col(a).alias(b) for a, b in (
        ("full_name", "Driver"), ("team_name", "Team"), ("points", "Points"), ("position", "Pos"))]))

# -- sources and sinks ----------------------------------------------------------


def _landed(t):
    return t.lake.built("landing", lambda path: src.land_session(t.raw, path))


def scan_mixed(t):
    """Old files lack weather and hold dates as nanoseconds; new ones are complete."""
    old, new = t.lake.path("files_old"), t.lake.path("files_new")
    t.raw.where("Year < 1998").drop(*src.READINGS, "Rainfall").withColumn(
        "Date", F.unix_micros("Date") * 1000).write.mode("overwrite").parquet(old)
    t.raw.where("Year >= 1998").write.mode("overwrite").parquet(new)
    return src.scan_sessions(t.spark, [old, new]).groupBy("Year").agg(
        F.count(F.lit(1)).alias("n"), F.count("AirTemp").alias("with_weather"), F.max(F.to_date("Date")).alias("last_date"))


_MIXED = sql("""
    SELECT Year, COUNT(*) AS n, COUNT(AirTemp) FILTER (WHERE Year >= 1998) AS with_weather, MAX(CAST(Date AS DATE)) AS last_date
    FROM raw GROUP BY Year""", "raw")
query("a1_scan_sessions", _MIXED)(scan_mixed)
query("u4_union_by_name", _MIXED)(scan_mixed)
query("a2_scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000")(
    lambda t: src.scan(t.spark, f"{t.sf_dir}/orders.parquet").where("o_totalprice > 400000").select(
        "o_orderkey", "o_custkey", "o_totalprice"))


def csv_labels(t):
    path = t.lake.path("births_csv")
    console.export_csv(t.births, path)
    return src.scan_labels(t.spark, path, "driverid bigint, date_of_birth date")


query("a3_scan_labels", sql("SELECT * FROM births", "births"))(csv_labels)
query("a12_export_csv", sql("SELECT * FROM births", "births"))(csv_labels)


def written_layer(t):
    path = t.lake.path("written")
    size = src.write_layer(t.driver_standings, path, ("year",))
    return t.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "written", F.lit(size["rows"]))


query("a4_write_layer", sql("""
    SELECT year, COUNT(*) AS n, (SELECT COUNT(*) FROM driver_standings) AS written FROM driver_standings GROUP BY year""", "driver_standings"),
    )(written_layer)
query("a9_audit_layer", sql("""
    SELECT COUNT(*) AS n, 26 AS n_columns FROM results""", "results"),
    )(lambda t: (lambda size: t.spark.read.parquet(t.lake.path("audited")).agg(F.max(F.lit(size["rows"])).alias("n")).withColumn(
        "n_columns", F.lit(size["columns"])))(src.write_layer(t.results, t.lake.path("audited"))))


def relanded(t):
    """One session landed a second time replaces only itself."""
    path = t.lake.path("landed_twice")
    src.land_session(t.raw, path)
    again = t.raw.where("Year = 1999 AND RoundNumber = 3 AND Mode = 'Race'").withColumn("Points", F.lit(1.0))
    src.land_session(again, path)
    return t.spark.read.parquet(path).groupBy("Year", "RoundNumber", "Mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Points").cast("bigint").alias("points"))


query("a5_land_session", sql("""
    SELECT Year, RoundNumber, Mode, COUNT(*) AS n,
           CAST(SUM(CASE WHEN Year = 1999 AND RoundNumber = 3 AND Mode = 'Race' THEN 1 ELSE Points END) AS BIGINT) AS points
    FROM raw GROUP BY ALL""", "raw"))(relanded)
_DAY = ["user_id", "day", "event_type"]


def _event_days(t):
    return t.table("events").withColumn("day", F.to_date("ts"))


query("a6_land_new", """
    SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND CAST(o.ts AS DATE) = CAST(e.ts AS DATE)
                      AND o.event_type = e.event_type AND o.value < 10)""")(
    lambda t: src.to_land(_event_days(t), _event_days(t).where("value < 10"), key=_DAY).select(
        "event_id", "user_id", "day", "event_type"))
query("a6_land_forced", """
    SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type FROM events""")(
    lambda t: src.to_land(_event_days(t), _event_days(t), force=True, key=_DAY).select(
        "event_id", "user_id", "day", "event_type"))
query("a7_attach_session_meta", sql("""
    SELECT t.driverid, t.year, t.round_number, t.mode, t.points, w.air_temp, w.rainfall
    FROM totals t JOIN session_weather_fixture w USING (year, round_number, mode)""", "totals", "session_weather_fixture"),
    )(lambda t: src.attach_session_meta(
        t.lake.layer("session_totals", t._session_totals).select("driverid", "year", "round_number", "mode", "points"),
        t.results.select("year", "round_number", "mode", "air_temp", "rainfall").distinct(), ["year", "round_number", "mode"]))


# Each mean of a session has readings of its own.
_SCALED = {"AirTemp": "value", "TrackTemp": "value + 1", "Humidity": "value * 2", "Pressure": "value + event_id % 7",
           "WindSpeed": "value / 4", "WindDirection": "value * 3 - 1"}


def _weather(t):
    readings = t.table("events").select(F.to_date("ts").alias("day"), *[F.expr(e).alias(f"r_{n}") for n, e in _SCALED.items()],
                                        (F.col("event_type") == "error").alias("rain"))
    return src.session_weather(readings, ["day"], {n: f"r_{n}" for n in _SCALED}, "rain")


def _all_days(t):
    """Days with readings, and days of orders that mostly have none."""
    return t.table("events").select(F.to_date("ts").alias("day")).union(
        t.table("orders").select(F.to_date("o_orderdate").alias("day"))).distinct()


query("a8_session_weather", f"""
    WITH d AS (SELECT CAST(ts AS DATE) AS day FROM events UNION SELECT CAST(o_orderdate AS DATE) FROM orders),
    w AS (SELECT CAST(ts AS DATE) AS day, {", ".join(f"AVG({e}) AS r_{n}" for n, e in _SCALED.items())},
                 MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1)
    SELECT d.day, {", ".join(f'round(r_{n} + 1e-9, 6) AS "{n}"' for n in _SCALED)}, w.r AS "Rainfall" FROM d LEFT JOIN w USING (day)""")(
    lambda t: rounded(src.with_weather(_all_days(t), _weather(t), ["day"])))


def lake_root(t):
    """All layers of the fixture's results, built once."""
    labels = {"champions": t.champions, "team_champions": t.team_champions, "births": t.births}
    return t.lake.built("pipeline", lambda root: build_layers(
        t.results, labels, root, first_year=1996, closed_before=CLOSED_BEFORE, label_year=1995))


def layer_counts(t):
    """Rows of every registered layer, by SQL over the views."""
    names = console.register_lake(t.spark, lake_root(t))
    return console.run_sql(t.spark, " UNION ALL ".join(f"SELECT '{n}' AS layer, COUNT(*) AS n FROM {n}" for n in names))


_LAYERS = {"results": "results", **{f"fs_driver_{k}": f"fs_{k}" for k in ("life", "last10", "last20", "last40", "all")},
           "abt_champions": "t1", "abt_teams": "t2", "abt_champions_inseason": "t3", "abt_teams_inseason": "t4",
           "abt_departures": "t5", "abt_departures_inseason": "t6"}
query("a10_register_lake", sql(" UNION ALL ".join(f"SELECT '{n}' AS layer, COUNT(*) AS n FROM {s}" for n, s in _LAYERS.items()),
                               *_LAYERS.values()))(layer_counts)
query("a15_build_layers", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS layer, {'year' if n == 'results' else 'year(dt_ref)'} AS season, COUNT(*) AS n FROM {s} GROUP BY ALL"
    for n, s in _LAYERS.items()), *_LAYERS.values()))(
    lambda t: reduce(lambda a, b: a.unionByName(b), [
        t.spark.read.parquet(f"{lake_root(t)}/{n}").groupBy(F.col("year" if n == "results" else "season").cast("bigint").alias("season")).agg(
            F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(n)) for n in _LAYERS]))
OUT_OF_ORDER = "year = 1998 AND round_number = 5 AND mode = 'Race'"


def grown_root(t):
    """The same layers, published in three steps: seasons up to 1999 but for one race, later seasons, and that race."""
    def grow(root):
        labels = {"champions": t.champions, "team_champions": t.team_champions, "births": t.births}
        for where in (f"year < 2000 AND NOT ({OUT_OF_ORDER})", "year >= 2000", OUT_OF_ORDER):
            update(t.spark, root, t.results.where(where), labels, first_year=1996, closed_before=CLOSED_BEFORE, label_year=1995)
    return t.lake.built("grown", grow)


query("a15_incremental_features", sql(f"SELECT dt_ref, driverid, {metric_columns()} FROM fs_all", "fs_all"))(
    lambda t: rounded(publish.read(t.spark, grown_root(t), "fs_driver_all").drop("season")))
query("a15_incremental_layers", sql(" UNION ALL ".join(
    f"SELECT '{n}' AS layer, {'year' if n == 'results' else 'year(dt_ref)'} AS season, COUNT(*) AS n FROM {s} GROUP BY ALL"
    for n, s in _LAYERS.items()), *_LAYERS.values()))(
    lambda t: reduce(lambda a, b: a.unionByName(b), [
        publish.read(t.spark, grown_root(t), n).groupBy(F.col("year" if n == "results" else "season").cast("bigint").alias("season")).agg(
            F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(n)) for n in _LAYERS]))
query("a13_suffix_parameter", sql(
    "SELECT dt_ref, driverid, qtd_wins_last10 AS qtd_wins_form, total_points_last10 AS total_points_form FROM fs_last10", "fs_last10"),
    )(lambda t: driver_window(t.results, 10, "form").select("dt_ref", "driverid", "qtd_wins_form", "total_points_form"))
_EVENT = """
    SELECT r.Position AS position, r.FullName AS full_name, r.TeamName AS team_name, r.GridPosition AS grid_position,
           r.Points AS points, r.Status AS status, r.EventName AS event_name, CAST(r.Date AS DATE) AS event_date,
           r.GridPosition - r.Position AS positions_gained, r.Time AS race_time, q.Position AS quali_position,
           COALESCE(q.Q3, q.Q2, q.Q1) AS best_quali_time
    FROM raw r LEFT JOIN (SELECT * FROM raw WHERE Mode = 'Qualifying' AND Year = 1999 AND RoundNumber = 5) q
      ON q.DriverId = r.DriverId AND q.DriverId <> 'nan'
    WHERE r.Mode = 'Race' AND r.Year = 1999 AND r.RoundNumber = 5 AND r.DriverId <> 'nan'"""


def _event(t, r=5):
    return src.event_results(t.spark.read.parquet(_landed(t)).where(fn.has_key("DriverId")), 1999, r)


query("a14_event_result_scan", sql(_EVENT, "raw"))(_event)
query("j19_race_left_join_quali", sql(_EVENT, "raw"))(_event)
query("x13_first_non_null", sql("""
    SELECT DriverNumber, Year, RoundNumber, COALESCE(Q3, Q2, Q1) AS best FROM raw WHERE Mode = 'Qualifying'""", "raw"),
    )(lambda t: t.raw.where("Mode = 'Qualifying'").select("DriverNumber", "Year", "RoundNumber", F.coalesce("Q3", "Q2", "Q1").alias("best")))
_LAP = """CASE WHEN {0} IS NULL OR {0} = 0 THEN '' WHEN {0} >= 60000000000
    THEN printf('%d:%06.3f', {0} // 60000000000, ({0} % 60000000000) / 1e9) ELSE printf('%.3f', {0} / 1e9) END"""
_RACE = """CASE WHEN {0} IS NULL OR {0} = 0 THEN '' WHEN {1} THEN printf('%d:%02d:%06.3f', {0} // 3600000000000,
    ({0} // 60000000000) % 60, ({0} % 60000000000) / 1e9) ELSE printf('+%.3fs', {0} / 1e9) END"""
step("ev", _EVENT, "raw")
query("q34_race_result_table", sql(f"""
    SELECT CAST(position AS BIGINT) AS "Pos", full_name AS "Driver", team_name AS "Team", CAST(quali_position AS BIGINT) AS "Quali",
           CAST(trunc(grid_position) AS BIGINT) AS "Grid",
           CASE WHEN positions_gained > 0 THEN '+' ELSE '' END ||
               COALESCE(CAST(CAST(trunc(positions_gained) AS INT) AS VARCHAR), '') AS "+/-",
           {_LAP.format('best_quali_time')} AS "Quali Time",
           {_RACE.format('race_time', 'position = (SELECT MIN(position) FROM ev)')} AS "Race Time",
           CAST(points AS BIGINT) AS "Points", status AS "Status" FROM ev""", "ev"),
    )(lambda t: ex.result_table(_event(t)))
