"""Streaming ingestion, replayed to completion over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitwall.catalog import bronze, query, rounded  # noqa: F401
from pitwall.streaming import ingest as st
from pitwall.streaming import sessions as ss


def _fresh(t, name):
    """A new output and checkpoint per run: a stream must not see an older one's files."""
    run = uuid.uuid4().hex
    return t.lake.path(f"{name}_{run}"), t.lake.path(f"{name}_{run}_state")


def _events(t):
    return st.new_files(t.spark, t.sf_dir, t.table("events").schema, "events*.parquet")


def _land(t, folder, where):
    """One more file for each day that ``where`` names."""
    events = t.table("events").where(where)
    events.repartition(F.to_date("ts")).write.mode("append").option("maxRecordsPerFile", 20_000).parquet(folder)


def _landed(t, folder):
    return st.new_files(t.spark, folder, t.table("events").schema, max_files=2)


NEWEST = "ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM all_events)"


@query("n1_ingest_stream", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events GROUP BY 1")
def ingested(t):
    """Started three times: many files, then only the files of the newest day, then none."""
    path, state = _fresh(t, "ingested")
    folder = f"{path}_landing"
    t.table("events").createOrReplaceTempView("all_events")
    for where in (f"NOT {NEWEST}", NEWEST, "false"):
        _land(t, folder, where)
        st.ingest(_landed(t, folder), path, state).awaitTermination()
    return t.spark.read.parquet(path).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("n2_latest_per_key_stream", """
    SELECT CAST(ts AS DATE) AS day, user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY ts DESC) = 1""")
def newest_events(t):
    """Older rows of the newest day arrive after newer ones, and a replay changes nothing."""
    path, state = _fresh(t, "newest")
    folder = f"{path}_landing"
    t.table("events").createOrReplaceTempView("all_events")
    key = ["day", "user_id", "event_type"]
    for where in (f"event_type <> 'view' AND {NEWEST}", f"NOT {NEWEST} OR event_type = 'view'"):
        _land(t, folder, where)
        stream = st.new_files(t.spark, folder, t.table("events").schema).withColumn("day", F.to_date("ts"))
        st.keep_newest(stream, path, state, key, "ts", "day").awaitTermination()
    # A second pass with fresh state replays every batch onto the same table.
    st.keep_newest(stream, path, state + "_again", key, "ts", "day").awaitTermination()
    return t.spark.read.parquet(path).select("day", "user_id", "event_type", "event_id")


@query("n3_weather_stream", """
    SELECT CAST(ts AS DATE) AS day, round(AVG(value) + 1e-9, 6) AS air_temp, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS rainfall,
           COUNT(*) AS readings
    FROM events GROUP BY 1 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 6 HOURS FROM events)""")
def weather(t):
    path, state = _fresh(t, "weather")
    stream = _events(t).withColumn("rain", F.col("event_type") == "error")
    st.ingest(st.session_weather_stream(stream, "ts", "value", "rain"), path, state).awaitTermination()
    return rounded(t.spark.read.parquet(path))


# -- rounds that come too early, readings that come too late -----------------------
SESSIONS = "year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS round_number"
ROUNDS = f"""SELECT CAST({SESSIONS}, CASE l_returnflag WHEN 'A' THEN 'Race' WHEN 'N' THEN 'Sprint' ELSE 'Qualifying' END AS mode,
             CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL"""
WITHHELD = "round_number = 3 + season % 4"


@query("n1_rounds_in_order", f"""
    WITH landed AS (SELECT * FROM ({ROUNDS}) WHERE NOT ({WITHHELD} AND season % 2 = 1)),
    races AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY round_number) AS i
              FROM (SELECT DISTINCT season, round_number FROM landed WHERE mode = 'Race')),
    gap AS (SELECT season, 1 + count(*) FILTER (i = round_number) AS missing FROM races GROUP BY season)
    SELECT season, round_number, mode, n FROM landed JOIN gap USING (season) WHERE round_number < missing""")
def rounds_in_order(t):
    """All sessions but those of one round a season; then that round for the even seasons, whose later rounds follow."""
    path, state = _fresh(t, "rounds")
    folder = f"{path}_landing"
    t.table("lineitem").createOrReplaceTempView("lineitem")
    every = t.spark.sql(ROUNDS)
    for where in (f"NOT ({WITHHELD})", f"{WITHHELD} AND season % 2 = 0"):
        every.where(where).repartition("season").write.mode("append").parquet(folder)
        stream = st.new_files(t.spark, folder, every.schema, max_files=3)
        ss.release_in_order(stream, path, state, "season", "round_number", F.col("mode") == "Race").awaitTermination()
    return t.spark.read.parquet(path).select("season", "round_number", "mode", "n")


HELD_BACK = "event_id % 53 = 0"
_LATE = f"""
    WITH first AS (SELECT * FROM events WHERE NOT {HELD_BACK}),
    m AS (SELECT max(ts) - INTERVAL 6 HOURS AS closed FROM first),
    back AS (SELECT *, ts + INTERVAL 2 HOURS <= closed AS late FROM events, m WHERE {HELD_BACK})"""


def _sessions(t):
    """Events of a user as readings; every 53rd comes after all others, most of them too late."""
    path, _ = _fresh(t, "sessions")
    events = t.table("events").withColumn("rain", F.col("event_type") == "error")
    for where in (f"NOT {HELD_BACK}", HELD_BACK):
        events.where(where).write.mode("append").parquet(f"{path}_landing")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{path}_landing")
        ss.weather_sessions(stream, path, ["user_id"], "ts", {"air_temp": "value"}, "rain", gap="2 hours")
    return path


def _islands(rows):
    return f"""SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOURS
                       THEN 0 ELSE 1 END AS new FROM {rows})"""


@query("n3_weather_sessions", f"""{_LATE},
    one AS (SELECT *, max(ts) OVER (PARTITION BY user_id, i) + INTERVAL 2 HOURS AS ended FROM ({_islands('first')})),
    done AS (SELECT user_id, event_type, i, ts, value, ended FROM one, m WHERE ended <= closed),
    rest AS (SELECT event_id, user_id, event_type, ts, value FROM one, m WHERE ended > closed
             UNION ALL SELECT event_id, user_id, event_type, ts, value FROM back WHERE NOT late),
    two AS (SELECT *, max(ts) OVER (PARTITION BY user_id, i) + INTERVAL 2 HOURS AS ended FROM ({_islands('rest')})),
    every AS (SELECT 1 AS run, user_id, event_type, i, ts, value, ended FROM done
              UNION ALL SELECT 2, user_id, event_type, i, ts, value, ended FROM two
              WHERE ended <= (SELECT greatest(max(ts) - INTERVAL 6 HOURS, max(closed)) FROM rest, m))
    SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS started, CAST(max(ended) AS TIMESTAMP) AS ended, round(avg(value) + 1e-9, 6) AS air_temp,
           max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS rainfall, count(*) AS readings
    FROM every GROUP BY run, user_id, i""")
def weather_sessions(t):
    return rounded(t.spark.read.parquet(f"{_sessions(t)}/sessions"))


@query("n3_late_readings", f"""{_LATE} SELECT event_id, event_type, CAST(ts AS TIMESTAMP) AS ts, CAST(closed AS TIMESTAMP) AS closed FROM back WHERE late""")
def late_readings(t):
    return t.spark.read.parquet(f"{_sessions(t)}/late").select("event_id", "event_type", "ts", "closed")
