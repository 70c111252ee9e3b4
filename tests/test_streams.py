"""Streams: late readings, early rounds and what is left of a run that died."""

import pytest
from pyspark.sql import functions as F

from pitwall.streaming import sessions as ss

READING = "track string, at timestamp, temp double, wet boolean"


def add(spark, path, rows, schema, cast=True):
    """One more file; times are texts."""
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, ", ".join(f"{c.split()[0]} {c.split()[1] if c.split()[1] != 'timestamp' else 'string'}" for c in schema.split(", ")))
    df.select(*[F.col(n).cast(c.split()[1]) for n, c in zip(names, schema.split(", "))]).coalesce(1).write.mode("append").parquet(path)


def replay(spark, tmp, rows):
    add(spark, f"{tmp}/in", rows, READING)
    stream = spark.readStream.schema(READING).parquet(f"{tmp}/in")
    return ss.weather_sessions(stream, f"{tmp}/out", ["track"], "at", {"temp": "temp"}, "wet", "30 minutes", "6 hours")


def table(spark, path, *cols):
    return sorted(tuple(map(str, r)) for r in spark.read.parquet(path).select(*cols).collect())


def test_a_row_inside_the_lateness_counts_and_one_outside_is_kept_apart(spark, tmp_path):
    tmp = str(tmp_path)
    day = "2024-05-01 "
    assert replay(spark, tmp, [("a", day + "08:00:00", 20.0, False), ("a", day + "08:20:00", 22.0, False),
                               ("b", day + "12:00:00", 10.0, False)]) == {"late": 0, "dropped": 0}
    # the newest reading was at 12:00, so sessions that end at 6:00 or before are closed
    got = replay(spark, tmp, [("a", day + "08:40:00", 27.0, True), ("a", day + "05:45:00", 5.0, False),
                              ("a", day + "05:30:00", 1.0, False), ("a", day + "04:00:00", 2.0, True), ("a", None, 3.0, True)])
    assert got == {"late": 3, "dropped": 0}
    assert table(spark, f"{tmp}/out/late", "track", "at", "temp", "closed") == sorted([
        ("a", day + "05:30:00", "1.0", day + "06:00:00"), ("a", day + "04:00:00", "2.0", day + "06:00:00"),
        ("a", "None", "3.0", day + "06:00:00")])
    assert replay(spark, tmp, [("b", day + "23:00:00", 0.0, False)]) == {"late": 3, "dropped": 0}
    columns = "track", "started", "ended", "temp", "rainfall", "readings"
    assert table(spark, f"{tmp}/out/sessions", *columns) == sorted([
        ("a", day + "05:45:00", day + "06:15:00", "5.0", "0", "1"),
        ("a", day + "08:00:00", day + "09:10:00", "23.0", "1", "3"),
        ("b", day + "12:00:00", day + "12:30:00", "10.0", "0", "1")])


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    tmp = str(tmp_path)
    add(spark, f"{tmp}/in", [("a", "2024-05-01 08:00:00", 1.0, False)], READING)
    for state in ("one", "two"):  # fresh state: batch 0 comes again
        stream = spark.readStream.schema(READING).parquet(f"{tmp}/in")
        ss.split_late(stream, "at", f"{tmp}/on_time", f"{tmp}/late", f"{tmp}/{state}").awaitTermination()
    assert spark.read.parquet(f"{tmp}/on_time").count() == 1 and spark.read.schema(READING).parquet(f"{tmp}/late").count() == 0


ROUND = "season int, number int, mode string, points double"


def release(spark, tmp, rows=()):
    if rows:
        add(spark, f"{tmp}/in", list(rows), ROUND)
    stream = spark.readStream.schema(ROUND).parquet(f"{tmp}/in")
    ss.release_in_order(stream, f"{tmp}/out", f"{tmp}/state", "season", "number", F.col("mode") == "Race").awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(ROUND).parquet(f"{tmp}/out").where("season = 2024").select("number", "mode", "points").collect())


def test_a_season_stops_at_its_first_missing_round(spark, tmp_path):
    tmp = str(tmp_path)
    provider = spark.conf.get(ss.PROVIDER)
    start = [(2024, n, "Race", float(n)) for n in (1, 2, 4)]
    assert release(spark, tmp, start + [(2024, 3, "Sprint", 0.5), (2023, 2, "Race", 1.0), (None, 1, "Race", 1.0), (2024, None, "Race", 1.0)]) == [
        (1, "Race", 1.0), (2, "Race", 2.0)]
    assert len(release(spark, tmp)) == 2  # nothing new
    assert release(spark, tmp, [(2024, 3, "Race", None)]) == [
        (1, "Race", 1.0), (2, "Race", 2.0), (3, "Race", None), (3, "Sprint", 0.5), (4, "Race", 4.0)]
    assert (2, "Sprint", 7.0) in release(spark, tmp, [(2024, 2, "Sprint", 7.0), (2024, 2, "Sprint", 7.0), (2024, 6, "Race", 6.0)])
    assert spark.read.parquet(f"{tmp}/out").where("season = 2023 OR number = 6").count() == 0
    assert spark.conf.get(ss.PROVIDER) == provider


@pytest.mark.parametrize("order", [(5, 4, 3, 2, 1), (3, 1, 5, 2, 4)])
def test_rounds_come_out_whatever_their_order(spark, tmp_path, order):
    for i in range(1, len(order) + 1):
        there, missing = set(order[:i]), 1
        while missing in there:
            missing += 1
        assert [r[0] for r in release(spark, str(tmp_path), [(2024, order[i - 1], "Race", 1.0)])] == list(range(1, missing))
