"""Both paths of size-dependent operators, NULL keys and values, and sums beyond 64 bits."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from pitwall.functions import scalars as fn
from pitwall.operators import evaluation as ev, ordering
from pitwall.operators.features import feature_store
from pitwall.sources.console import run_sql
from pitwall.streaming.ingest import keep_newest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.0, 2.5, -3.0, float(rng.randint(0, 50))])) for i in range(400)]
    return spark.createDataFrame(rows, "id int, g string, v double").repartition(5).cache()


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_is_the_same_beyond_the_limit(scores, by, descending):
    small, large = (ordering.rank(scores, by, "v", "r", descending, limit=n) for n in (10_000, 20))
    assert rows_of(small) == rows_of(large) and small.count() == 400
    assert large.where("v IS NULL").agg(F.min("r")).first()[0] > large.where("v IS NOT NULL").agg(F.min("r")).first()[0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_is_the_same_beyond_the_limit(scores, by):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    sums = {"n": F.lit(1).cast("bigint"), "total": F.col("v")}
    small, large = (ordering.running(scores, by, order, sums, n) for n in (10_000, 20))
    keep = [F.col("id"), F.col("n"), F.round("total", 6).alias("total")]
    assert rows_of(small.select(*keep)) == rows_of(large.select(*keep))
    small, large = (ordering.row_number(scores, by, order, "n", n) for n in (10_000, 20))
    assert rows_of(small) == rows_of(large) and large.count() == 400


def test_quantiles_are_the_same_beyond_the_limit(scores):
    probs = {"q1": 0.25, "mid": 0.5}
    small, large = (ordering.quantiles(scores, ["g"], "v", "id", probs, n) for n in (10_000, 20))
    assert rows_of(small) == rows_of(large) and small.count() == 4


def test_old_history_counts_in_own_windows(spark):
    from pitwall.sources.testbed import Testbed
    results = Testbed(spark, "/root/testdata/sf0.001").results
    years = F.col("year") - F.when(F.col("year") == F.lit(results.agg(F.min("year")).first()[0]), 30).otherwise(0)
    old = results.withColumn("event_date", F.when(years < F.col("year"), F.col("event_date") - F.expr("INTERVAL 30 YEARS")).otherwise(
        F.col("event_date")).cast("date"))
    first = old.agg(F.min("event_date")).first()[0]
    old = old.withColumn("mode", F.when(F.col("event_date") < first + dt.timedelta(days=400), "Qualifying").otherwise(F.col("mode")))
    store = feature_store(old, {"life": None}, scope="entity").alias("s")
    past = old.select("driverid", "event_date")
    want = store.join(past, "driverid").where("event_date < dt_ref").groupBy("dt_ref", "driverid").agg(F.count(F.lit(1)).alias("n"))
    off = store.join(want, ["dt_ref", "driverid"]).where("n != qtd_sessions_life")
    assert off.count() == 0 and store.count() > 0


def test_newest_rows_of_the_null_partition_stay(spark, tmp_path):
    schema = "k int, at int, part string"
    path, source = str(tmp_path / "table"), tmp_path / "in"
    for n, rows in enumerate(([(1, 1, None), (2, 1, "a")], [(3, 2, None), (4, 2, "b"), (2, 3, "a")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        keep_newest(stream, path, str(tmp_path / "check"), ["k"], "at", "part").awaitTermination()
    got = spark.read.schema(schema).parquet(path)
    assert rows_of(got.select("k", "at")) == [(1, 1), (2, 3), (3, 2), (4, 2)]


def test_late_dates_threshold_is_a_parameter(spark):
    days = spark.createDataFrame([(dt.date(2000, 1, d),) for d in range(1, 8)], "dt_ref date")
    assert ev.late_dates(days, 8).count() == 7
    assert ev.late_dates(days, 3, longer_than=7).count() == 0


def test_console_cap(spark):
    spark.range(3000).withColumnRenamed("id", "credit_limit").createOrReplaceTempView("limits")
    assert run_sql(spark, "SELECT credit_limit FROM limits").count() == 1000
    assert run_sql(spark, "SELECT credit_limit FROM limits LIMIT 1500;").count() == 1500
    assert run_sql(spark, "WITH x AS (SELECT * FROM limits) SELECT * FROM x ORDER BY 1 LIMIT 2").count() == 2


def test_large_class_counts(spark):
    points = spark.createDataFrame([(0.9, 1, 4_000_000_000), (0.1, 0, 4_000_000_000)], "p double, y int, n bigint")
    per = points.select("p", F.expr("y * n").alias("pos"), F.expr("(1 - y) * n").alias("neg"))
    keep, ev._by_score = ev._by_score, lambda *a: per
    try:
        out = ev.ranking_metrics(points, "y", "p").first()
    finally:
        ev._by_score = keep
    assert (out["roc_auc"], out["pr_auc"]) == (1.0, 1.0)


def test_many_sessions_of_one_entrant(spark):
    from pitwall.functions.metrics import METRICS
    m = next(x for x in METRICS if x.name == "avg_air_temp")
    parts = m.partials({"air_temp"})
    rows = spark.range(5_000_000).select((F.rand(3) * 40).alias("air_temp"))
    got = rows.agg(*[F.expr(e).alias(n) for n, e in parts.items()]).selectExpr(f"{m.total(lambda n: n, {'air_temp'})} AS mean")
    assert got.first()["mean"] == pytest.approx(rows.agg(F.avg("air_temp")).first()[0], rel=1e-12)


def test_clock_texts(spark):
    ns = [None, 0, 1_000_000, 59_999_400_000, 59_999_600_000, 61_234_567_890, 3_723_004_500_001]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(ns)], "i int, ns bigint").select(
        "i", fn.lap_time("ns").alias("lap"), fn.race_time("ns", F.lit(True)).alias("win"), fn.race_time("ns", F.lit(False)).alias("gap"))
    assert [tuple(r)[1:] for r in rows.orderBy("i").collect()] == [
        ("", "", ""), ("", "", ""), ("0.001", "0:00:00.001", "+0.001s"), ("59.999", "0:00:59.999", "+59.999s"),
        ("1:00.000", "0:01:00.000", "+60.000s"), ("1:01.235", "0:01:01.235", "+61.235s"), ("62:03.005", "1:02:03.005", "+3723.005s")]


def test_colors(spark):
    rows = spark.createDataFrame([("Ferrari", None), ("Ferrari", " FF0000 "), ("None", "nan"), ("McLaren", ""), ("x", "#ABC")], "t string, c string")
    got = [r[0] for r in rows.select(fn.team_color("t", "c")).collect()]
    assert got == ["#E8002D", "#ff0000", "#999999", "#FF8000", "#abc"]




def test_one_season_is_read_from_one_folder(spark, bed):
    from pitwall.operators.forecast import points_signal, team_signal
    from pitwall.plans.explore import season_of
    for name in ("abt_champions_inseason", "abt_departures_inseason"):
        table = bed.by_season(name)
        one = season_of(table, 1999)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(season" in plan and "= 1999)" in plan
        assert one.count() == table.where(F.year("dt_ref") == 1999).count() > 0
    results = bed.results
    for signal in (points_signal, team_signal):
        plan = signal(bed.features, results, 1999)._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"\(year#\d+ = 1999\)", plan) and re.search(r"\(event_date#\d+ >= 1999-01-01\)", plan)
        assert "year(event_date" not in plan


def test_a_merge_reads_the_folders_it_rewrites(spark, tmp_path):
    """Rows of other partitions, garbled on purpose, are not even opened."""
    schema, src, out = "k long, at long, day int", str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep_newest(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "state"), ["k"], "at", "day").awaitTermination()

    run([(1, 10, 1), (2, 10, 2), (3, 10, None)])
    for f in (tmp_path / "out" / "day=2").iterdir():
        if f.suffix == ".parquet":
            f.write_bytes(b"no parquet")
    run([(1, 11, 1), (4, 1, None), (5, 1, 3)])
    got = spark.read.schema(schema).parquet(out).where("day <> 2 OR day IS NULL")
    assert rows_of(got.select("k", "at", "day")) == sorted([(1, 11, 1), (3, 10, None), (4, 1, None), (5, 1, 3)], key=repr)
