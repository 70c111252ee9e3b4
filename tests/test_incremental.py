"""Layers that grow, and runs that are published whole or not at all."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pitwall.operators.features import career_sums, feature_store
from pitwall.plans import incremental, publish
from pitwall.plans.pipeline import build_layers, extend_pipeline
from pitwall.sources.console import TABLES, register_lake, run_sql

YEARS = dict(first_year=1996, closed_before=2001, label_year=1995)


def rows(df, columns):
    kinds = dict(df.dtypes)
    df = df.select(*[F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def labels(bed):
    return {"champions": bed.champions, "team_champions": bed.team_champions, "births": bed.births}


@pytest.fixture(scope="module")
def grown(spark, bed, labels, tmp_path_factory):
    """Three updates: most of the history, the newest season, and one race and one corrected session out of order."""
    root = str(tmp_path_factory.mktemp("grown"))
    late = "year = 1998 AND round_number = 5 AND mode = 'Race'"
    wrong = "year = 1999 AND round_number = 2 AND mode = 'Sprint'"
    first = bed.results.where(f"year < 2001 AND NOT ({late})").withColumn(
        "points", F.when(F.expr(wrong), F.col("points") + 5).otherwise(F.col("points")))
    said = [incremental.update(spark, root, df, labels, **YEARS)
            for df in (first, bed.results.where("year = 2001"), bed.results.where(f"{late} OR {wrong}"))]
    return root, said


@pytest.fixture(scope="module")
def full(bed, labels, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("full"))
    build_layers(bed.results, labels, root, **YEARS)
    return root


@pytest.mark.parametrize("layer", TABLES)
def test_growing_gives_what_a_full_build_gives(spark, grown, full, layer):
    got, want = publish.read(spark, grown[0], layer), spark.read.parquet(f"{full}/{layer}")
    assert set(got.columns) == set(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_history_is_left_alone(spark, bed, grown):
    root, said = grown
    assert incremental.update(spark, root, bed.results.limit(0), {}) == {"first": 0, "read": 0, "version": 3}
    assert [s["first"] for s in said] == [1995, 2001, 1998] and [s["version"] for s in said] == [1, 2, 3]
    assert said[1]["read"] > 1995  # 2001 needs no season before that but the career sums
    runs = publish.current(spark, root)["fs_driver_all"]["runs"]
    assert len({runs[s] for s in runs if s < "1998"}) == 1 and len({runs[s] for s in runs if s >= "1998"}) == 1
    assert runs["1997"] != runs["1998"]
    df = publish.read(spark, root, "fs_driver_all", first=2000, before=2001)
    assert {f.split("season=")[1][:4] for f in df.inputFiles()} >= {"2000"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and df.select(F.year("dt_ref")).distinct().collect()[0][0] == 2000


@pytest.mark.parametrize("weighting", ["slot", "round"])
def test_career_sums_stand_for_the_seasons_before(spark, bed, weighting):
    results, windows = bed.results, {"life": None}
    names = [c for c in career_sums(results).columns if c not in ("driverid", "year")]
    career = career_sums(results.where("year < 1998"), weighting=weighting).groupBy("driverid").agg(
        *[F.sum(n).cast("bigint").alias(n) for n in names])
    got = feature_store(results.where("year >= 1998"), windows, weighting=weighting, career=career, since="2000-01-01")
    want = feature_store(results, windows, weighting=weighting).where("dt_ref >= DATE '2000-01-01'")
    assert rows(got, want.columns) == rows(want, want.columns)


def test_a_run_that_dies_leaves_the_former_one(spark, grown, bed, labels, monkeypatch):
    root = grown[0]
    before, counts = publish.current(spark, root), {}
    register_lake(spark, root)
    counts = {n: run_sql(spark, f"SELECT COUNT(*) AS n FROM {n}").first()["n"] for n in TABLES}
    write, done = incremental.write_layer, []

    def dies(df, path, by):
        if len(done) == 8:
            raise OSError("no space left")
        done.append(path)
        return write(df, path, by)

    monkeypatch.setattr(incremental, "write_layer", dies)
    with pytest.raises(OSError):
        incremental.update(spark, root, bed.results.where("year = 1997"), labels, **YEARS)
    assert len(done) == 8 and publish.current(spark, root) == before
    register_lake(spark, root)
    assert {n: run_sql(spark, f"SELECT COUNT(*) AS n FROM {n}").first()["n"] for n in TABLES} == counts


def test_two_runs_from_one_version_do_not_lose_each_other(spark, tmp_path):
    root = str(tmp_path)
    assert publish.current(spark, root) is None and publish.version_of(spark, root) == 0
    one = {"t": {"by": "season", "runs": {"2000": "a"}}}
    assert publish.publish(spark, root, one, 0) == 1
    with pytest.raises(RuntimeError):
        publish.publish(spark, root, {"t": {"by": "season", "runs": {}}}, 0)
    assert publish.current(spark, root) == one
    assert [f for f in os.listdir(f"{root}/published") if f.startswith("draft")] == []
    with pytest.raises(ValueError):
        publish.read(spark, root, "other")


def test_raw_files_of_three_schemas_to_published_layers(spark, bed, labels, tmp_path):
    """Files with double, whole-number and all-null columns; the second call brings a season before all that is stored."""
    raw, root = bed.raw.where("Year IN (1996, 1997)"), str(tmp_path / "lake")
    folder = str(tmp_path / "raw")
    raw.where("Year = 1996 AND RoundNumber < 6").write.parquet(f"{folder}/a")
    raw.where("Year = 1996 AND RoundNumber >= 6").withColumn("Points", F.col("Points").cast("long")).withColumn(
        "AirTemp", F.lit(None).cast("int")).write.parquet(f"{folder}/b")
    raw.where("Year = 1997").drop("Rainfall").write.parquet(f"{folder}/c")
    names = {"champions": spark.createDataFrame([(1997, "d1")], "year int, driverid string"),
             "team_champions": spark.createDataFrame([(1997, "t1")], "year int, teamid string"),
             "births": spark.createDataFrame([("d1", dt.date(1970, 1, 1))], "driverid string, date_of_birth date")}
    first = extend_pipeline(spark, [f"{folder}/c"], names, root, first_year=1996)
    then = extend_pipeline(spark, [f"{folder}/a", f"{folder}/b"], names, root, first_year=1996)
    assert (first["first"], then["first"]) == (1997, 1996) and register_lake(spark, root) == list(TABLES)
    seasons = {r["year"]: r["n"] for r in run_sql(spark, "SELECT year, COUNT(*) AS n FROM results GROUP BY year").collect()}
    assert set(seasons) == {1996, 1997} and min(seasons.values()) > 50
    assert run_sql(spark, "SELECT DISTINCT season FROM fs_driver_all ORDER BY 1").collect()[-1]["season"] == 1997
    whole = str(tmp_path / "whole")
    from pitwall.plans.pipeline import run_pipeline
    run_pipeline(spark, [folder], names, whole, first_year=1996)
    for layer in ("results", "fs_driver_last10", "abt_champions_inseason", "abt_teams"):
        want = spark.read.parquet(f"{whole}/{layer}")
        assert rows(publish.read(spark, root, layer), sorted(want.columns)) == rows(want, sorted(want.columns)), layer
