"""The catalogue of session files."""

import os

import pytest
from pyspark.sql import functions as F

from pitwall.sources import catalogue as cat
from pitwall.sources.sessions import RAW_SCHEMA, scan_sessions


@pytest.fixture
def folder(spark, bed, tmp_path):
    """Sessions of two seasons, one file a season and schema."""
    raw, path = bed.raw, str(tmp_path / "raw")
    raw.where("Year = 1996").coalesce(1).write.parquet(f"{path}/1996")
    raw.where("Year = 1997").withColumn("Points", F.col("Points").cast("long")).coalesce(1).write.parquet(f"{path}/1997")
    return path


def parquet_files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_a_second_scan_opens_no_old_footer(spark, bed, folder, tmp_path, monkeypatch):
    table = str(tmp_path / "catalogue")
    assert cat.refresh(spark, [folder], table) == {"files": 2, "opened": 2}
    files = cat.catalogue(spark, [folder], table)
    want = {r["Year"]: (r["n"], r["a"], r["b"]) for r in bed.raw.where("Year IN (1996, 1997)").groupBy("Year").agg(
        F.count(F.lit(1)).alias("n"), F.to_date(F.min("Date")).alias("a"), F.to_date(F.max("Date")).alias("b")).collect()}
    got = {(r["n_rows"], r["first_day"], r["last_day"]) for r in files.collect()}
    assert len({r["kind"] for r in files.collect()}) == 2
    days = {y: (n, str(a)[:7], str(b)[:7]) for y, (n, a, b) in want.items()}
    assert {(n, str(a)[:7], str(b)[:7]) for n, a, b in got if a} <= set(days.values()) and {n for n, *_ in got} == {n for n, *_ in days.values()}

    def never(*_):
        raise AssertionError("a footer was opened")

    with monkeypatch.context() as m:
        m.setattr(cat, "_described", never)
        assert cat.refresh(spark, [folder], table) == {"files": 2, "opened": 0}
        assert cat.scan(spark, cat.catalogue(spark, [folder], table)).count() == sum(n for n, *_ in want.values())
    bed.raw.where("Year = 1998").coalesce(1).write.parquet(f"{folder}/1998")
    assert cat.refresh(spark, [folder], table) == {"files": 3, "opened": 1}
    assert scan_sessions(spark, [folder], table).select("Year").distinct().count() == 3


def test_changed_and_missing_files(spark, bed, folder, tmp_path):
    table = str(tmp_path / "catalogue")
    cat.refresh(spark, [folder], table)
    one = parquet_files(f"{folder}/1996")[0]
    n = spark.read.parquet(one).count()
    bed.raw.where("Year = 1996").limit(n - 3).coalesce(1).write.parquet(f"{folder}-other")
    os.replace(parquet_files(f"{folder}-other")[0], one)  # the same name, other rows
    crc = os.path.join(os.path.dirname(one), f".{os.path.basename(one)}.crc")
    if os.path.exists(crc):
        os.replace(crc, f"{folder}-crc")
    os.utime(one, (2_000_000_000, 2_000_000_000))
    assert cat.refresh(spark, [folder], table)["opened"] == 1
    rows = {r["file"].split("/")[-2]: r["n_rows"] for r in cat.catalogue(spark, [folder], table).collect()}
    assert rows["1996"] == n - 3 and len(rows) == 2
    assert [r["n_rows"] for r in cat.catalogue(spark, [f"{folder}/1996"], table).collect()] == [n - 3]


def test_days_outside_are_not_named_to_a_scan(spark, folder, tmp_path):
    table = str(tmp_path / "catalogue")
    cat.refresh(spark, [folder], table)
    files = cat.catalogue(spark, [folder], table)
    assert files.where("first_day IS NOT NULL").count() == 2
    early = cat.scan(spark, files, last_day="1996-12-31")
    assert {os.path.basename(os.path.dirname(f)) for f in early.inputFiles()} == {"1996"}
    assert cat.scan(spark, files, first_day="1996-06-01").select("Year").distinct().count() == 2
    with pytest.raises(ValueError, match=cat.EMPTY):
        cat.scan(spark, files, first_day="2050-01-01")


def test_empty_input_and_many_scans(spark, folder, tmp_path, monkeypatch):
    empty = tmp_path / "empty"
    empty.mkdir()
    for folders in ([], [str(empty)]):
        with pytest.raises(ValueError, match=cat.EMPTY):
            scan_sessions(spark, folders)
    whole = scan_sessions(spark, [folder])
    assert [f.name for f in whole.schema.fields] == RAW_SCHEMA.names
    monkeypatch.setattr(cat, "AT_ONCE", 1)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, scan_sessions(spark, [folder]).collect()))


def test_a_large_file_is_not_taken_whole(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(cat, "LARGEST", 10)
    table = str(tmp_path / "catalogue")
    assert cat.refresh(spark, [folder], table) == {"files": 2, "opened": 2}
    files = cat.catalogue(spark, [folder], table)
    assert files.where("n_rows IS NULL AND first_day IS NULL").count() == 2
    assert cat.scan(spark, files, first_day="2050-01-01").select("Year").distinct().count() == 2
