"""Edge cases and properties of the operators."""

import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import Window as W, functions as F

from check import canon, frame
from pitwall.catalog.oracle import _STEPS, metric_sql, sql
from pitwall.functions import scalars as fn
from pitwall.operators import evaluation as ev, forecast as fc, ordering, standings as st
from pitwall.operators.features import feature_store, recent_slots
from pitwall.plans import explore as ex

RESULTS = ("driverid long, teamid long, year int, round_number int, mode string, event_date date, points double, "
           "position int, grid_position int, is_finished int, air_temp double, track_temp double, humidity double, "
           "pressure double, wind_speed double, rainfall int")


def random_results(seed, drivers=7, days=60):
    """Rounds with several dates, dates apart and interleaved, gaps and NULLs."""
    rnd = random.Random(seed)
    rows, seen = [], set()
    first = date(2001, 1, 1)
    for n in range(days):
        day = first + timedelta(days=n * 31)
        round_number = rnd.choice([day.month, max(1, day.month - 1), max(1, day.month - 4)])
        for mode in rnd.sample(["Race", "Sprint", "Qualifying"], rnd.choice([1, 2])):
            for d in range(drivers):
                if rnd.random() < (0.35 if d % 3 else 0.8) and (d, day, mode) not in seen:
                    seen.add((d, day, mode))
                    temp = None if rnd.random() < 0.3 else rnd.uniform(10, 40)
                    place = None if rnd.random() < 0.2 else rnd.randint(1, 12)
                    rows.append((d, d % 3, day.year, round_number, mode, day, rnd.choice([0.0, 1.5, 25.0]), place,
                                 rnd.randint(1, 12), rnd.randint(0, 1), temp, temp, temp, 1000.1, 0.1, rnd.randint(0, 1)))
    return rows


def brute_force(rows, n, suffix, once=False):
    con = duckdb.connect()
    cols = ", ".join(c.strip().replace("long", "bigint").replace("string", "varchar") for c in RESULTS.split(","))
    con.execute(f"CREATE TABLE results ({cols})")
    con.executemany(f"INSERT INTO results VALUES ({', '.join('?' * 16)})", rows)
    text = sql(f"""
        SELECT p.dt_ref, p.driverid, {metric_sql(suffix).replace('AS BIGINT)', 'AS DOUBLE)')}
        FROM past p JOIN still_active USING (dt_ref, driverid)
        JOIN (SELECT {'DISTINCT' if once else ''} dt_ref, year, round_number FROM slots_back WHERE back <= {n}) w
        USING (dt_ref, year, round_number) GROUP BY p.dt_ref, p.driverid""", "past", "still_active", "slots_back")
    start = text.index("scored AS MATERIALIZED")
    cur = con.execute("WITH " + text[start:])
    return frame(cur.fetchall(), [d[0] for d in cur.description])


@pytest.mark.parametrize("seed,n,once", [(1, 1, False), (2, 3, False), (3, 10, False), (4, 2, True), (5, 9999, False)])
def test_feature_store_on_irregular_calendars(spark, seed, n, once):
    rows = random_results(seed)
    df = spark.createDataFrame(rows, RESULTS)
    got = feature_store(df, {"x": n}, weighting="round" if once else "slot")
    got = frame([tuple(r) for r in got.collect()], got.columns)
    want = brute_force(rows, n, "x", once)
    assert list(got.columns) == list(want.columns)

    def near(f):
        return canon(f.map(lambda v: round(float(v), 7) if isinstance(v, (int, float)) and v == v else v))
    assert near(got) == near(want)


def test_later_rows_never_change_earlier_features(spark):
    rows = random_results(11)
    cut = rows[len(rows) // 2][5]
    some = feature_store(spark.createDataFrame([r for r in rows if r[5] <= cut], RESULTS), {"a": None, "b": 5})
    full = feature_store(spark.createDataFrame(rows, RESULTS), {"a": None, "b": 5}).where(F.col("dt_ref") <= F.lit(cut))
    assert canon(frame([tuple(r) for r in some.collect()], some.columns)) == canon(
        frame([tuple(r) for r in full.collect()], full.columns))


def test_counts_grow_with_the_window(bed):
    f = bed.features
    bad = f.where("qtd_sessions_last10 > qtd_sessions_last20 OR qtd_sessions_last20 > qtd_sessions_last40 "
                  "OR qtd_sessions_last40 > qtd_sessions_life OR qtd_wins_last10 > qtd_wins_life")
    assert bad.count() == 0 and f.count() > 0


def test_recent_slots_are_at_most_n(bed):
    assert recent_slots(bed.results, 10).groupBy("dt_ref").count().agg(F.max("count")).first()[0] == 10


# -- large groups take another way and give the same ----------------------------
@pytest.fixture(scope="module")
def crowd(spark):
    # One group holds most rows, and a third of all rows share one value.
    return spark.range(3000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 37 % 101).cast("long").alias("v")).cache()


def same(a, b):
    return canon(frame([tuple(r) for r in a.collect()], a.columns)) == canon(frame([tuple(r) for r in b.collect()], b.columns))


@pytest.mark.parametrize("by", [["g"], []])
def test_running_sum_is_the_same_when_split(crowd, by):
    order = [-F.col("v"), F.col("k")]
    plain = ordering.running(crowd, by, order, {"s": F.col("v")})
    parted = ordering.running(crowd, by, order, {"s": F.col("v")}, limit=100)
    assert "__b" not in parted.columns and same(plain, parted)


def test_row_number_and_rank_are_the_same_when_split(crowd):
    w = W.partitionBy("g").orderBy(F.col("v").desc(), "k")
    assert same(crowd.withColumn("n", F.row_number().over(w)),
                ordering.row_number(crowd, ["g"], [-F.col("v"), F.col("k")], "n", limit=100))
    r = W.partitionBy("g").orderBy(F.col("v").desc())
    want = crowd.withColumn("r", F.rank().over(r))
    assert same(want, ordering.rank(crowd, ["g"], "v", "r").select(want.columns))
    assert same(want, ordering.rank(crowd, ["g"], "v", "r", limit=20).select(want.columns))


def test_quantiles_are_exact_when_split(crowd):
    want = crowd.groupBy("g").agg(F.expr("percentile(v, 0.25)").alias("q"), F.expr("percentile(v, 0.5)").alias("m"))
    for limit in (None, 100):
        assert same(want, ordering.quantiles(crowd, ["g"], "v", "k", {"q": 0.25, "m": 0.5}, limit=limit))


def test_auc_is_the_same_when_split(crowd):
    scored = crowd.select((F.col("k") % 7 == 0).cast("int").alias("y"), (F.col("v") / 101).alias("p"))
    assert same(ev.ranking_metrics(scored, "y", "p").select(F.round("roc_auc", 9), F.round("pr_auc", 9)),
                ev.ranking_metrics(scored, "y", "p", limit=10).select(F.round("roc_auc", 9), F.round("pr_auc", 9)))


# -- literal cases ------------------------------------------------------------
def test_safe_casts(spark):
    df = spark.createDataFrame([("nan",), ("",), ("+1 Lap",), ("3.7",), ("2.5",)], "s string")
    assert [r[0] for r in df.select(fn.whole("s", text=True)).collect()] == [None, None, None, 4, 3]
    nums = spark.createDataFrame([(2.5,), (3.5,), (-0.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in nums.select(fn.whole("x")).collect()] == [2, 4, 0, None, None]


def table(spark, rows):
    df = spark.createDataFrame([(2020, date(2020, 1, d), k, p, p) for d, k, p in rows],
                               "year int, dt_ref date, driverid string, points long, cum_points long")
    return df


def test_tie_for_first_and_single_entrant(spark):
    tie = table(spark, [(1, "a", 10), (1, "b", 10), (1, "c", 3)])
    assert [r["standing_position"] for r in st.standings(tie, "driverid").orderBy("driverid").collect()] == [1, 1, 3]
    row = st.leader_gap(tie, "driverid").first()
    assert (row["leader_gap"], row["leader"]) == (0, "a")
    alone = st.leader_gap(table(spark, [(1, "a", 10)]), "driverid").first()
    assert alone["leader_gap"] is None and alone["leader"] == "a"


def test_share_of_a_leader_without_points_is_null(spark):
    row = st.standings(table(spark, [(1, "a", 0), (1, "b", 0)]), "driverid").first()
    assert row["points_pct_of_leader"] is None and row["points_gap_to_leader"] == 0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {(r[0], r[1]): r[2] for r in ex.correlations(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and abs(got[("a", "a")] - 1) < 1e-12


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, p double")
    assert tuple(ev.ranking_metrics(df, "y", "p").first()) == (None, None)


def test_short_series_is_padded_with_its_first_value(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 4.0)], "e string, dt_ref date, x double")
    assert fc.contexts(df, "e", "x").first()["context"] == [4.0] * 32


def test_fold_years():
    assert ev.fold_years([2000, 2001, 2002, 2003], 5) == [2001, 2002, 2003]
    assert ev.fold_years(list(range(2000, 2010)), 5) == [2005, 2006, 2007, 2008, 2009]


def test_texts(spark):
    one = spark.range(1)
    got = one.select(
        fn.lap_time(F.lit(83_456_000_000)), fn.lap_time(F.lit(0)), fn.race_time(F.lit(5_400_250_000_000), F.lit(True)),
        fn.race_time(F.lit(2_740_000_000), F.lit(False)), fn.signed(F.lit(-3)), fn.signed(F.lit(None).cast("int")),
        fn.hex_color(F.lit(" FF8000 ")), fn.team_color(F.lit("Ferrari"), F.lit(None).cast("string")),
        fn.risk_label(F.lit("High"), F.lit(0.625))).first()
    assert tuple(got) == ("1:23.456", "", "1:30:00.250", "+2.740s", "-3", "", "#ff8000", "#E8002D", "🔴 High (62.5%)")


def test_landing_twice_replaces_only_that_session(spark, bed, tmp_path):
    from pitwall.sources import sessions as src
    path = str(tmp_path / "raw")
    src.land_session(bed.raw, path)
    n = spark.read.parquet(path).count()
    src.land_session(bed.raw.where("Year = 1999 AND RoundNumber = 3"), path)
    assert spark.read.parquet(path).count() == n


def test_streaming_merge_keeps_newer_rows(spark, tmp_path):
    from pitwall.streaming import ingest as sg
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, at long, day int"
    def add(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
    add("one", [(1, 10, 1), (2, 10, 1), (3, 10, 2)])
    for name, rows in (("two", [(1, 9, 1), (2, 11, 1)]), (None, None)):
        stream = spark.readStream.schema(schema).parquet(f"{src}/*")
        sg.keep_newest(stream, out, str(tmp_path / "state"), ["k"], "at", "day").awaitTermination()
        if name:
            add(name, rows)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("k", "at", "day").collect())
    assert got == [(1, 10, 1), (2, 11, 1), (3, 10, 2)]


def test_search_settings_are_repeatable():
    from pitwall.plans import training as tr
    space = tr.CANDIDATES["GradientBoosting"].space
    assert tr.draws(space, 3) == tr.draws(space, 3)
    assert all(60 <= d["maxIter"] <= 80 for d in tr.draws(space, 9, overrides={"maxIter": ("int", 60, 80, 10)}))


def test_feature_selector_drops_long_windows_and_weak_sprint_columns():
    from pitwall.plans.training import feature_columns
    cols = ["dt_ref", "driverid", "qtd_wins_last20", "avg_grid_sprint_life", "qtd_wins_sprint_life", "qtd_wins_life"]
    assert feature_columns(cols) == ["qtd_wins_sprint_life", "qtd_wins_life"]


def test_some_columns_of_a_layer_are_those_of_the_whole(spark, bed):
    """Worked out alone, without the whole layer, and joined with another store."""
    from pitwall.operators.features import WINDOWS, driver_window
    keys, wanted = ["dt_ref", "driverid"], ["qtd_seasons_life", "qtd_wins_last10", "avg_position_last40", "avg_air_temp_last20"]
    some = feature_store(bed.results, WINDOWS, columns=wanted)
    assert sorted(some.columns) == sorted(keys + wanted)
    whole = feature_store(bed.results, WINDOWS).select(*keys, *wanted)
    assert some.count() == whole.count() > 0
    assert some.select(*keys, *wanted).exceptAll(whole).count() == 0
    joined = driver_window(bed.results, None, "life").select(*keys, "qtd_wins_life").join(some, keys)
    assert joined.count() == some.count()


def test_narrow_base_tables_leave_the_wide_ones_unbuilt(spark, tmp_path):
    """Base tables of few columns: the same rows, and neither the wide features nor the wide table is written."""
    import os
    from pitwall.sources.testbed import Testbed
    folder = tmp_path / "tables"
    os.symlink("/root/testdata/sf0.001", folder)
    t = Testbed(spark, str(folder))
    asked = {"abt_champions_inseason": ["dt_ref", "driverid", "fl_champion", "pct_leader_x_wins"],
             "abt_teams_inseason": ["dt_ref", "teamid", "sum_points_last10"],
             "abt_departures_inseason": ["dt_ref", "driverid", "fl_departed", "seasons_since_last_win", "trend_win_rate"],
             "abt_champions": ["dt_ref", "driverid", "fl_champion"], "abt_teams": ["dt_ref", "teamid", "avg_wins_life"],
             "abt_departures": ["dt_ref", "driverid", "fl_departed"]}
    narrow = {name: t.only(name, *cols) for name, cols in asked.items()}
    assert not any(t.lake.has(name) for name in ("features", *asked))
    for name, cols in asked.items():
        whole = getattr(t, name).select(*cols)
        assert narrow[name].count() == whole.count() > 0
        assert narrow[name].exceptAll(whole).count() == 0


def test_features_meet_the_roster_without_a_broadcast(spark):
    """Three columns compress so well that their files look small enough for the driver at any number of rows."""
    from pitwall.catalog import QUERIES, load_all
    load_all()
    plan = QUERIES["j11_features_to_roster"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_queries_of_few_columns_leave_the_wide_layers_unbuilt(spark, tmp_path):
    import os
    from pitwall.catalog import QUERIES, load_all
    from pitwall.sources.testbed import Testbed
    load_all()
    folder = tmp_path / "tables"
    os.symlink("/root/testdata/sf0.001", folder)
    for name in ("b14_feature_selector", "q20_departed_trends", "b16_metric_group_columns", "q17_team_interactions", "q10_latest_top5",
                 "s10_abt_with_clinch", "q11_positive_sample", "w1_latest_per_key", "q16_team_standings_by_race"):
        QUERIES[name](spark, str(folder)).schema
    lake = Testbed(spark, str(folder)).lake
    assert not any(lake.has(n) for n in ("features", "abt_champions", "abt_teams_inseason", "abt_departures"))


def test_an_entrants_rows_meet_in_parts_of_any_size(spark, bed):
    """Sessions in many parts, the dates asked for in few: every entrant's rows still come together."""
    wanted = ["qtd_seasons_life", "qtd_wins_last10", "avg_position_last40"]
    whole = [tuple(r) for r in feature_store(bed.results, columns=wanted).collect()]
    parts = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "30k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in parts}
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        dealt = [tuple(r) for r in feature_store(bed.results, columns=wanted).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(whole) > 0 and sorted(whole, key=str) == sorted(dealt, key=str)


def test_the_last_entrant_of_a_batch_goes_on_in_the_next():
    """Batches of any size and entrants of any length: the same changes; a date asked for twice has two rows."""
    import datetime as dt
    import pyarrow as pa
    from pitwall.operators.features import _changes
    day = [dt.date(1998, 12, 1) + dt.timedelta(days=i) for i in range(60)]
    schema = pa.schema([("e", pa.int64()), ("year", pa.int32()), ("dates", pa.list_(pa.date32())), ("c_qtd_sessions", pa.int64()),
                        ("marks", pa.list_(pa.struct([("at", pa.date32()), ("w_a", pa.int32())])))])
    rows = [{"e": e, "year": day[i].year, "c_qtd_sessions": 1 + i % 2, "marks": [{"at": day[i + 1], "w_a": 1}, {"at": day[i + 9], "w_a": -1}]}
            for e in (1, None, 3) for i in range(0, 50, e or 7)]
    rows = [x for e in (1, None, 3) for x in [*[r for r in rows if r["e"] == e], {"e": e, "dates": [day[20], day[20], *day[40:45]]}]]
    table, run = pa.Table.from_pylist(rows, schema), _changes("e", {"a": ["c_qtd_sessions"]}, ["a"])
    whole = pa.Table.from_batches(run(iter(table.to_batches()))).to_pylist()
    for size in (1, 5, 51):
        assert pa.Table.from_batches(run(iter(table.to_batches(max_chunksize=size)))).to_pylist() == whole
    first = [r for r in whole if r["e"] == 1]
    assert [(r["at"], r["is_row"]) for r in first[:3]] == [(day[20], 1), (day[20], 2), (day[40], 1)]
    inside = [sum(1 + i % 2 for i in range(50) if i + 1 <= d < i + 9) for d in (20, 40)]
    assert first[0]["v_a_c_qtd_sessions"] == inside[0] and first[1]["v_a_c_qtd_sessions"] == 0
    assert sum(r["v_a_c_qtd_sessions"] for r in first[:3]) == inside[1]


@pytest.mark.parametrize("columns", [None, ["qtd_seasons_life", "qtd_wins_last10", "avg_position_last40"], ["total_points_last20"]])
@pytest.mark.parametrize("carried", [False, True])
def test_running_sums_read_what_the_shuffle_hands_over(spark, bed, columns, carried):
    """Nothing rebuilds the wide rows between the shuffle by entrant and the running sums."""
    from pitwall.operators.features import career_sums
    career = career_sums(bed.results.where("year = 1997")).drop("year") if carried else None
    store = feature_store(bed.results.where("year >= 1998") if carried else bed.results, career=career, columns=columns)
    plan = [line.lstrip(" :+-") for line in store._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    at = next(i for i, line in enumerate(plan) if line.startswith("Window [sum(v_"))
    assert plan[at + 1].startswith("RepartitionByExpression"), plan[at + 1][:200]
