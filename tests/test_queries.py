"""Registered queries against their SQL on the smallest tables; check.py runs all."""

import duckdb
import pytest

from check import TABLES, canon, frame
from conftest import SF

NAMES = """
a5_land_session a6_land_new a8_session_weather b2_safe_cast p1_build_results p2_driver_window_last10
p2_round_weighting_last10 p2_own_rounds_last10 p4_feature_store_all w2_recent_rounds j1_past_sessions
t1_abt_champions t2_abt_teams t3_abt_champions_inseason t4_abt_teams_inseason t5_abt_departures
t6_abt_departures_inseason t7_driver_standings t8_team_momentum t9_teammate_gap_fanout_transfers
t9_teammate_gap_last_team_transfers t10_tenure_transfers t11_career_teams_inseason t13_departure_label_open
t14_driver_clinch s6_standings_before_event s7_standings_carried_forward w8_team_leader_gap j13_team_remaining_points
q3_dnf_rate q12_class_balance q22_explorer_teams q26_points_distribution q32_current_standings q34_race_result_table
q35_top1_evolution x9_team_color x10_lap_time x11_race_time x14_risk_tier x20_softmax x23_year_list
l2_split_late_removed l3_expanding_folds l9_class_weights l9_border_rows l9_rebalanced m6_smoothed_trend l10_roc_auc l11_pr_auc l12_curve_points l14_confusion_matrix
l24_grouped_holdout m4_trailing_context m6_one_step_forecast n1_ingest_stream n1_rounds_in_order n2_latest_per_key_stream n3_weather_stream n3_weather_sessions n3_late_readings
""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, SF)
    got = frame([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    want = frame(cur.fetchall(), [d[0] for d in cur.description])
    assert list(got.columns) == list(want.columns)
    assert canon(got) == canon(want)


def test_registry_is_complete(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
