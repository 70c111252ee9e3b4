"""Feature store: windows, joins and partial steps."""

from __future__ import annotations

from pitwall.catalog import query, rounded
from pitwall.catalog.oracle import ROUNDS, metric_columns, sql
from pitwall.functions.metrics import AVERAGED, COUNTED, METRICS, NAMES, SEASONS, WEATHER
from pitwall.operators.career import past_totals
from pitwall.operators.features import driver_window, join_windows, recent_slots, slot_weights

KEYS = ["dt_ref", "driverid"]

for _k, _n in ROUNDS.items():
    query(f"p2_driver_window_{_k}",
          sql(f"SELECT dt_ref, driverid, {metric_columns((_k,))} FROM fs_{_k}", f"fs_{_k}"),
          )(lambda t, k=_k, n=_n: rounded(driver_window(t.results, n, k)))

query("p2_round_weighting_last10",
      sql(f"SELECT dt_ref, driverid, {metric_columns(('last10',))} FROM fs_once_last10", "fs_once_last10"),
      )(lambda t: rounded(driver_window(t.results, 10, "last10", weighting="round")))

query("p2_own_rounds_last10",
      sql(f"SELECT dt_ref, driverid, {metric_columns(('last10',))} FROM fs_own_last10", "fs_own_last10"),
      )(lambda t: rounded(driver_window(t.results, 10, "last10", scope="entity")))

query("p4_feature_store_all",
      sql(f"SELECT dt_ref, driverid, {metric_columns()} FROM fs_all", "fs_all"),
      )(lambda t: rounded(t.features))

query("p3_window_counts",
      sql(f"SELECT dt_ref, driverid, {', '.join(f'{SEASONS}_{k}, qtd_sessions_{k}' for k in ROUNDS)} FROM fs_all", "fs_all"),
      )(lambda t: t.only("features", *KEYS, *[f"{c}_{k}" for k in ROUNDS for c in (SEASONS, "qtd_sessions")]))

# The 55 metrics family by family, over all windows.
FAMILIES = {
    "sessions": ["qtd_sessions", "qtd_finished", "qtd_race", "qtd_finished_race", "qtd_sprint", "qtd_finished_sprint"],
    **{n.removeprefix("qtd_"): [n, f"{n}_race", f"{n}_sprint"] for n in COUNTED},
    "points": ["total_points", "total_points_race", "total_points_sprint"],
    **{n: [n, f"{n}_race", f"{n}_sprint"] for n in AVERAGED},
    "qualifying": ["qtd_quali", "avg_quali_position", "qtd_quali_pole", "qtd_quali_top3", "qtd_quali_top10"],
    "weather": [*WEATHER, "qtd_sessions_rain", "pct_sessions_rain"],
}
_MEANS = {m.name for m in METRICS if m.kind == "mean"}
for _f, _cols in FAMILIES.items():
    _wide = [(c, f"{c}_{k}") for k in ROUNDS for c in _cols]
    query(f"p2_family_{_f}", sql("SELECT dt_ref, driverid, " + ", ".join(
        f"round({n} + 1e-9, 6) AS {n}" if c in _MEANS else n for c, n in _wide) + " FROM fs_all", "fs_all"),
        )(lambda t, w=_wide: rounded(t.only("features", *KEYS, *[n for _, n in w])))

query("w2_recent_rounds", sql("""
    SELECT dt_ref, year, round_number, event_date, CAST(back AS INT) AS back FROM slots_back WHERE back <= 20""", "slots_back"),
    )(lambda t: recent_slots(t.results, 20))
query("j5_slot_weights", sql("""
    SELECT dt_ref, year, round_number, COUNT(*) AS weight FROM slots_back WHERE back <= 10 GROUP BY ALL""", "slots_back"),
    )(lambda t: slot_weights(t.results, 10))
query("j1_past_sessions", sql("""
    SELECT dt_ref, driverid, COUNT(*) AS sessions, CAST(SUM(points) AS BIGINT) AS points FROM past GROUP BY ALL""", "past"),
    )(lambda t: past_totals(t.results))
query("j6_join_windows", sql("""
    SELECT dt_ref, driverid, qtd_wins_life, qtd_wins_last10, qtd_wins_last20, qtd_wins_last40 FROM fs_life
    JOIN fs_last10 USING (dt_ref, driverid) JOIN fs_last20 USING (dt_ref, driverid) JOIN fs_last40 USING (dt_ref, driverid)""",
    "fs_life", "fs_last10", "fs_last20", "fs_last40"),
    )(lambda t: join_windows([driver_window(t.results, n, k).select(*KEYS, f"qtd_wins_{k}")
                              for k, n in (("life", None), ("last10", 10), ("last20", 20), ("last40", 40))], KEYS))
