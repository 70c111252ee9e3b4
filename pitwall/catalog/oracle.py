"""Plain SQL statements that say what each query must return.

Shared steps are named common table expressions; ``sql`` puts the needed ones
in front of a final SELECT. They state the definitions directly (every date
joined with its past), not the way the Spark side computes them.
"""

from __future__ import annotations

SCORING = "('Race', 'Sprint', 'Sprint Race')"
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, body: str, *needs: str) -> None:
    _STEPS[name] = (needs, body)


def _collect(names, seen):
    for n in names:
        if n not in seen:
            _collect(_STEPS[n][0], seen)
            seen.append(n)
    return seen


def sql(final: str, *needs: str) -> str:
    order = _collect(needs, [])
    if final.lstrip().startswith("WITH"):
        final = f"SELECT * FROM ({final})"
    if not order:
        return final
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_STEPS[n][1].strip()})" for n in order)
    return f"WITH {parts}\n{final.strip()}"


def r6(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in cols)


step("totals", """
SELECT l_suppkey AS driverid, CAST(year(l_shipdate) AS INT) AS year,
       CAST(month(l_shipdate) AS INT) AS round_number,
       CASE l_returnflag WHEN 'A' THEN 'Race' WHEN 'N' THEN 'Sprint' ELSE 'Qualifying' END AS mode,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS points,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
       CAST(MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS INT) AS is_finished,
       COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS ln,
       CAST(SUM(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
       CAST(SUM(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
FROM lineitem GROUP BY ALL
""")

step("session_weather_fixture", """
SELECT year, round_number, mode,
       CASE WHEN year >= 1996 THEN round((SUM(qty) / CAST(SUM(n) AS DOUBLE)) * 8) / 8 END AS air_temp,
       CASE WHEN year >= 1996 THEN round(((SUM(qty) + SUM(ln)) / CAST(SUM(n) AS DOUBLE)) * 8) / 8 END AS track_temp,
       CASE WHEN year >= 1996 THEN round((SUM(disc) * 10 / CAST(SUM(n) AS DOUBLE)) * 8) / 8 END AS humidity,
       CASE WHEN year >= 1996 THEN round((SUM(tax) / CAST(SUM(n) AS DOUBLE) + 990) * 8) / 8 END AS pressure,
       CASE WHEN year >= 1996 THEN round((SUM(ln) / CAST(SUM(n) AS DOUBLE)) * 8) / 8 END AS wind_speed,
       CASE WHEN year >= 1996 THEN CAST(CAST(SUM(points) AS BIGINT) % 360 AS DOUBLE) END AS wind_direction,
       CASE WHEN year >= 1996 AND CAST(SUM(qty) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS rainfall
FROM totals GROUP BY year, round_number, mode
""", "totals")

step("results", """
SELECT t.driverid, s.s_name AS full_name, s.s_nationkey AS teamid, n.n_name AS team_name,
       lower(lpad(to_hex(s.s_nationkey * 655360 + 255), 6, '0')) AS team_color,
       t.year, t.round_number, t.mode,
       make_date(t.year, t.round_number, CASE WHEN t.mode = 'Race' THEN 2 ELSE 1 END) AS event_date,
       printf('Round %d-%02d', t.year, t.round_number) AS event_name,
       printf('Country %d', t.round_number % 5) AS country,
       printf('Circuit %d', t.round_number) AS location,
       t.points, t.qty,
       CAST(row_number() OVER (PARTITION BY t.year, t.round_number, t.mode
            ORDER BY t.points DESC, t.driverid) AS INT) AS position,
       CAST(row_number() OVER (PARTITION BY t.year, t.round_number, t.mode
            ORDER BY t.qty DESC, t.driverid) AS INT) AS grid_position,
       t.is_finished,
       CASE WHEN t.is_finished = 1 THEN 'Finished' ELSE 'Retired' END AS status,
       grid_position - position AS overtakes,
       w.air_temp, w.track_temp, w.humidity, w.pressure, w.wind_speed, w.wind_direction, w.rainfall
FROM totals t
JOIN session_weather_fixture w USING (year, round_number, mode)
JOIN supplier s ON s.s_suppkey = t.driverid
JOIN nation n ON n.n_nationkey = s.s_nationkey
""", "totals", "session_weather_fixture")

step("scored", f"SELECT * FROM results WHERE mode IN {SCORING}", "results")

step("transfers", """
SELECT driverid, teamid, year, event_date, points, is_finished,
       CAST(row_number() OVER (PARTITION BY event_date ORDER BY points DESC, first_order) AS INT) AS position,
       CAST(row_number() OVER (PARTITION BY event_date ORDER BY first_order) AS INT) AS grid_position,
       'Race' AS mode, CAST(dayofyear(event_date) AS INT) AS round_number
FROM (SELECT o_custkey AS driverid, o_orderpriority AS teamid,
             CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderdate AS DATE) AS event_date,
             CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS points,
             MIN(o_orderkey) AS first_order,
             CAST(MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS is_finished
      FROM orders GROUP BY ALL)
""")

step("spine", "SELECT DISTINCT event_date AS dt_ref, year AS ref_year FROM scored", "scored")
step("past", """
SELECT spine.dt_ref, spine.ref_year, r.* FROM spine JOIN results r ON r.event_date < spine.dt_ref
""", "spine", "results")
step("still_active", "SELECT DISTINCT dt_ref, driverid FROM past WHERE year >= ref_year - 2", "past")
step("slots_back", """
SELECT dt_ref, year, round_number, event_date,
       row_number() OVER (PARTITION BY dt_ref ORDER BY event_date DESC, year DESC, round_number DESC) AS back
FROM (SELECT DISTINCT dt_ref, year, round_number, event_date FROM past)
""", "past")


# The metrics of a window, each with the aggregate that defines it.
METRIC_SQL = dict(line.strip().split(": ", 1) for line in """
    qtd_seasons: COUNT(DISTINCT p.year)
    qtd_sessions: COUNT(*)
    qtd_finished: CAST(COALESCE(SUM(is_finished), 0) AS BIGINT)
    qtd_race: COUNT(*) FILTER (WHERE mode IN ('Race'))
    qtd_finished_race: COUNT(*) FILTER (WHERE mode IN ('Race') AND is_finished = 1)
    qtd_sprint: COUNT(*) FILTER (WHERE mode IN ('Sprint', 'Sprint Race'))
    qtd_finished_sprint: COUNT(*) FILTER (WHERE mode IN ('Sprint', 'Sprint Race') AND is_finished = 1)
    qtd_wins: COUNT(*) FILTER (WHERE position = 1)
    qtd_wins_race: COUNT(*) FILTER (WHERE position = 1 AND mode IN ('Race'))
    qtd_wins_sprint: COUNT(*) FILTER (WHERE position = 1 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_podiums: COUNT(*) FILTER (WHERE position <= 3)
    qtd_podiums_race: COUNT(*) FILTER (WHERE position <= 3 AND mode IN ('Race'))
    qtd_podiums_sprint: COUNT(*) FILTER (WHERE position <= 3 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_top5: COUNT(*) FILTER (WHERE position <= 5)
    qtd_top5_race: COUNT(*) FILTER (WHERE position <= 5 AND mode IN ('Race'))
    qtd_top5_sprint: COUNT(*) FILTER (WHERE position <= 5 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_grid_top5: COUNT(*) FILTER (WHERE grid_position <= 5)
    qtd_grid_top5_race: COUNT(*) FILTER (WHERE grid_position <= 5 AND mode IN ('Race'))
    qtd_grid_top5_sprint: COUNT(*) FILTER (WHERE grid_position <= 5 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_poles: COUNT(*) FILTER (WHERE grid_position = 1)
    qtd_poles_race: COUNT(*) FILTER (WHERE grid_position = 1 AND mode IN ('Race'))
    qtd_poles_sprint: COUNT(*) FILTER (WHERE grid_position = 1 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_pole_win: COUNT(*) FILTER (WHERE grid_position = 1 AND position = 1)
    qtd_pole_win_race: COUNT(*) FILTER (WHERE grid_position = 1 AND position = 1 AND mode IN ('Race'))
    qtd_pole_win_sprint: COUNT(*) FILTER (WHERE grid_position = 1 AND position = 1 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_sessions_with_points: COUNT(*) FILTER (WHERE points > 0)
    qtd_sessions_with_points_race: COUNT(*) FILTER (WHERE points > 0 AND mode IN ('Race'))
    qtd_sessions_with_points_sprint: COUNT(*) FILTER (WHERE points > 0 AND mode IN ('Sprint', 'Sprint Race'))
    qtd_sessions_with_overtake: COUNT(*) FILTER (WHERE position < grid_position)
    qtd_sessions_with_overtake_race: COUNT(*) FILTER (WHERE position < grid_position AND mode IN ('Race'))
    qtd_sessions_with_overtake_sprint: COUNT(*) FILTER (WHERE position < grid_position AND mode IN ('Sprint', 'Sprint Race'))
    total_points: CAST(COALESCE(SUM(points), 0) AS BIGINT)
    total_points_race: CAST(COALESCE(SUM(points) FILTER (WHERE mode IN ('Race')), 0) AS BIGINT)
    total_points_sprint: CAST(COALESCE(SUM(points) FILTER (WHERE mode IN ('Sprint', 'Sprint Race')), 0) AS BIGINT)
    avg_grid: AVG(grid_position)
    avg_grid_race: AVG(grid_position) FILTER (WHERE mode IN ('Race'))
    avg_grid_sprint: AVG(grid_position) FILTER (WHERE mode IN ('Sprint', 'Sprint Race'))
    avg_position: AVG(position)
    avg_position_race: AVG(position) FILTER (WHERE mode IN ('Race'))
    avg_position_sprint: AVG(position) FILTER (WHERE mode IN ('Sprint', 'Sprint Race'))
    avg_overtakes: AVG(grid_position - position)
    avg_overtakes_race: AVG(grid_position - position) FILTER (WHERE mode IN ('Race'))
    avg_overtakes_sprint: AVG(grid_position - position) FILTER (WHERE mode IN ('Sprint', 'Sprint Race'))
    qtd_quali: COUNT(*) FILTER (WHERE mode IN ('Qualifying'))
    avg_quali_position: AVG(position) FILTER (WHERE mode IN ('Qualifying'))
    qtd_quali_pole: COUNT(*) FILTER (WHERE mode IN ('Qualifying') AND position = 1)
    qtd_quali_top3: COUNT(*) FILTER (WHERE mode IN ('Qualifying') AND position <= 3)
    qtd_quali_top10: COUNT(*) FILTER (WHERE mode IN ('Qualifying') AND position <= 10)
    avg_air_temp: AVG(air_temp)
    avg_track_temp: AVG(track_temp)
    avg_humidity: AVG(humidity)
    avg_pressure: AVG(pressure)
    avg_wind_speed: AVG(wind_speed)
    qtd_sessions_rain: CAST(COALESCE(SUM(rainfall), 0) AS BIGINT)
    pct_sessions_rain: AVG(rainfall)
""".strip().splitlines())
MEANS = {name for name, e in METRIC_SQL.items() if e.startswith("AVG")}


def metric_sql(suffix: str) -> str:
    return ",\n       ".join(f"{e} AS {name}_{suffix}" for name, e in METRIC_SQL.items())


def _store(suffix: str, rounds: int | None, once: bool = False) -> str:
    keep = f"WHERE back <= {rounds}" if rounds else ""
    distinct = "DISTINCT " if once else ""
    return f"""
SELECT p.dt_ref, p.driverid, {metric_sql(suffix)}
FROM past p JOIN still_active USING (dt_ref, driverid)
JOIN (SELECT {distinct}dt_ref, year, round_number FROM slots_back {keep}) w USING (dt_ref, year, round_number)
GROUP BY p.dt_ref, p.driverid
"""


ROUNDS = {"life": None, "last10": 10, "last20": 20, "last40": 40}
for _k, _n in ROUNDS.items():
    step(f"fs_{_k}", _store(_k, _n), "past", "still_active", "slots_back")
    step(f"fs_once_{_k}", _store(_k, _n, once=True), "past", "still_active", "slots_back")

step("fs_own_last10", f"""
SELECT p.dt_ref, p.driverid, {metric_sql('last10')}
FROM past p JOIN still_active USING (dt_ref, driverid)
JOIN (SELECT dt_ref, driverid, event_date,
             row_number() OVER (PARTITION BY dt_ref, driverid ORDER BY event_date DESC) AS back
      FROM (SELECT DISTINCT dt_ref, driverid, event_date FROM past)) w
  ON w.dt_ref = p.dt_ref AND w.driverid = p.driverid AND w.event_date = p.event_date
WHERE back <= 10 GROUP BY p.dt_ref, p.driverid
""", "past", "still_active")

step("fs_all", """
SELECT * FROM fs_life JOIN fs_last10 USING (dt_ref, driverid)
JOIN fs_last20 USING (dt_ref, driverid) JOIN fs_last40 USING (dt_ref, driverid)
""", *[f"fs_{k}" for k in ROUNDS])


def metric_columns(suffixes=tuple(ROUNDS)) -> str:
    """Every metric column, means rounded for comparison."""
    return ", ".join(f"round({m}_{k} + 1e-9, 6) AS {m}_{k}" if m in MEANS else f"{m}_{k}" for k in suffixes for m in METRIC_SQL)
