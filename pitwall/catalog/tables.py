"""Base tables and the joins and roll-ups they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwall.catalog import query, rounded, season  # noqa: F401  (season defines the shared steps)
from pitwall.catalog.oracle import ROUNDS, sql, step
from pitwall.functions.metrics import METRICS
from pitwall.operators import career, standings as st
from pitwall.operators.features import active, scoring
from pitwall.plans import base_tables as bt
from pitwall.plans.lake import small

step("champions", """
SELECT year, arg_min(driverid, struct_pack(a := -p, b := driverid)) AS driverid
FROM (SELECT year, driverid, SUM(points) AS p FROM results GROUP BY ALL)
WHERE year < (SELECT MAX(year) FROM results) GROUP BY year""", "results")
step("team_champions", """
SELECT year, arg_min(teamid, struct_pack(a := -p, b := teamid)) AS teamid
FROM (SELECT year, teamid, SUM(points) AS p FROM results GROUP BY ALL)
WHERE year < (SELECT MAX(year) FROM results) GROUP BY year""", "results")
step("season_ends", """
SELECT f.* FROM fs_all f
WHERE f.dt_ref = (SELECT MAX(g.dt_ref) FROM fs_all g WHERE g.driverid = f.driverid AND year(g.dt_ref) = year(f.dt_ref))
""", "fs_all")
step("t1", """
SELECT s.*, CAST(EXISTS (SELECT 1 FROM champions c WHERE c.driverid = s.driverid
                         AND c.year = year(s.dt_ref) + 1) AS INT) AS fl_champion
FROM season_ends s""", "season_ends", "champions")


def rollup_sql(spec, alias="f"):
    return ", ".join(f"{k}({alias}.{f}) AS {k}_{n}" for f, n, kinds in spec for k in kinds.split())


step("t2_teams", f"""
SELECT s.dt_ref, b.teamid, b.team_name, {rollup_sql(bt.TEAM_ROLLUP, 's')}, COUNT(*) AS num_drivers
FROM season_ends s JOIN (SELECT DISTINCT driverid, teamid, team_name, event_date FROM results) b
  ON b.driverid = s.driverid AND b.event_date = s.dt_ref GROUP BY ALL""", "season_ends", "results")
step("t2", """
SELECT s.*, CAST(EXISTS (SELECT 1 FROM team_champions c WHERE c.teamid = s.teamid
                         AND c.year = year(s.dt_ref) + 1) AS INT) AS fl_constructor_champion
FROM t2_teams s""", "t2_teams", "team_champions")

_M = ["standings_momentum_3r", "standings_momentum_1r", "gap_momentum_3r", "points_last3", "points_prev3", "points_accel"]
step("t3", f"""
SELECT f.*, c.season_race_number, c.season_total_races,
       round(c.season_race_number / CAST(c.season_total_races AS DOUBLE), 3) AS season_fraction,
       COALESCE(m.standing_position, 99) AS standing_position,
       COALESCE(m.points_gap_to_leader, 0) AS points_gap_to_leader,
       COALESCE(m.points_pct_of_leader, 0) AS points_pct_of_leader,
       {', '.join(f'COALESCE(m.{c}, 0) AS {c}' for c in _M)},
       COALESCE(m.points_pct_of_leader * qtd_wins_last10, 0) AS pct_leader_x_wins,
       COALESCE(m.points_pct_of_leader * qtd_podiums_last10, 0) AS pct_leader_x_podiums,
       COALESCE(m.points_pct_of_leader * total_points_last10, 0) AS pct_leader_x_points,
       CASE WHEN w.driverid IS NOT NULL THEN 1 ELSE 0 END AS fl_champion
FROM fs_all f JOIN calendar c ON c.dt_ref = f.dt_ref
LEFT JOIN driver_momentum m ON m.driverid = f.driverid AND m.dt_ref = f.dt_ref
LEFT JOIN champions w ON w.year = c.year AND w.driverid = f.driverid
WHERE f.dt_ref >= DATE '1996-01-01'""", "fs_all", "calendar", "driver_momentum", "champions")
step("t4_teams", f"""
SELECT c.dt_ref, c.year, c.season_race_number, c.season_total_races,
       round(c.season_race_number / CAST(c.season_total_races AS DOUBLE), 3) AS season_fraction,
       r.teamid, r.team_name, {rollup_sql(bt.TEAM_ROLLUP + bt.QUALI_ROLLUP)},
       COUNT(DISTINCT r.driverid) AS num_drivers
FROM calendar c
JOIN (SELECT DISTINCT driverid, event_date, teamid, team_name FROM scored) r ON r.event_date = c.dt_ref
JOIN fs_all f ON f.driverid = r.driverid AND f.dt_ref = c.dt_ref
WHERE c.year >= 1996 GROUP BY ALL""", "calendar", "scored", "fs_all")
step("t4", f"""
SELECT t.*, m.standing_position AS team_standing_position,
       m.points_gap_to_leader AS team_points_gap_to_leader,
       m.points_pct_of_leader AS team_points_pct_of_leader,
       {', '.join(f'COALESCE(m.{c}, 0) AS team_{c}' for c in _M)},
       {', '.join(f'COALESCE(m.points_pct_of_leader * t.sum_{c}_last10, 0) AS team_pct_leader_x_{c}'
                  for c in ('wins', 'podiums', 'points'))},
       CASE WHEN w.teamid IS NOT NULL THEN 1 ELSE 0 END AS fl_constructor_champion
FROM t4_teams t LEFT JOIN team_momentum m ON m.teamid = t.teamid AND m.dt_ref = t.dt_ref
LEFT JOIN team_champions w ON w.year = t.year AND w.teamid = t.teamid""", "t4_teams", "team_momentum", "team_champions")


def _rate(part: str) -> str:
    def side(s):
        return f"COALESCE({part.format(s=s)} / NULLIF(CAST(qtd_sessions_{s} AS DOUBLE), 0), 0)"
    return f"{side('last10')} - {side('life')}"


TRENDS = {
    **{f"trend_avg_{c}": f"avg_{c}_last10 - avg_{c}_life" for c in ("position", "grid", "overtakes")},
    "trend_win_rate": _rate("qtd_wins_{s}"),
    "trend_podium_rate": _rate("qtd_podiums_{s}"),
    "trend_dnf_rate": _rate("(qtd_sessions_{s} - qtd_finished_{s})"),
}
_TREND_SQL = ", ".join(f"{e} AS {n}" for n, e in TRENDS.items())
_PROFILE = """
       COALESCE(m.team_points_share, 0.5) AS team_points_share,
       COALESCE(m.teammate_position_gap, 0) AS teammate_position_gap,
       COALESCE(m.teammate_grid_gap, 0) AS teammate_grid_gap,
       COALESCE(m.season_dnf_rate, 0) AS season_dnf_rate,
       COALESCE(m.season_points_current, 0) AS season_points_current,
       COALESCE(k.team_tenure_years, 1) AS team_tenure_years,
       round(datediff('day', b.date_of_birth, f.dt_ref) / 365.25, 1) AS driver_age,
       COALESCE(ct.career_distinct_teams, 1) AS career_distinct_teams,
       COALESCE(l.year - a.last_win_year, qtd_seasons_life + 1) AS seasons_since_last_win,
       COALESCE(l.year - a.last_podium_year, qtd_seasons_life + 1) AS seasons_since_last_podium,
       d.fl_departed"""
step("t5", f"""
SELECT f.*, {_TREND_SQL}, {_PROFILE}
FROM fs_all f JOIN results_last l ON l.driverid = f.driverid AND l.dt_ref = f.dt_ref
JOIN results_departed d ON d.driverid = f.driverid AND d.year = l.year
LEFT JOIN results_mates_fanout m ON m.driverid = f.driverid AND m.year = l.year
LEFT JOIN results_end_team e ON e.driverid = f.driverid AND e.year = l.year
LEFT JOIN results_tenure k ON k.driverid = f.driverid AND k.year = l.year AND k.teamid = e.teamid
LEFT JOIN births b ON b.driverid = f.driverid
LEFT JOIN results_career_teams ct ON ct.driverid = f.driverid AND ct.year = l.year
LEFT JOIN results_achieved a ON a.driverid = f.driverid AND a.year = l.year
WHERE f.dt_ref >= DATE '1996-01-01' AND l.year < 2001""",
     "fs_all", "results_last", "results_departed", "results_mates_fanout", "results_end_team",
     "results_tenure", "births", "results_career_teams", "results_achieved")
step("t6", f"""
SELECT f.*, l.season_race_number, l.season_total_races,
       round(l.season_race_number / CAST(l.season_total_races AS DOUBLE), 3) AS season_fraction,
       {_TREND_SQL}, {_PROFILE}
FROM fs_all f JOIN calendar l ON l.dt_ref = f.dt_ref
LEFT JOIN results_departed_open d ON d.driverid = f.driverid AND d.year = l.year
LEFT JOIN mates_so_far m ON m.driverid = f.driverid AND m.dt_ref = f.dt_ref
LEFT JOIN (SELECT DISTINCT driverid, event_date, teamid FROM scored) n
  ON n.driverid = f.driverid AND n.event_date = f.dt_ref
LEFT JOIN results_tenure k ON k.driverid = n.driverid AND k.teamid = n.teamid AND k.year = l.year
LEFT JOIN births b ON b.driverid = f.driverid
LEFT JOIN teams_so_far ct ON ct.driverid = f.driverid AND ct.dt_ref = f.dt_ref
LEFT JOIN achieved_so_far a ON a.driverid = f.driverid AND a.dt_ref = f.dt_ref
WHERE l.year >= 1996""",
     "fs_all", "calendar", "results_departed_open", "mates_so_far", "scored", "results_tenure", "births",
     "teams_so_far", "achieved_so_far")


def rr(cols) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in cols)


CONTEXT = ("season_race_number, season_total_races, round(season_fraction + 1e-9, 6) AS season_fraction")
_ROLL_AVG = [f"avg_{n}" for f, n, k in bt.TEAM_ROLLUP + bt.QUALI_ROLLUP if "avg" in k.split()]


def _all_rounded(table: str, doubles: list[str]) -> str:
    reps = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({reps}) FROM {table}"


_FS_AVG = [f"{m.name}_{k}" for k in ROUNDS for m in METRICS if m.kind == "mean"]
_MATE = ["team_points_share", "teammate_position_gap", "teammate_grid_gap", "season_dnf_rate"]
_PCT = ["points_pct_of_leader", "pct_leader_x_wins", "pct_leader_x_podiums", "pct_leader_x_points"]

query("t1_abt_champions", sql(_all_rounded("t1", _FS_AVG), "t1"))(lambda t: rounded(t.abt_champions))
query("t2_abt_teams", sql(_all_rounded("t2", [c for c in _ROLL_AVG if "quali" not in c]), "t2"))(
    lambda t: rounded(t.abt_teams))
query("t3_abt_champions_inseason", sql(_all_rounded("t3", _FS_AVG + _PCT + ["season_fraction"]), "t3"))(
    lambda t: rounded(t.abt_champions_inseason))
query("t4_abt_teams_inseason", sql(_all_rounded("t4", _ROLL_AVG + ["season_fraction"] + [
    f"team_{c}" for c in _PCT]), "t4"))(lambda t: rounded(t.abt_teams_inseason))
query("t5_abt_departures", sql(_all_rounded("t5", _FS_AVG + list(TRENDS) + _MATE + ["driver_age"]), "t5"))(
    lambda t: rounded(t.abt_departures))
query("t6_abt_departures_inseason", sql(_all_rounded(
    "t6", _FS_AVG + list(TRENDS) + _MATE + ["driver_age", "season_fraction"]), "t6"))(
    lambda t: rounded(t.abt_departures_inseason))

# One key per part of the wide tables, so that a difference is easy to place.
query("t3_context", sql(
    f"SELECT dt_ref, driverid, {CONTEXT}, standing_position, points_gap_to_leader, {rr(_PCT[:1])} FROM t3", "t3"),
    )(lambda t: rounded(t.only("abt_champions_inseason",
        "dt_ref", "driverid", "season_race_number", "season_total_races", "season_fraction",
        "standing_position", "points_gap_to_leader", "points_pct_of_leader")))
query("x7_interactions", sql(f"SELECT dt_ref, driverid, {rr(_PCT[1:])} FROM t3", "t3"))(
    lambda t: rounded(t.only("abt_champions_inseason", "dt_ref", "driverid", *_PCT[1:])))
query("x6_trends", sql(
    f"SELECT dt_ref, driverid, {', '.join(f'round({e} + 1e-9, 6) AS {n}' for n, e in TRENDS.items())} FROM fs_all", "fs_all"),
    )(lambda t: rounded(t.features.select("dt_ref", "driverid", *[c.alias(n) for n, c in bt.trends().items()])))
query("x8_seasons_since", sql(
    "SELECT dt_ref, driverid, seasons_since_last_win, seasons_since_last_podium FROM t6", "t6"),
    )(lambda t: t.only("abt_departures_inseason",
        "dt_ref", "driverid", "seasons_since_last_win", "seasons_since_last_podium"))
query("t6_label", sql("SELECT dt_ref, driverid, fl_departed FROM t6", "t6"))(
    lambda t: t.only("abt_departures_inseason", "dt_ref", "driverid", "fl_departed"))
query("j12_departure_star", sql(
    f"SELECT dt_ref, driverid, {rr(_MATE)}, season_points_current, team_tenure_years, "
    "career_distinct_teams FROM t5", "t5"),
    )(lambda t: rounded(t.only("abt_departures",
        "dt_ref", "driverid", *_MATE, "season_points_current", "team_tenure_years", "career_distinct_teams")))

# -- joins --------------------------------------------------------------
query("j4_eligible_semi_join", sql("""
    SELECT a.dt_ref, a.driverid, r.points FROM still_active a JOIN results r
      ON r.driverid = a.driverid AND r.event_date = a.dt_ref AND r.mode = 'Race'""", "still_active", "results"),
    )(lambda t: t.results.where("mode = 'Race'").withColumnRenamed("event_date", "dt_ref")
      .join(active(t.results), ["dt_ref", "driverid"], "left_semi").select("dt_ref", "driverid", "points"))
query("j7_next_year_label", sql(
    "SELECT dt_ref, driverid, fl_champion FROM t1", "t1"),
    )(lambda t: t.only("abt_champions", "dt_ref", "driverid", "fl_champion"))
query("j8_same_year_label", sql(
    "SELECT dt_ref, teamid, fl_constructor_champion FROM t4", "t4"),
    )(lambda t: t.only("abt_teams_inseason", "dt_ref", "teamid", "fl_constructor_champion"))
query("j11_features_to_roster", sql("""
    SELECT f.dt_ref, r.teamid, f.driverid, qtd_wins_life FROM fs_all f
    JOIN (SELECT DISTINCT driverid, event_date, teamid FROM scored) r
      ON r.driverid = f.driverid AND r.event_date = f.dt_ref""", "fs_all", "scored"),
    )(lambda t: t.only("features", "dt_ref", "driverid", "qtd_wins_life").join(
        # files of three columns are so small that Spark would send millions of rows through the driver
        career.current_team(t.results).hint("merge"), ["dt_ref", "driverid"]))
query("g9_team_rollup", sql(
    f"SELECT dt_ref, teamid, sum_wins_last10, sum_points_last10, {rr(['avg_position_last10', 'avg_grid_last10'])}, num_drivers FROM t4", "t4"),
    )(lambda t: rounded(t.only("abt_teams_inseason",
        "dt_ref", "teamid", "sum_wins_last10", "sum_points_last10", "avg_position_last10", "avg_grid_last10", "num_drivers")))
query("b8_all_but", sql("""
    SELECT * EXCLUDE (full_name, qty, status) FROM results""", "results"),
    )(lambda t: t.results.drop("full_name", "qty", "status"))
query("b9_star_plus_computed", sql("""
    SELECT s.*, CASE WHEN standing_position = 1 THEN 1 ELSE 0 END AS is_leader FROM team_standings s""", "team_standings"),
    )(lambda t: t.team_standings.withColumn("is_leader", (F.col("standing_position") == 1).cast("int")))
query("b10_year_range", sql("""
    SELECT dt_ref, driverid, standing_position FROM driver_standings
    WHERE dt_ref >= DATE '1998-01-01' AND year <= 1999""", "driver_standings"),
    )(lambda t: t.driver_standings.where((F.col("dt_ref") >= F.lit("1998-01-01").cast("date")) & (F.col("year") <= 1999))
      .select("dt_ref", "driverid", "standing_position"))
query("b11_closed_seasons", sql("""
    SELECT driverid, year, dt_ref FROM results_last WHERE year < 2001""", "results_last"),
    )(lambda t: career.last_session(t.results).where(F.col("year") < F.lit(2001)))
query("w1_latest_per_key", sql("""
    SELECT driverid, year(dt_ref) AS season, dt_ref, qtd_sessions_life FROM season_ends""", "season_ends"),
    )(lambda t: bt.season_end(t.only("features", "dt_ref", "driverid", "qtd_sessions_life")).select(
        "driverid", F.col("stats_year").cast("bigint").alias("season"), "dt_ref", "qtd_sessions_life"))

step("clinched", """
SELECT dt_ref, leader_gap, max_remaining_points, CASE WHEN leader_gap > max_remaining_points THEN 1 ELSE 0 END AS is_clinched
FROM driver_leaders JOIN driver_remaining USING (year, dt_ref)""", "driver_leaders", "driver_remaining")
query("s10_abt_with_clinch", sql("""
    SELECT t3.dt_ref, driverid, fl_champion, leader_gap, max_remaining_points, is_clinched
    FROM t3 JOIN clinched USING (dt_ref)""", "t3", "clinched"),
    )(lambda t: bt.champions_inseason(
        t.only("features", "dt_ref", "driverid", *bt.metrics_used("abt_champions_inseason", ())), t.results, t.driver_standings, t.champions, since="1996-01-01",
        clinch=st.clinch(st.leader_gap(t.driver_running, "driverid"), st.remaining_points(t.results, "driverid")).drop("leader"))
    .select("dt_ref", "driverid", "fl_champion", "leader_gap", "max_remaining_points", "is_clinched"))
