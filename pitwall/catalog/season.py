"""Calendar, standings, momentum, labels and career features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwall.catalog import query, rounded
from pitwall.catalog.oracle import SCORING, sql, step
from pitwall.operators import career, standings as st
from pitwall.operators.features import scoring
from pitwall.plans.lake import small

step("calendar", """
SELECT year, dt_ref,
       CAST(row_number() OVER (PARTITION BY year ORDER BY dt_ref) AS INT) AS season_race_number,
       CAST(COUNT(*) OVER (PARTITION BY year) AS INT) AS season_total_races
FROM (SELECT DISTINCT year, event_date AS dt_ref FROM scored)
""", "scored")

for who, key in (("driver", "driverid"), ("team", "teamid")):
    step(f"{who}_running", f"""
SELECT a.year, a.dt_ref, a.{key}, CAST(MAX(a.points) AS BIGINT) AS points, CAST(SUM(b.points) AS BIGINT) AS cum_points
FROM (SELECT year, event_date AS dt_ref, {key}, SUM(points) AS points FROM scored GROUP BY ALL) a
JOIN scored b ON b.year = a.year AND b.{key} = a.{key} AND b.event_date <= a.dt_ref
GROUP BY a.year, a.dt_ref, a.{key}
""", "scored")
    for variant, pts in (("", "cum_points"), ("_before", "cum_points - points")):
        step(f"{who}_standings{variant}", f"""
SELECT year, dt_ref, {key}, cp AS cum_points,
       CAST(rank() OVER (PARTITION BY dt_ref ORDER BY cp DESC) AS INT) AS standing_position,
       top - cp AS points_gap_to_leader,
       CASE WHEN top <> 0 THEN round(CAST(cp AS DOUBLE) / top, 4) END AS points_pct_of_leader
FROM (SELECT year, dt_ref, {key}, {pts} AS cp, MAX({pts}) OVER (PARTITION BY year, dt_ref) AS top
      FROM {who}_running)
""", f"{who}_running")
    step(f"{who}_momentum", f"""
SELECT s.*,
       lag(standing_position, 3) OVER own - standing_position AS standings_momentum_3r,
       lag(standing_position, 1) OVER own - standing_position AS standings_momentum_1r,
       lag(points_gap_to_leader, 3) OVER own - points_gap_to_leader AS gap_momentum_3r,
       cum_points - lag(cum_points, 3) OVER own AS points_last3,
       lag(cum_points, 3) OVER own - lag(cum_points, 6) OVER own AS points_prev3,
       points_last3 - points_prev3 AS points_accel
FROM {who}_standings s WINDOW own AS (PARTITION BY year, {key} ORDER BY dt_ref)
""", f"{who}_standings")
    step(f"{who}_leaders", f"""
SELECT year, dt_ref, list_sort(list(cum_points), 'DESC') AS pts, pts[1] - pts[2] AS leader_gap,
       arg_min({key}, struct_pack(a := -cum_points, b := {key})) AS leader
FROM {who}_running GROUP BY year, dt_ref
""", f"{who}_running")
    best = ("SELECT year, event_date AS dt_ref, MAX(points) AS m FROM scored GROUP BY ALL" if who == "driver"
            else "SELECT year, dt_ref, MAX(points) AS m FROM team_running GROUP BY ALL")
    step(f"{who}_remaining", f"""
WITH best AS ({best})
SELECT a.year, a.dt_ref, CAST(COALESCE(SUM(b.m), 0) AS BIGINT) AS max_remaining_points
FROM best a LEFT JOIN best b ON b.year = a.year AND b.dt_ref > a.dt_ref GROUP BY ALL
""", "scored", *(["team_running"] if who == "team" else []))

COLS = "standing_position, points_gap_to_leader, points_pct_of_leader"
MOM = "standings_momentum_3r, standings_momentum_1r, gap_momentum_3r, points_last3, points_prev3, points_accel"


def _running(t, who):
    return t.driver_running if who == "driver" else t.team_running


def _standings(t, who):
    return t.driver_standings if who == "driver" else t.team_standings


for who, key in (("driver", "driverid"), ("team", "teamid")):
    query(f"t7_{who}_standings", sql(
        f"SELECT year, dt_ref, {key}, cum_points, {COLS} FROM {who}_standings", f"{who}_standings"),
        )(lambda t, w=who: _standings(t, w))
    query(f"t8_{who}_momentum", sql(
        f"SELECT year, dt_ref, {key}, cum_points, {COLS}, {MOM} FROM {who}_momentum", f"{who}_momentum"),
        )(lambda t, w=who, k=key: st.momentum(_standings(t, w), k))
    query(f"w8_{who}_leader_gap", sql(
        f"SELECT year, dt_ref, leader_gap, leader FROM {who}_leaders", f"{who}_leaders"),
        )(lambda t, w=who, k=key: st.leader_gap(_running(t, w), k))
    query(f"j13_{who}_remaining_points", sql(
        f"SELECT * FROM {who}_remaining", f"{who}_remaining"),
        )(lambda t, k=key: st.remaining_points(t.results, k))
    query(f"t14_{who}_clinch", sql(f"""
        SELECT year, dt_ref, leader_gap, leader, max_remaining_points,
               CASE WHEN leader_gap > max_remaining_points THEN 1 ELSE 0 END AS is_clinched
        FROM {who}_leaders JOIN {who}_remaining USING (year, dt_ref)""", f"{who}_leaders", f"{who}_remaining"),
        )(lambda t, w=who, k=key: st.clinch(st.leader_gap(_running(t, w), k), st.remaining_points(t.results, k)))
    query(f"w4_{who}_running_points", sql(
        f"SELECT year, dt_ref, {key}, points, cum_points FROM {who}_running", f"{who}_running"),
        )(lambda t, w=who: _running(t, w))

query("s6_standings_before_event", sql(
    f"SELECT year, dt_ref, driverid, cum_points, {COLS} FROM driver_standings_before", "driver_standings_before"),
    )(lambda t: st.standings(t.driver_running, "driverid", as_of="before"))

query("s7_standings_carried_forward", sql(f"""
    SELECT c.year, c.dt_ref, driverid, cum_points,
           CAST(rank() OVER (PARTITION BY c.dt_ref ORDER BY cum_points DESC) AS INT) AS standing_position,
           MAX(cum_points) OVER (PARTITION BY c.dt_ref) - cum_points AS points_gap_to_leader,
           round(CAST(cum_points AS DOUBLE) / NULLIF(MAX(cum_points) OVER (PARTITION BY c.dt_ref), 0), 4) AS points_pct_of_leader
    FROM calendar c JOIN (
        SELECT k.dt_ref, s.driverid, CAST(SUM(s.points) AS BIGINT) AS cum_points
        FROM calendar k JOIN scored s ON s.year = k.year AND s.event_date <= k.dt_ref GROUP BY ALL) h
      ON h.dt_ref = c.dt_ref""", "calendar", "scored"),
    )(lambda t: st.carried_standings(t.driver_running, "driverid", st.race_calendar(t.results)))

query("w5_standing_rank", sql(
    "SELECT year, dt_ref, driverid, standing_position FROM driver_standings", "driver_standings"),
    )(lambda t: t.driver_standings.select("year", "dt_ref", "driverid", "standing_position"))

query("w6_gap_and_share", sql(
    "SELECT dt_ref, teamid, points_gap_to_leader, points_pct_of_leader FROM team_standings", "team_standings"),
    )(lambda t: t.team_standings.select("dt_ref", "teamid", "points_gap_to_leader", "points_pct_of_leader"))

query("w7_momentum_lags", sql(
    f"SELECT dt_ref, driverid, {MOM} FROM driver_momentum", "driver_momentum"),
    )(lambda t: st.momentum(t.driver_standings, "driverid").select("dt_ref", "driverid", *[c.strip() for c in MOM.split(",")]))

query("w3_race_calendar", sql("SELECT * FROM calendar", "calendar"))(lambda t: st.race_calendar(t.results))

query("x4_season_fraction", sql("""
    SELECT dt_ref, round(season_race_number / CAST(season_total_races AS DOUBLE), 3) AS season_fraction
    FROM calendar""", "calendar"),
    )(lambda t: st.race_calendar(t.results).select("dt_ref", st.season_fraction().alias("season_fraction")))

query("j17_second_place", sql("""
    SELECT year, dt_ref, pts[2] AS second_points FROM driver_leaders""", "driver_leaders"),
    )(lambda t: st.top_k(t.driver_running, st.EVENT, [F.col("cum_points").desc(), F.col("driverid")], 2, "place")
      .groupBy(*st.EVENT).agg(F.max(F.when(F.col("place") == 2, F.col("cum_points"))).alias("second_points")))

query("f5_offset_one", sql("""
    SELECT DISTINCT year, nth_value(driverid, 2) OVER (PARTITION BY year ORDER BY p DESC, driverid
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS runner_up
    FROM (SELECT year, driverid, SUM(points) AS p FROM scored GROUP BY ALL)""", "scored"),
    )(lambda t: st.top_k(scoring(t.results).groupBy("year", "driverid").agg(F.sum("points").alias("p")),
                         ["year"], [F.col("p").desc(), F.col("driverid")], 2, "place")
      .where("place = 2").select("year", F.col("driverid").alias("runner_up")))

query("g6_leader_arg_max", sql(
    "SELECT year, dt_ref, leader FROM team_leaders", "team_leaders"),
    )(lambda t: t.team_running.groupBy("year", "dt_ref").agg(
        (-F.max(F.struct("cum_points", (-F.col("teamid")).alias("k")))["k"]).alias("leader")))

query("g8_best_event_points", sql("""
    SELECT year, dt_ref, MAX(points) AS max_points FROM team_running GROUP BY ALL""", "team_running"),
    )(lambda t: st.event_points(t.results, "teamid").groupBy("year", "dt_ref").agg(F.max("points").alias("max_points")))

query("g5_filtered_sum", sql("""
    SELECT year, driverid,
           CAST(SUM(points) FILTER (WHERE mode = 'Race') AS BIGINT) AS race_points,
           CAST(SUM(points) FILTER (WHERE month(event_date) > 6) AS BIGINT) AS second_half_points
    FROM scored GROUP BY ALL""", "scored"),
    )(lambda t: scoring(t.results).groupBy("year", "driverid").agg(
        F.expr("sum(points) FILTER (WHERE mode = 'Race')").alias("race_points"),
        F.expr("sum(points) FILTER (WHERE month(event_date) > 6)").alias("second_half_points")))

# -- labels and career ----------------------------------------------------
for fx in ("results", "transfers"):
    scored = f"(SELECT * FROM {fx} WHERE mode IN {SCORING})"
    step(f"{fx}_years", f"SELECT DISTINCT driverid, year FROM {fx}", fx)
    step(f"{fx}_departed", f"""
SELECT a.driverid, a.year, CAST(CASE WHEN b.driverid IS NULL THEN 1 ELSE 0 END AS INT) AS fl_departed
FROM {fx}_years a LEFT JOIN {fx}_years b ON b.driverid = a.driverid AND b.year = a.year + 1
""", f"{fx}_years")
    step(f"{fx}_departed_open", f"""
SELECT driverid, year, CASE WHEN year < (SELECT MAX(year) FROM {fx}_years) THEN fl_departed END AS fl_departed
FROM {fx}_departed""", f"{fx}_departed", f"{fx}_years")
    step(f"{fx}_last", f"SELECT driverid, year, MAX(event_date) AS dt_ref FROM {fx} GROUP BY ALL", fx)
    step(f"{fx}_end_team", f"""
SELECT r.driverid, r.year, MIN(r.teamid) AS teamid
FROM {scored} r JOIN {fx}_last l ON l.driverid = r.driverid AND l.dt_ref = r.event_date GROUP BY ALL
""", fx, f"{fx}_last")
    step(f"{fx}_season", f"""
SELECT driverid, teamid, year, CAST(SUM(points) AS BIGINT) AS pts, AVG(position) AS pos, AVG(grid_position) AS grid,
       COUNT(*) AS n, COUNT(*) FILTER (WHERE is_finished = 0) AS dnf
FROM {scored} GROUP BY ALL""", fx)
    step(f"{fx}_team_season", f"""
SELECT teamid, year, CAST(SUM(pts) AS BIGINT) AS team_pts, AVG(pos) AS team_pos FROM {fx}_season GROUP BY ALL
""", f"{fx}_season")
    for variant, same in (("fanout", ""), ("last_team", "AND d.teamid = e.teamid")):
        step(f"{fx}_mates_{variant}", f"""
SELECT d.driverid, d.year,
       CASE WHEN team_pts > 0 THEN d.pts / CAST(team_pts AS DOUBLE) ELSE 0.5 END AS team_points_share,
       d.pos - team_pos AS teammate_position_gap, d.grid - team_pos AS teammate_grid_gap,
       d.dnf / CAST(d.n AS DOUBLE) AS season_dnf_rate, d.pts AS season_points_current
FROM {fx}_season d JOIN {fx}_end_team e ON e.driverid = d.driverid AND e.year = d.year {same}
JOIN {fx}_team_season t ON t.teamid = e.teamid AND t.year = d.year
""", f"{fx}_season", f"{fx}_team_season", f"{fx}_end_team")
    step(f"{fx}_tenure", f"""
SELECT driverid, teamid, year,
       CAST(row_number() OVER (PARTITION BY driverid, teamid, run ORDER BY year) AS INT) AS team_tenure_years
FROM (SELECT *, SUM(fresh) OVER (PARTITION BY driverid, teamid ORDER BY year) AS run
      FROM (SELECT *, CASE WHEN lag(year) OVER (PARTITION BY driverid, teamid ORDER BY year) = year - 1
                           THEN 0 ELSE 1 END AS fresh
            FROM (SELECT DISTINCT driverid, teamid, year FROM {fx})))""", fx)
    step(f"{fx}_career_teams", f"""
SELECT y.driverid, y.year, COUNT(DISTINCT r.teamid) AS career_distinct_teams
FROM {fx}_years y JOIN {scored} r ON r.driverid = y.driverid AND r.year <= y.year GROUP BY ALL
""", f"{fx}_years", fx)
    step(f"{fx}_achieved", f"""
SELECT l.driverid, l.year, MAX(r.year) FILTER (WHERE position = 1) AS last_win_year,
       MAX(r.year) FILTER (WHERE position <= 3) AS last_podium_year
FROM {fx}_last l JOIN {scored} r ON r.driverid = l.driverid AND r.event_date <= l.dt_ref GROUP BY ALL
""", f"{fx}_last", fx)

    name = "" if fx == "results" else "_transfers"
    data = (lambda t: t.results) if fx == "results" else (lambda t: t.transfers)
    query(f"t13_departure_label{name}", sql(f"SELECT * FROM {fx}_departed", f"{fx}_departed"),
          )(lambda t, d=data: career.departure_label(d(t)))
    query(f"t13_departure_label_open{name}", sql(f"SELECT * FROM {fx}_departed_open", f"{fx}_departed_open"),
          )(lambda t, d=data: career.departure_label(d(t), open_season=True))
    mates = ("driverid, year, round(team_points_share + 1e-9, 6) AS team_points_share, "
             "round(teammate_position_gap + 1e-9, 6) AS teammate_position_gap, "
             "round(teammate_grid_gap + 1e-9, 6) AS teammate_grid_gap, "
             "round(season_dnf_rate + 1e-9, 6) AS season_dnf_rate, season_points_current")
    for variant in ("fanout", "last_team"):
        query(f"t9_teammate_gap_{variant}{name}",
              sql(f"SELECT {mates} FROM {fx}_mates_{variant}", f"{fx}_mates_{variant}"),
              )(lambda t, d=data, v=variant: rounded(career.teammate_gap(d(t), v)))
    query(f"t10_tenure{name}", sql(f"SELECT * FROM {fx}_tenure", f"{fx}_tenure"),
          )(lambda t, d=data: career.tenure(d(t)))
    query(f"t11_career_teams{name}", sql(f"SELECT * FROM {fx}_career_teams", f"{fx}_career_teams"),
          )(lambda t, d=data: career.career_teams(d(t)))
    query(f"t12_last_achievement{name}", sql(f"SELECT * FROM {fx}_achieved", f"{fx}_achieved"),
          )(lambda t, d=data: career.last_achievement(d(t)))
    query(f"w10_season_team{name}", sql(f"SELECT * FROM {fx}_end_team", f"{fx}_end_team"),
          )(lambda t, d=data: career.season_team(d(t)))

query("w9_team_stints", sql("""
    SELECT driverid, teamid, MIN(year) AS first_year, MAX(year) AS last_year, COUNT(*) AS seasons
    FROM (SELECT driverid, teamid, year, year - team_tenure_years AS run FROM transfers_tenure)
    GROUP BY driverid, teamid, run""", "transfers_tenure"),
    )(lambda t: career.tenure(t.transfers).groupBy(
        "driverid", "teamid", (F.col("year") - F.col("team_tenure_years")).alias("run")).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("seasons")).drop("run"))

query("j9_churn_self_join", sql("""
    SELECT year, CAST(SUM(fl_departed) AS BIGINT) AS departed, COUNT(*) AS entrants
    FROM transfers_departed GROUP BY year""", "transfers_departed"),
    )(lambda t: career.departure_label(t.transfers).groupBy("year").agg(
        F.sum("fl_departed").alias("departed"), F.count(F.lit(1)).alias("entrants")))

query("j15_open_season_scalar", sql("""
    SELECT driverid, year, fl_departed FROM transfers_departed_open
    WHERE year >= (SELECT MAX(year) FROM transfers) - 1""", "transfers_departed_open", "transfers"),
    )(lambda t: career.departure_label(t.transfers, open_season=True)
      .where(F.col("year") >= t.transfers.agg(F.max("year")).first()[0] - 1))

step("so_far", """
SELECT c.dt_ref, r.driverid, r.teamid, CAST(SUM(r.points) AS BIGINT) AS pts, AVG(r.position) AS pos,
       AVG(r.grid_position) AS grid, COUNT(*) AS n, COUNT(*) FILTER (WHERE r.is_finished = 0) AS dnf
FROM calendar c JOIN scored r ON r.year = c.year AND r.event_date < c.dt_ref GROUP BY ALL
""", "calendar", "scored")
step("mates_so_far", """
SELECT d.dt_ref, d.driverid,
       CASE WHEN t.pts > 0 THEN d.pts / CAST(t.pts AS DOUBLE) ELSE 0.5 END AS team_points_share,
       d.pos - t.pos AS teammate_position_gap, d.grid - t.pos AS teammate_grid_gap,
       d.dnf / CAST(d.n AS DOUBLE) AS season_dnf_rate, d.pts AS season_points_current
FROM so_far d
JOIN (SELECT DISTINCT event_date AS dt_ref, driverid, teamid FROM scored) now USING (dt_ref, driverid, teamid)
JOIN (SELECT dt_ref, teamid, CAST(SUM(pts) AS BIGINT) AS pts, AVG(pos) AS pos FROM so_far GROUP BY ALL) t
  USING (dt_ref, teamid)
""", "so_far", "scored")
step("teams_so_far", """
SELECT c.dt_ref, r.driverid, COUNT(DISTINCT r.teamid) AS career_distinct_teams
FROM calendar c JOIN scored r ON r.event_date < c.dt_ref GROUP BY ALL""", "calendar", "scored")
step("achieved_so_far", """
SELECT c.dt_ref, r.driverid, MAX(CASE WHEN position = 1 THEN r.year END) AS last_win_year,
       MAX(CASE WHEN position <= 3 THEN r.year END) AS last_podium_year
FROM calendar c JOIN scored r ON r.event_date < c.dt_ref GROUP BY ALL""", "calendar", "scored")

MATES = ("round(team_points_share + 1e-9, 6) AS team_points_share, "
         "round(teammate_position_gap + 1e-9, 6) AS teammate_position_gap, "
         "round(teammate_grid_gap + 1e-9, 6) AS teammate_grid_gap, "
         "round(season_dnf_rate + 1e-9, 6) AS season_dnf_rate, season_points_current")
query("t9_teammate_gap_inseason", sql(f"SELECT dt_ref, driverid, {MATES} FROM mates_so_far", "mates_so_far"),
      )(lambda t: rounded(career.teammate_gap_inseason(t.results)))
query("t11_career_teams_inseason", sql("SELECT * FROM teams_so_far", "teams_so_far"),
      )(lambda t: career.career_teams_inseason(t.results))
query("t12_last_achievement_inseason", sql("SELECT * FROM achieved_so_far", "achieved_so_far"),
      )(lambda t: career.last_achievement_inseason(t.results))
query("j2_season_to_date", sql("""
    SELECT dt_ref, driverid, teamid, pts AS season_points, n AS season_races, dnf AS season_dnfs FROM so_far""", "so_far"),
    )(lambda t: career.season_so_far(t.results).select(
        "dt_ref", "driverid", "teamid", "season_points", "season_races", "season_dnfs"))
query("j14_team_totals", sql("""
    SELECT d.driverid, d.year, d.teamid, team_pts AS team_total_points, round(team_pos + 1e-9, 6) AS team_avg_position
    FROM transfers_season d JOIN transfers_team_season USING (teamid, year)""", "transfers_season", "transfers_team_season"),
    )(lambda t: rounded((lambda s: s.select("driverid", "year", "teamid").join(
        career._team_totals(s, ["teamid", "year"]), ["teamid", "year"]))(
        scoring(t.transfers).groupBy("driverid", "teamid", "year").agg(*career._season_sums()))))
query("j3_career_to_date", sql("""
    SELECT c.dt_ref, r.driverid, CAST(SUM(r.points) AS BIGINT) AS career_points, COUNT(*) AS career_sessions
    FROM calendar c JOIN scored r ON r.event_date < c.dt_ref GROUP BY ALL""", "calendar", "scored"),
    )(lambda t: career.career_to_date(t.results))
query("j10_calendar_join", sql("""
    SELECT DISTINCT r.driverid, c.dt_ref, season_race_number, season_total_races
    FROM scored r JOIN calendar c ON c.dt_ref = r.event_date""", "scored", "calendar"),
    )(lambda t: scoring(t.results).select("driverid", F.col("event_date").alias("dt_ref")).distinct()
      .join(small(st.race_calendar(t.results)), "dt_ref").drop("year"))
query("g10_season_totals", sql("""
    SELECT driverid, teamid, year, pts AS season_points, round(pos + 1e-9, 6) AS season_avg_position,
           round(grid + 1e-9, 6) AS season_avg_grid, n AS season_races, dnf AS season_dnfs
    FROM transfers_season""", "transfers_season"),
    )(lambda t: rounded(scoring(t.transfers).groupBy("driverid", "teamid", "year").agg(*career._season_sums())))
query("g7_last_win_year", sql("""
    SELECT driverid, MAX(CASE WHEN position = 1 THEN year END) AS last_win_year,
           MAX(CASE WHEN position <= 3 THEN year END) AS last_podium_year
    FROM scored GROUP BY driverid""", "scored"),
    )(lambda t: scoring(t.results).groupBy("driverid").agg(
        F.max(F.when(F.col("position") == 1, F.col("year"))).alias("last_win_year"),
        F.max(F.when(F.col("position") <= 3, F.col("year"))).alias("last_podium_year")))
query("u1_team_history_union", sql("""
    SELECT y.driverid, y.year, r.teamid FROM transfers_years y JOIN transfers r
      ON r.driverid = y.driverid AND r.year = y.year
    UNION
    SELECT y.driverid, y.year, r.teamid FROM transfers_years y JOIN transfers r
      ON r.driverid = y.driverid AND r.year < y.year""", "transfers_years", "transfers"),
    )(lambda t: career.team_history(t.transfers))
step("births", """
SELECT s_suppkey AS driverid,
       CASE WHEN s_suppkey % 17 <> 0 THEN DATE '1960-01-01' + CAST(s_suppkey % 9000 AS INT) END AS date_of_birth
FROM supplier""")
query("x3_age", sql("""
    SELECT driverid, year, round(datediff('day', date_of_birth, dt_ref) / 365.25, 1) AS driver_age
    FROM results_last JOIN births USING (driverid)""", "results_last", "births"),
    )(lambda t: career.season_ages(t.results, t.births))
