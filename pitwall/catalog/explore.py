"""Console and explorer queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from pitwall.catalog import query, rounded, tables  # noqa: F401
from pitwall.catalog.oracle import SCORING, sql, step
from pitwall.catalog.tables import rr
from pitwall.functions.metrics import GROUPS
from pitwall.operators import career
from pitwall.operators.features import WINDOWS, scoring
from pitwall.operators.ordering import top_k
from pitwall.plans import explore as ex
from pitwall.sources.console import run_sql

Y = 1999
step("races", "SELECT * FROM results WHERE mode = 'Race'", "results")
step("names", """
SELECT driverid, full_name, team_name, team_color FROM results
QUALIFY row_number() OVER (PARTITION BY driverid ORDER BY event_date DESC, round_number DESC, mode DESC) = 1""", "results")

query("q1_most_races", sql("""
    SELECT driverid, full_name, COUNT(*) AS races FROM races GROUP BY ALL ORDER BY races DESC, driverid LIMIT 20""", "races"),
    )(lambda t: ex.most_races(t.results))
query("q2_season_points", sql(f"""
    SELECT driverid, full_name, team_name, CAST(SUM(points) AS BIGINT) AS total_points
    FROM races WHERE year = {Y} GROUP BY ALL""", "races"))(lambda t: ex.season_points(t.results, Y))
query("q3_dnf_rate", sql("""
    SELECT driverid, full_name, COUNT(*) AS races, CAST(SUM(1 - is_finished) AS BIGINT) AS dnfs,
           round(SUM(1 - is_finished) * 100 / CAST(COUNT(*) AS DOUBLE), 1) AS dnf_pct
    FROM races GROUP BY driverid, full_name HAVING COUNT(*) >= 50 ORDER BY dnf_pct DESC, driverid LIMIT 20""", "races"),
    )(lambda t: ex.dnf_rate(t.results))
query("q4_wet_races", sql("""
    SELECT year, event_name, driverid, full_name, team_name, grid_position, position, points, air_temp, humidity
    FROM races WHERE rainfall = 1 ORDER BY year DESC, position, event_name LIMIT 50""", "races"),
    )(lambda t: ex.wet_races(t.results))
query("q5_circuit_weather", sql("""
    SELECT location, country, COUNT(DISTINCT year) AS seasons, round(AVG(air_temp), 1) AS avg_air_temp,
           round(AVG(track_temp), 1) AS avg_track_temp, round(AVG(humidity), 1) AS avg_humidity,
           round(AVG(wind_speed), 1) AS avg_wind_speed, CAST(SUM(rainfall) AS BIGINT) AS rain_sessions
    FROM races WHERE air_temp IS NOT NULL GROUP BY ALL""", "races"))(lambda t: ex.circuit_weather(t.results))
query("q6_team_wins", sql("""
    SELECT * FROM (SELECT year, team_name, COUNT(*) FILTER (WHERE position = 1) AS wins FROM races GROUP BY ALL)
    WHERE wins > 0""", "races"))(lambda t: ex.team_wins(t.results))
query("q7_pole_conversion", sql("""
    SELECT driverid, full_name, COUNT(*) AS poles, COUNT(*) FILTER (WHERE position = 1) AS pole_wins,
           round(COUNT(*) FILTER (WHERE position = 1) * 100 / CAST(COUNT(*) AS DOUBLE), 1) AS conversion_pct
    FROM races WHERE grid_position = 1 GROUP BY ALL HAVING COUNT(*) >= 3""", "races"),
    )(lambda t: ex.pole_conversion(t.results))
query("q8_overtakers", sql("""
    SELECT driverid, full_name, COUNT(*) AS races, round(AVG(grid_position - position), 2) AS avg_positions_gained,
           MAX(grid_position - position) AS best_recovery
    FROM races WHERE is_finished = 1 GROUP BY driverid, full_name HAVING COUNT(*) >= 30
    ORDER BY avg_positions_gained DESC, driverid LIMIT 20""", "races"))(lambda t: ex.overtakers(t.results))
query("q9_feature_evolution", sql(f"""
    SELECT dt_ref, qtd_wins_life, qtd_podiums_life, total_points_life, {rr(['avg_position_life'])}
    FROM fs_all WHERE driverid = 7 ORDER BY dt_ref DESC LIMIT 20""", "fs_all"),
    )(lambda t: rounded(ex.evolution(t.features, 7, ["qtd_wins_life", "qtd_podiums_life", "total_points_life", "avg_position_life"])))
query("q10_latest_top5", sql(f"""
    SELECT driverid, qtd_wins_last10, qtd_podiums_last10, {rr(['avg_position_last10'])}, total_points_last10
    FROM fs_all f WHERE dt_ref = (SELECT MAX(dt_ref) FROM fs_all g WHERE g.driverid = f.driverid)
    ORDER BY total_points_last10 DESC, driverid LIMIT 5""", "fs_all"),
    )(lambda t: rounded(ex.first(ex.newest_rows(t.only(
        "features", "dt_ref", "driverid", "qtd_wins_last10", "qtd_podiums_last10", "avg_position_last10", "total_points_last10"), "driverid").select(
        "driverid", "qtd_wins_last10", "qtd_podiums_last10", "avg_position_last10", "total_points_last10"),
        [F.desc("total_points_last10"), F.col("driverid")], 5)))
query("q11_positive_sample", sql("""
    SELECT dt_ref, driverid, fl_champion, qtd_wins_life, total_points_last20 FROM t1
    WHERE fl_champion = 1 ORDER BY dt_ref DESC, driverid LIMIT 20""", "t1"),
    )(lambda t: ex.first(t.only(
        "abt_champions", "dt_ref", "driverid", "fl_champion", "qtd_wins_life", "total_points_last20").where("fl_champion = 1"), [F.desc("dt_ref"), F.col("driverid")], 20))


def class_balance(t):
    from functools import reduce
    parts = [("champion", "abt_champions", "fl_champion"), ("constructor", "abt_teams", "fl_constructor_champion"),
             ("departure", "abt_departures", "fl_departed")]
    parts = [(n, t.only(a, c), c) for n, a, c in parts]
    rows = [df.agg(F.sum(c).alias("positives"), F.count(F.lit(1)).alias("total"),
                   ex.pct(F.sum(c), F.count(F.lit(1)), 2).alias("pct")).withColumn("abt", F.lit(n)) for n, df, c in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


_BALANCE = " UNION ALL ".join(
    f"SELECT '{n}' AS abt, CAST(SUM({c}) AS BIGINT) AS positives, COUNT(*) AS total, "
    f"round(SUM({c}) * 100 / CAST(COUNT(*) AS DOUBLE), 2) AS pct FROM {tb}"
    for n, c, tb in (("champion", "fl_champion", "t1"), ("constructor", "fl_constructor_champion", "t2"),
                     ("departure", "fl_departed", "t5")))
query("q12_class_balance", sql(_BALANCE, "t1", "t2", "t5"))(class_balance)
query("u2_union_all", sql(_BALANCE, "t1", "t2", "t5"))(class_balance)

query("q13_standings_by_race", sql(f"""
    SELECT dt_ref, driverid, standing_position, round(points_pct_of_leader, 3) AS points_pct_of_leader,
           gap_momentum_3r, points_accel, qtd_wins_last10, qtd_podiums_last10, total_points_last10,
           round(avg_position_last10 + 1e-9, 2) AS avg_position_last10
    FROM t3 WHERE year(dt_ref) = {Y} AND standing_position <= 5""", "t3"),
    )(lambda t: ex.season_of(t.by_season(
        "abt_champions_inseason", "dt_ref", "driverid", "standing_position", "points_pct_of_leader", "gap_momentum_3r", "points_accel",
        "qtd_wins_last10", "qtd_podiums_last10", "total_points_last10", "avg_position_last10"), Y).where(F.col("standing_position") <= 5).select(
        "dt_ref", "driverid", "standing_position", F.round("points_pct_of_leader", 3).alias("points_pct_of_leader"),
        "gap_momentum_3r", "points_accel", "qtd_wins_last10", "qtd_podiums_last10", "total_points_last10",
        F.round(F.col("avg_position_last10") + 1e-9, 2).alias("avg_position_last10")))


def interactions(df, prefix, key, place, label):
    cols = {f"max_ldr_x_{n}": F.max(F.round(f"{prefix}pct_leader_x_{n}", 3)) for n in ("wins", "podiums", "points")}
    return df.where(F.col(label) == 1).groupBy(F.year("dt_ref").cast("bigint").alias("season"), key, label).agg(
        *[c.alias(n) for n, c in cols.items()], F.min(place).alias("best_standing"))


def _interactions_sql(tb, prefix, key, place, label):
    cols = ", ".join(f"MAX(round({prefix}pct_leader_x_{n}, 3)) AS max_ldr_x_{n}" for n in ("wins", "podiums", "points"))
    return (f"SELECT year(dt_ref) AS season, {key}, {label}, {cols}, MIN({place}) AS best_standing "
            f"FROM {tb} WHERE {label} = 1 GROUP BY ALL")


query("q14_champion_interactions", sql(_interactions_sql("t3", "", "driverid", "standing_position", "fl_champion"), "t3"),
      )(lambda t: interactions(t.only("abt_champions_inseason", "dt_ref", "driverid", "fl_champion", "standing_position", *[
          f"pct_leader_x_{n}" for n in ("wins", "podiums", "points")]), "", "driverid", "standing_position", "fl_champion"))
_LEAD = f"""
    SELECT dt_ref, driverid, standing_position, gap_momentum_3r, points_accel,
           CAST(row_number() OVER (PARTITION BY dt_ref ORDER BY gap_momentum_3r DESC, driverid) AS INT) AS momentum_rank
    FROM t3 WHERE year(dt_ref) = {Y} QUALIFY momentum_rank <= 3"""


def momentum_leaders(t):
    rows = ex.season_of(t.by_season("abt_champions_inseason", "dt_ref", "driverid", "standing_position", "gap_momentum_3r", "points_accel"), Y).select(
        "dt_ref", "driverid", "standing_position", "gap_momentum_3r", "points_accel")
    return top_k(rows, ["dt_ref"], [F.desc_nulls_last("gap_momentum_3r"), F.col("driverid")], 3, "momentum_rank")


query("q15_momentum_leaders", sql(_LEAD, "t3"))(momentum_leaders)
query("w17_momentum_top3", sql(_LEAD, "t3"))(momentum_leaders)
query("q16_team_standings_by_race", sql(f"""
    SELECT dt_ref, team_name, team_standing_position, round(team_points_pct_of_leader, 3) AS team_pct_leader,
           team_points_accel, sum_wins_last10, sum_podiums_last10, sum_points_last10,
           round(avg_position_last10 + 1e-9, 2) AS avg_pos_l10
    FROM t4 WHERE year(dt_ref) = {Y} AND team_standing_position <= 5""", "t4"),
    )(lambda t: ex.season_of(t.by_season(
        "abt_teams_inseason", "dt_ref", "team_name", "team_standing_position", "team_points_pct_of_leader", "team_points_accel",
        "sum_wins_last10", "sum_podiums_last10", "sum_points_last10", "avg_position_last10"), Y).where(F.col("team_standing_position") <= 5).select(
        "dt_ref", "team_name", "team_standing_position", F.round("team_points_pct_of_leader", 3).alias("team_pct_leader"),
        "team_points_accel", "sum_wins_last10", "sum_podiums_last10", "sum_points_last10",
        F.round(F.col("avg_position_last10") + 1e-9, 2).alias("avg_pos_l10")))
query("q17_team_interactions", sql(
    _interactions_sql("t4", "team_", "team_name", "team_standing_position", "fl_constructor_champion"), "t4"),
    )(lambda t: interactions(t.only("abt_teams_inseason", "dt_ref", "team_name", "team_standing_position", "fl_constructor_champion", *[
        f"team_pct_leader_x_{n}" for n in ("wins", "podiums", "points")]), "team_", "team_name", "team_standing_position", "fl_constructor_champion"))

_RISK = """driverid, driver_age, team_tenure_years, career_distinct_teams, seasons_since_last_win,
    seasons_since_last_podium, round(teammate_position_gap + 1e-9, 2) AS teammate_pos_gap,
    round(team_points_share + 1e-9, 3) AS team_pts_share, round(season_dnf_rate + 1e-9, 3) AS dnf_rate, fl_departed"""
_RISK_INPUTS = ["dt_ref", "driverid", "driver_age", "team_tenure_years", "career_distinct_teams", "seasons_since_last_win",
                "seasons_since_last_podium", "teammate_position_gap", "team_points_share", "season_dnf_rate", "fl_departed"]
query("q18_risk_profile", sql(f"""
    SELECT {_RISK} FROM t6 f WHERE dt_ref = (SELECT MAX(dt_ref) FROM t6 g WHERE g.driverid = f.driverid AND year(dt_ref) = {Y})
    """, "t6"),
    )(lambda t: ex.newest_rows(ex.season_of(t.by_season("abt_departures_inseason", *_RISK_INPUTS), Y), "driverid").selectExpr(
        *["driverid", "driver_age", "team_tenure_years", "career_distinct_teams", "seasons_since_last_win",
         "seasons_since_last_podium", "round(teammate_position_gap + 1e-9D, 2) AS teammate_pos_gap",
         "round(team_points_share + 1e-9D, 3) AS team_pts_share", "round(season_dnf_rate + 1e-9D, 3) AS dnf_rate",
         "fl_departed"]))
query("q19_teammate_dynamics", sql(f"""
    SELECT dt_ref, driverid, round(teammate_position_gap + 1e-9, 2) AS teammate_pos_gap,
           round(teammate_grid_gap + 1e-9, 2) AS teammate_grid_gap, round(team_points_share + 1e-9, 3) AS team_pts_share,
           season_points_current
    FROM t6 WHERE year(dt_ref) = {Y} AND driverid IN (3, 5, 8)""", "t6"),
    )(lambda t: ex.season_of(t.by_season(
        "abt_departures_inseason", "dt_ref", "driverid", "teammate_position_gap", "teammate_grid_gap", "team_points_share",
        "season_points_current"), Y).where(F.col("driverid").isin(3, 5, 8)).selectExpr(
        "dt_ref", "driverid", "round(teammate_position_gap + 1e-9D, 2) AS teammate_pos_gap",
        "round(teammate_grid_gap + 1e-9D, 2) AS teammate_grid_gap", "round(team_points_share + 1e-9D, 3) AS team_pts_share",
        "season_points_current"))
query("q20_departed_trends", sql("""
    SELECT driverid, year(dt_ref) AS season, round(trend_win_rate + 1e-9, 4) AS trend_win_rate,
           round(trend_podium_rate + 1e-9, 4) AS trend_podium_rate, round(avg_position_last10 + 1e-9, 2) AS avg_pos_l10,
           total_points_last10, driver_age, team_tenure_years
    FROM t5 f WHERE fl_departed = 0
      AND dt_ref = (SELECT MAX(dt_ref) FROM t5 g WHERE g.driverid = f.driverid AND fl_departed = 0)""", "t5"),
    )(lambda t: ex.newest_rows(t.only(
        "abt_departures", "dt_ref", "driverid", "fl_departed", "trend_win_rate", "trend_podium_rate", "avg_position_last10",
        "total_points_last10", "driver_age", "team_tenure_years").where("fl_departed = 0"), "driverid").selectExpr(
        "driverid", "bigint(year(dt_ref)) AS season", "round(trend_win_rate + 1e-9D, 4) AS trend_win_rate",
        "round(trend_podium_rate + 1e-9D, 4) AS trend_podium_rate", "round(avg_position_last10 + 1e-9D, 2) AS avg_pos_l10",
        "total_points_last10", "driver_age", "team_tenure_years"))
query("q21_longevity", sql("""
    SELECT fl_departed, round(AVG(driver_age) + 1e-9, 1) AS avg_age, round(AVG(team_tenure_years) + 1e-9, 1) AS avg_tenure,
           round(AVG(career_distinct_teams) + 1e-9, 1) AS avg_teams,
           round(AVG(seasons_since_last_win) + 1e-9, 1) AS avg_seasons_since_win,
           round(AVG(teammate_position_gap) + 1e-9, 2) AS avg_teammate_gap, COUNT(DISTINCT driverid) AS n_drivers
    FROM t6 f WHERE fl_departed IS NOT NULL AND dt_ref = (
        SELECT MAX(dt_ref) FROM t6 g WHERE g.driverid = f.driverid AND year(g.dt_ref) = year(f.dt_ref))
    GROUP BY fl_departed""", "t6"),
    )(lambda t: ex.latest(t.only("abt_departures_inseason", *_RISK_INPUTS).withColumn("season", F.year("dt_ref")), ["driverid", "season"],
                          [F.desc("dt_ref")]).where("fl_departed IS NOT NULL").groupBy("fl_departed").agg(
        *[F.round(F.avg(c) + 1e-9, d).alias(n) for n, c, d in (
            ("avg_age", "driver_age", 1), ("avg_tenure", "team_tenure_years", 1), ("avg_teams", "career_distinct_teams", 1),
            ("avg_seasons_since_win", "seasons_since_last_win", 1), ("avg_teammate_gap", "teammate_position_gap", 2))],
        F.countDistinct("driverid").alias("n_drivers")))

_METRIC = ex.metric_column("Points", "last10")
query("q22_explorer_drivers", sql(f"""
    SELECT dt_ref, f.driverid, {_METRIC}, COALESCE(full_name, CAST(f.driverid AS VARCHAR)) AS full_name, team_name
    FROM fs_all f LEFT JOIN names n ON n.driverid = f.driverid WHERE year(dt_ref) BETWEEN 1998 AND 1999""", "fs_all", "names"),
    )(lambda t: ex.explorer(t.only("features", "dt_ref", "driverid", _METRIC), t.results, _METRIC, (1998, 1999)))
query("q22_explorer_teams", sql("""
    SELECT dt_ref, team_name, round(AVG(avg_grid_life) + 1e-9, 6) AS avg_grid_life
    FROM fs_all f LEFT JOIN names n ON n.driverid = f.driverid WHERE year(dt_ref) = 1999 GROUP BY ALL""", "fs_all", "names"),
    )(lambda t: rounded(ex.explorer(t.only("features", "dt_ref", "driverid", "avg_grid_life"), t.results, ex.metric_column("Avg Grid Position", "life"), (1999, 1999), "team")))
# All groups in all windows; of a group whose columns are means the values are rounded.
_COUNTED = """total_points total_points_race total_points_sprint qtd_wins qtd_wins_race qtd_wins_sprint qtd_podiums qtd_podiums_race
    qtd_podiums_sprint qtd_top5 qtd_top5_race qtd_top5_sprint qtd_poles qtd_poles_race qtd_poles_sprint qtd_pole_win qtd_pole_win_race
    qtd_pole_win_sprint qtd_sessions qtd_finished qtd_race qtd_sprint qtd_sessions_with_points qtd_sessions_with_overtake
    qtd_sessions_rain""".split()
_MEANT = """avg_grid avg_grid_race avg_grid_sprint avg_position avg_position_race avg_position_sprint avg_overtakes avg_overtakes_race
    avg_overtakes_sprint avg_air_temp avg_track_temp avg_humidity avg_pressure avg_wind_speed pct_sessions_rain""".split()
query("b16_metric_group_columns", sql(f"""
    SELECT dt_ref, driverid, {', '.join([f'{m}_{k}' for k in ('life', 'last10', 'last20', 'last40') for m in _COUNTED]
                                        + [f'round({m}_{k} + 1e-9, 6) AS {m}_{k}' for k in ('life', 'last10', 'last20', 'last40') for m in _MEANT])}
    FROM fs_all""", "fs_all"),
    )(lambda t: rounded(t.only("features", "dt_ref", "driverid", *[
        ex.metric_column(g, k, i) for k in WINDOWS for g in GROUPS for i in range(len(GROUPS[g]))])))


def _last_sql(tb, key, cols, where):
    picks = ", ".join(f"arg_max({c}, dt_ref) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    return f"SELECT {key}, {picks} FROM {tb} WHERE {where} GROUP BY {key}"


query("q23_champion_feature_leaders", sql(f"""
    SELECT driverid, standing_position, {rr(['avg_position_last10'])}, points_accel, gap_momentum_3r FROM (
    {_last_sql('t3', 'driverid', ['standing_position', 'avg_position_last10', 'points_accel', 'gap_momentum_3r'], f'year(dt_ref) = {Y}')})
    ORDER BY standing_position, driverid LIMIT 6""", "t3"),
    )(lambda t: rounded(ex.leading(ex.season_of(t.by_season(
        "abt_champions_inseason", "dt_ref", "driverid", "standing_position", "avg_position_last10", "points_accel", "gap_momentum_3r"), Y), "driverid", "standing_position", 6,
                                   ["avg_position_last10", "points_accel", "gap_momentum_3r"])))
query("q23_team_feature_leaders", sql(f"""
    SELECT team_name, team_standing_position, sum_wins_last10, {rr(['avg_grid_last10'])} FROM (
    {_last_sql('t4', 'team_name', ['team_standing_position', 'sum_wins_last10', 'avg_grid_last10'], f'year = {Y}')})
    ORDER BY team_standing_position, team_name LIMIT 5""", "t4"),
    )(lambda t: rounded(ex.leading(t.only(
        "abt_teams_inseason", "dt_ref", "year", "team_name", "team_standing_position", "sum_wins_last10", "avg_grid_last10").where(F.col("year") == Y), "team_name", "team_standing_position", 5,
                                   ["sum_wins_last10", "avg_grid_last10"])))
query("w13_last_non_null", sql(
    _last_sql("results", "driverid", ["air_temp", "points", "position"], "mode = 'Race'").replace("dt_ref", "event_date"), "results"),
    )(lambda t: ex.last_values(ex.races(t.results), "driverid", ["air_temp", "points", "position"], "event_date"))

from pitwall.plans.training import CHAMPION_FEATURES, DEPARTURE_FEATURES, TEAM_EXPLORER_FEATURES, TEAM_FEATURES


def _corr_sql(tb, cols, where):
    def one(a, b):
        ok = f"MIN({a}) < MAX({a}) AND MIN({b}) < MAX({b})"
        return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CASE WHEN {ok} THEN round(corr({a}, {b}) + 1e-9, 6) END AS corr FROM x"
    return (f"SELECT * FROM ({' UNION ALL '.join(one(a, b) for a in cols for b in cols)})",
            f"SELECT {', '.join(cols)} FROM {tb} WHERE {where}")


_CORR_C, _x = _corr_sql("t3", CHAMPION_FEATURES, f"year(dt_ref) = {Y}")
step("x", _x, "t3")
query("q24_champion_feature_correlation", sql(_CORR_C, "x"))(
    lambda t: rounded(ex.correlations(ex.season_of(t.by_season("abt_champions_inseason", "dt_ref", *CHAMPION_FEATURES), Y), CHAMPION_FEATURES)))
_CORR_T, _x2 = _corr_sql("t4", TEAM_EXPLORER_FEATURES, f"year = {Y}")
step("x2", _x2, "t4")
query("g15_correlation_matrix", sql(_CORR_T.replace("FROM x", "FROM x2"), "x2"))(
    lambda t: rounded(ex.correlations(t.only("abt_teams_inseason", "year", *TEAM_EXPLORER_FEATURES).where(F.col("year") == Y), TEAM_EXPLORER_FEATURES)))
query("q25_season_end_ranking", sql(f"""
    SELECT driverid, {rr(['season_dnf_rate', 'team_points_share'])} FROM (
    {_last_sql('t6', 'driverid', ['season_dnf_rate', 'team_points_share'], f'year(dt_ref) = {Y}')})""", "t6"),
    )(lambda t: rounded(ex.last_values(ex.season_of(t.by_season("abt_departures_inseason", "dt_ref", "driverid", "season_dnf_rate", "team_points_share"), Y), "driverid",
                                       ["season_dnf_rate", "team_points_share"]).orderBy(F.desc("season_dnf_rate"))))
_BOX = """
    SELECT year, MIN(p) AS low, MAX(p) AS high, round(quantile_cont(p, 0.25) + 1e-9, 6) AS q1,
           round(quantile_cont(p, 0.5) + 1e-9, 6) AS median, round(quantile_cont(p, 0.75) + 1e-9, 6) AS q3
    FROM (SELECT year, driverid, CAST(SUM(points) AS BIGINT) AS p FROM races WHERE year BETWEEN 1996 AND 2001 GROUP BY ALL)
    GROUP BY year"""
query("q26_points_distribution", sql(_BOX, "races"))(lambda t: rounded(ex.points_distribution(t.results, (1996, 2001))))
query("g14_box_summary", sql(_BOX, "races"))(lambda t: rounded(ex.points_distribution(t.results, (1996, 2001))))
_RATE = """
    SELECT r.driverid, r.full_name, r.event_date, COUNT(*) AS cum_races,
           COUNT(*) FILTER (WHERE p.position = 1) AS cum_wins,
           round(COUNT(*) FILTER (WHERE p.position = 1) / CAST(COUNT(*) AS DOUBLE) + 1e-9, 6) AS win_rate
    FROM races r JOIN races p ON p.driverid = r.driverid AND p.event_date <= r.event_date
    GROUP BY r.driverid, r.full_name, r.event_date"""
query("q27_win_rate", sql(_RATE, "races"))(lambda t: rounded(ex.cumulative_win_rate(t.results)))
query("w11_cumulative_rate", sql(_RATE, "races"))(lambda t: rounded(ex.cumulative_win_rate(t.results)))
query("q28_team_points", sql("""
    SELECT year, team_name, CAST(SUM(points) AS BIGINT) AS points FROM races WHERE year BETWEEN 1998 AND 2001 GROUP BY ALL""", "races"),
    )(lambda t: ex.team_points(t.results, (1998, 2001)))
query("q29_grid_vs_finish", sql(f"""
    SELECT driverid, event_name, team_name, grid_position, position,
           CASE WHEN overtakes > 0 THEN '+' ELSE '' END || CAST(overtakes AS VARCHAR) AS gained,
           CASE sign(overtakes) WHEN 1 THEN 'gained' WHEN -1 THEN 'lost' ELSE 'held' END AS change
    FROM races WHERE year = {Y}""", "races"))(lambda t: ex.grid_vs_finish(t.results, Y))
query("q30_average_finish", sql(
    "SELECT year, full_name, round(AVG(position) + 1e-9, 6) AS position FROM races GROUP BY ALL", "races"),
    )(lambda t: rounded(ex.average_finish(t.results)))
_PROG = f"""
    WITH best AS (SELECT driverid FROM races WHERE year = {Y} GROUP BY driverid ORDER BY SUM(points) DESC, driverid LIMIT 10)
    SELECT a.driverid, a.round_number, CAST(SUM(b.points) AS BIGINT) AS cum_points
    FROM races a JOIN races b ON b.driverid = a.driverid AND b.year = a.year AND b.round_number <= a.round_number
    WHERE a.year = {Y} AND a.driverid IN (SELECT driverid FROM best) GROUP BY ALL"""
query("q31_season_progression", sql(f"SELECT * FROM ({_PROG})", "races"))(lambda t: ex.season_progression(t.results, Y))
query("w12_running_by_round", sql(f"SELECT * FROM ({_PROG})", "races"))(lambda t: ex.season_progression(t.results, Y))
_NOW_SQL = sql("""
    SELECT *, CAST(row_number() OVER (ORDER BY total_points DESC, driverid) AS INT) AS pos FROM (
    SELECT driverid, full_name, team_name, team_color, CAST(SUM(points) AS BIGINT) AS total_points, COUNT(*) AS races,
           COUNT(*) FILTER (WHERE position = 1) AS wins, COUNT(*) FILTER (WHERE position <= 3) AS podiums,
           round(AVG(position), 1) AS avg_position
    FROM races WHERE year = (SELECT MAX(year) FROM races) GROUP BY ALL)""", "races")
query("q32_current_standings", _NOW_SQL)(lambda t: ex.current_standings(t.results))
query("f6_running_position", _NOW_SQL)(lambda t: ex.current_standings(t.results))
query("q33_season_events", sql("""
    SELECT DISTINCT round_number, event_name, event_date, year FROM races WHERE year = (SELECT MAX(year) FROM races)""", "races"),
    )(lambda t: ex.season_events(t.results))
query("j16_current_season_join", sql("""
    SELECT team_name, CAST(SUM(points) AS BIGINT) AS points FROM races
    WHERE year = (SELECT MAX(year) FROM races) GROUP BY ALL""", "races"),
    )(lambda t: ex.current_season(t.results).groupBy("team_name").agg(F.sum("points").alias("points")))

# -- predictions over fixture probabilities ------------------------------------
PROB = "CAST(((driverid * 7919 + dayofyear(dt_ref) * 104729 + year(dt_ref)) % 1000) AS DOUBLE) / 1000"
step("guess", f"SELECT dt_ref, driverid, standing_position, fl_champion, {PROB} AS prob FROM t3", "t3")


def guesses(t):
    return t.only("abt_champions_inseason", "dt_ref", "driverid", "standing_position", "fl_champion").select(
        "*", F.expr(PROB).alias("prob"))


query("w14_top_pick", sql("""
    SELECT dt_ref, driverid, prob FROM guess
    QUALIFY row_number() OVER (PARTITION BY dt_ref ORDER BY prob DESC, driverid) = 1""", "guess"),
    )(lambda t: ex.top_pick(guesses(t), "driverid", "prob").select("dt_ref", "driverid", "prob"))
query("w16_standing_leader", sql("""
    SELECT dt_ref, driverid, prob FROM guess WHERE standing_position = 1
    QUALIFY row_number() OVER (PARTITION BY dt_ref ORDER BY prob DESC, driverid) = 1""", "guess"),
    )(lambda t: ex.standing_leader(guesses(t), "driverid", "prob", "standing_position").select("dt_ref", "driverid", "prob"))
query("q35_top1_evolution", sql("""
    SELECT 'pick' AS series, dt_ref, driverid, prob FROM guess
    QUALIFY row_number() OVER (PARTITION BY dt_ref ORDER BY prob DESC, driverid) = 1
    UNION ALL SELECT 'champion', dt_ref, driverid, prob FROM guess WHERE fl_champion = 1
    UNION ALL (SELECT 'leader', dt_ref, driverid, prob FROM guess WHERE standing_position = 1
    QUALIFY row_number() OVER (PARTITION BY dt_ref ORDER BY prob DESC, driverid) = 1)""", "guess"),
    )(lambda t: ex.top1_evolution(guesses(t), t.champions, "driverid", "prob", "standing_position"))
_LATEST = sql("""
    SELECT driverid, prob, printf('%.2f%%', prob * 100) AS label FROM guess
    WHERE dt_ref = (SELECT MAX(dt_ref) FROM guess) ORDER BY prob DESC, driverid LIMIT 5""", "guess")


def latest_predictions(t):
    rows = ex.newest_date(guesses(t)).select("driverid", "prob", F.format_string("%.2f%%", F.col("prob") * 100).alias("label"))
    return ex.first(rows, [F.desc("prob"), F.col("driverid")], 5)


query("q36_latest_predictions", _LATEST)(latest_predictions)
query("x24_percent_text", sql("SELECT dt_ref, driverid, printf('%.2f%%', prob * 100) AS label FROM guess", "guess"))(
    lambda t: guesses(t).select("dt_ref", "driverid", F.format_string("%.2f%%", F.col("prob") * 100).alias("label")))

# -- sorts, sets, aggregates ----------------------------------------------------
query("f1_sorted_result", sql("SELECT dt_ref, driverid, cum_points FROM driver_running", "driver_running"),
      )(lambda t: t.driver_running.select("dt_ref", "driverid", "cum_points").orderBy(F.desc("dt_ref"), "driverid"))
query("f2_order_limit", sql("""
    SELECT driverid, CAST(SUM(points) AS BIGINT) AS points FROM scored GROUP BY ALL ORDER BY points DESC, driverid LIMIT 15""", "scored"),
    )(lambda t: ex.first(scoring(t.results).groupBy("driverid").agg(F.sum("points").alias("points")),
                         [F.desc("points"), F.col("driverid")], 15))
query("f3_nlargest_nsmallest", sql("""
    SELECT 'best' AS side, driverid, p FROM (SELECT driverid, MIN(position) AS p FROM races GROUP BY ALL ORDER BY p, driverid LIMIT 3)
    UNION ALL SELECT 'worst', driverid, p FROM (SELECT driverid, MIN(position) AS p FROM races GROUP BY ALL ORDER BY p DESC, driverid LIMIT 3)""", "races"),
    )(lambda t: (lambda d: ex.first(d, [F.col("p"), F.col("driverid")], 3).withColumn("side", F.lit("best")).unionByName(
        ex.first(d, [F.desc("p"), F.col("driverid")], 3).withColumn("side", F.lit("worst"))))(
        ex.races(t.results).groupBy("driverid").agg(F.min("position").alias("p"))))
query("f7_season_list", sql("""
    SELECT DISTINCT CAST(year(dt_ref) AS INT) AS year FROM t3 UNION SELECT 2002""", "t3"),
    )(lambda t: ex.season_list(t.only("abt_champions_inseason", "dt_ref"), 2002))
query("g1_basic_aggregates", sql("""
    SELECT teamid, mode, COUNT(*) AS n, CAST(SUM(points) AS BIGINT) AS points, MIN(position) AS best, MAX(position) AS worst,
           round(AVG(grid_position) + 1e-9, 6) AS avg_grid FROM results GROUP BY ALL""", "results"),
    )(lambda t: rounded(t.results.groupBy("teamid", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"), F.min("position").alias("best"),
        F.max("position").alias("worst"), F.avg("grid_position").alias("avg_grid"))))
query("g2_conditional_count", sql(f"""
    SELECT driverid, COUNT(*) FILTER (WHERE position = 1) AS wins, COUNT(*) FILTER (WHERE position <= 3 AND mode = 'Race') AS race_podiums,
           COUNT(*) FILTER (WHERE grid_position = 1 AND position = 1) AS pole_wins FROM results GROUP BY ALL""", "results"),
    )(lambda t: t.results.groupBy("driverid").agg(
        ex.count_if(ex.won()).alias("wins"), ex.count_if((F.col("position") <= 3) & (F.col("mode") == "Race")).alias("race_podiums"),
        ex.count_if((F.col("grid_position") == 1) & ex.won()).alias("pole_wins")))
query("g3_conditional_sum_avg", sql(f"""
    SELECT driverid, CAST(COALESCE(SUM(points) FILTER (WHERE mode = 'Race'), 0) AS BIGINT) AS race_points,
           round(AVG(position) FILTER (WHERE mode = 'Sprint') + 1e-9, 6) AS sprint_position,
           round(AVG(air_temp) + 1e-9, 6) AS air_temp FROM results GROUP BY ALL""", "results"),
    )(lambda t: rounded(t.results.groupBy("driverid").agg(
        F.sum(F.when(F.col("mode") == "Race", F.col("points")).otherwise(0)).alias("race_points"),
        F.avg(F.when(F.col("mode") == "Sprint", F.col("position"))).alias("sprint_position"),
        F.avg("air_temp").alias("air_temp"))))
query("g4_distinct_count", sql("""
    SELECT teamid, COUNT(DISTINCT year) AS seasons, COUNT(DISTINCT driverid) AS drivers FROM results GROUP BY ALL""", "results"),
    )(lambda t: t.results.groupBy("teamid").agg(
        F.countDistinct("year").alias("seasons"), F.countDistinct("driverid").alias("drivers")))
query("g11_distinct_rows", sql("SELECT DISTINCT driverid, teamid, year FROM transfers", "transfers"))(
    lambda t: t.transfers.select("driverid", "teamid", "year").distinct())
query("g12_having", sql("""
    SELECT driverid, COUNT(*) AS starts FROM scored GROUP BY driverid HAVING COUNT(*) >= 100""", "scored"),
    )(lambda t: scoring(t.results).groupBy("driverid").agg(F.count(F.lit(1)).alias("starts")).where("starts >= 100"))
query("g13_group_mean", sql("""
    SELECT event_date, team_name, round(AVG(position) + 1e-9, 6) AS position, CAST(SUM(points) AS BIGINT) AS points
    FROM races GROUP BY ALL""", "races"),
    )(lambda t: rounded(ex.races(t.results).groupBy("event_date", "team_name").agg(
        F.avg("position").alias("position"), F.sum("points").alias("points"))))
query("u3_concatenate_dates", sql("""
    SELECT dt_ref, driverid, round(prob / SUM(prob) OVER (PARTITION BY dt_ref) + 1e-9, 6) AS share FROM guess""", "guess"),
    )(lambda t: rounded((lambda g: g.join(ex.small(g.groupBy("dt_ref").agg(F.sum("prob").alias("s"))), "dt_ref").select(
        "dt_ref", "driverid", (F.col("prob") / F.col("s")).alias("share")))(guesses(t))))
query("a11_run_sql", sql("""
    SELECT team_name, COUNT(*) AS n FROM results WHERE mode = 'Race' GROUP BY team_name ORDER BY n DESC, team_name LIMIT 10""", "results"),
    )(lambda t: (t.results.createOrReplaceTempView("results"), run_sql(
        t.spark, "SELECT team_name, COUNT(*) AS n FROM results WHERE mode = 'Race' GROUP BY team_name ORDER BY n DESC, team_name LIMIT 10"))[1])
query("a11_run_sql_capped", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000")(
    lambda t: (t.table("events").createOrReplaceTempView("event_rows"), run_sql(
        t.spark, "SELECT event_id, user_id /* no limit */ FROM event_rows ORDER BY event_id"))[1])
query("b13_season_filter", sql(f"SELECT dt_ref, driverid, cum_points FROM driver_running WHERE year(dt_ref) = {Y}", "driver_running"),
      )(lambda t: ex.season_of(t.driver_running, Y).select("dt_ref", "driverid", "cum_points"))
query("b15_curated_features", sql(f"SELECT dt_ref, driverid, {rr(CHAMPION_FEATURES)}, fl_champion FROM t3", "t3"),
      )(lambda t: t.only("abt_champions_inseason", "dt_ref", "driverid", *CHAMPION_FEATURES, "fl_champion").select(
          "dt_ref", "driverid", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in CHAMPION_FEATURES], "fl_champion"))
for _name, _list, _step, _key, _of in (
        ("team", TEAM_FEATURES, "t4", "teamid", "abt_teams_inseason"),
        ("team_explorer", TEAM_EXPLORER_FEATURES, "t4", "teamid", "abt_teams_inseason"),
        ("departure", DEPARTURE_FEATURES, "t6", "driverid", "abt_departures_inseason")):
    query(f"b15_curated_{_name}_features", sql(
        f"SELECT dt_ref, {_key}, {', '.join(f'round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c}' for c in _list)} FROM {_step}", _step),
          )(lambda t, names=_list, key=_key, of=_of: t.only(of, "dt_ref", key, *names).select(
              "dt_ref", key, *[F.round(F.col(c).cast("double") + 1e-9, 6).alias(c) for c in names]))
query("b17_entities_and_years", sql("""
    SELECT driverid, year, round_number, points FROM races WHERE driverid IN (1, 2, 3) AND year BETWEEN 1997 AND 1999""", "races"),
    )(lambda t: ex.races(t.results).where(F.col("driverid").isin(1, 2, 3) & F.col("year").between(1997, 1999)).select(
        "driverid", "year", "round_number", "points"))
query("b18_display_name", sql("""
    SELECT o.driverid, COALESCE(n.full_name, CAST(o.driverid AS VARCHAR)) AS full_name
    FROM (SELECT DISTINCT driverid FROM transfers) o LEFT JOIN names n USING (driverid)""", "transfers", "names"),
    )(lambda t: ex.named(t.transfers.select("driverid").distinct(), t.results).select("driverid", "full_name"))
query("j18_latest_attributes", sql("SELECT f.dt_ref, f.driverid, n.full_name, n.team_name FROM fs_all f LEFT JOIN names n USING (driverid)", "fs_all", "names"),
      )(lambda t: t.only("features", "dt_ref", "driverid").join(career.latest_names(t.results), "driverid", "left"))
