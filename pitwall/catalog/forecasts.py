"""Series, contexts and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwall.catalog import query, rounded, scoring  # noqa: F401
from pitwall.catalog.oracle import sql, step
from pitwall.operators import evaluation as ev, forecast as fc

Y = 1999
step("signal", f"""
SELECT f.driverid, f.dt_ref, r.full_name, r.team_name, r.team_color, CAST(COALESCE(total_points_last10, 0) AS DOUBLE) AS score
FROM fs_all f JOIN (SELECT DISTINCT driverid, event_date, full_name, team_name, team_color FROM scored) r
  ON r.driverid = f.driverid AND r.event_date = f.dt_ref""", "fs_all", "scored")
step("team_sum", f"""
SELECT r.teamid, r.team_name, r.event_date AS dt_ref, SUM(CAST(COALESCE(total_points_last10, 0) AS DOUBLE)) AS score
FROM scored r JOIN fs_all f ON f.driverid = r.driverid AND f.dt_ref = r.event_date GROUP BY ALL""", "fs_all", "scored")
query("m1_points_signal", sql(f"SELECT * FROM signal WHERE year(dt_ref) = {Y}", "signal"))(
    lambda t: fc.points_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results, Y))
query("j22_signal_roster_join", sql("SELECT driverid, dt_ref, score FROM signal", "signal"))(
    lambda t: fc.points_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results).select("driverid", "dt_ref", "score"))
query("m2_team_signal", sql(f"SELECT * FROM team_sum WHERE year(dt_ref) = {Y}", "team_sum"))(
    lambda t: fc.team_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results, Y))
query("m3_departure_signal", sql("SELECT dt_ref, driverid, round(-COALESCE(avg_position_life, 15) + 1e-9, 6) AS score FROM t6", "t6"))(
    lambda t: rounded(t.only("abt_departures_inseason", "dt_ref", "driverid", "avg_position_life").select("dt_ref", "driverid", fc.departure_signal(F.col("avg_position_life")).alias("score"))))
step("ctx", """
SELECT driverid, dt_ref, list_concat(list_transform(range(32 - len(c)), lambda i: c[1]), c) AS context
FROM (SELECT driverid, dt_ref, list(CAST(CAST(score / 1e6 AS FLOAT) AS DOUBLE)) OVER (PARTITION BY driverid ORDER BY dt_ref ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS c
      FROM signal)""", "signal")


def contexts(t):
    s = fc.points_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results).withColumn("score", F.col("score") / 1e6)
    return fc.contexts(s, "driverid", "score")


query("m4_trailing_context", sql("""
    SELECT driverid, dt_ref, len(context) AS n, round(list_sum(list_transform(context, lambda x: x)) , 1) AS total, round(context[1], 2) AS oldest,
           round(context[32], 2) AS newest FROM ctx""", "ctx"))(
    lambda t: contexts(t).select("driverid", "dt_ref", F.size("context").cast("bigint").alias("n"),
                                 F.round(fc.trailing_mean() * 32, 1).alias("total"),
                                 F.round(F.element_at("context", 1).cast("double"), 2).alias("oldest"),
                                 F.round(F.element_at("context", 32).cast("double"), 2).alias("newest")))
_W = "[" + ", ".join(repr(1 / 32 + (32 - 15.5) * (i - 15.5) / sum((j - 15.5) ** 2 for j in range(32))) for i in range(32)) + "]"
query("m6_one_step_forecast", sql(f"""
    SELECT driverid, dt_ref, round(list_avg(context), 2) AS mean_forecast,
           round(list_sum(list_transform(range(1, 33), lambda i: context[i] * ({_W})[i])), 2) AS trend_forecast FROM ctx""", "ctx"))(
    lambda t: contexts(t).select("driverid", "dt_ref", F.round(fc.trailing_mean(), 2).alias("mean_forecast"),
                                 F.round(fc.linear_trend(), 2).alias("trend_forecast")))


# The same smoothing as a recursion over the places of a context, for each of twelve pairs of rates.
query("m6_smoothed_trend", sql("""
    WITH RECURSIVE pair AS (SELECT a.i * 3 + b.i AS p, a.r AS a, b.r AS b FROM
        (VALUES (0, 0.1e0), (1, 0.3e0), (2, 0.5e0), (3, 0.8e0)) a(i, r), (VALUES (0, 0.0e0), (1, 0.1e0), (2, 0.3e0)) b(i, r)),
    fold AS (
        SELECT driverid, dt_ref, context, p, a, b, 1 AS n, context[1] AS level, 0.0e0 AS trend, 0.0e0 AS errors FROM ctx, pair
        UNION ALL
        SELECT driverid, dt_ref, context, p, a, b, n + 1, a * context[n + 1] + (1 - a) * (level + trend),
               b * ((a * context[n + 1] + (1 - a) * (level + trend)) - level) + (1 - b) * trend,
               errors + (context[n + 1] - (level + trend)) * (context[n + 1] - (level + trend))
        FROM fold WHERE n < 32)
    SELECT driverid, dt_ref, a AS level_rate, b AS trend_rate, round(level + trend, 4) AS forecast, round(errors, 3) AS errors
    FROM fold WHERE n = 32 QUALIFY row_number() OVER (PARTITION BY driverid, dt_ref ORDER BY fold.errors, p) = 1""", "ctx"))(
    lambda t: contexts(t).withColumn("s", fc.smoothed_trend()).select(
        "driverid", "dt_ref", "s.level_rate", "s.trend_rate", F.round("s.forecast", 4).alias("forecast"), F.round("s.errors", 3).alias("errors")))


query("m6_model_slot", sql("SELECT driverid, dt_ref, round(list_avg(context), 2) AS forecast FROM ctx", "ctx"))(
    lambda t: contexts(t).select("driverid", "dt_ref", F.round(fc.model_forecast(lambda block: block.astype('float64').mean(axis=1))("context"), 2).alias("forecast")))
query("m5_softmax_per_date", sql("""
    SELECT driverid, dt_ref, round(exp(m - top) / SUM(exp(m - top)) OVER (PARTITION BY dt_ref), 4) AS prob
    FROM (SELECT driverid, dt_ref, m, MAX(m) OVER (PARTITION BY dt_ref) AS top FROM (
          SELECT driverid, dt_ref, list_avg(context) / 10 AS m FROM ctx))""", "ctx"))(
    lambda t: fc.probabilities(fc.points_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results).withColumn("score", F.col("score") / 1e7), "driverid", "score")
    .select("driverid", "dt_ref", F.round("prob", 4).alias("prob")))
query("m5_sigmoid_per_row", sql("""
    SELECT driverid, dt_ref, round(1 / (1 + exp(-(list_avg(context) / 10 - 1))), 4) AS prob FROM ctx""", "ctx"))(
    lambda t: fc.probabilities(fc.points_signal(t.only("features", "dt_ref", "driverid", "total_points_last10"), t.results).withColumn("score", F.col("score") / 1e7 - 1), "driverid", "score", "sigmoid")
    .select("driverid", "dt_ref", F.round("prob", 4).alias("prob")))
query("j20_predictions_to_labels", sql("""
    SELECT split, COUNT(*) AS n, CAST(SUM(fl_champion) AS BIGINT) AS positives FROM (
        SELECT DISTINCT dt_ref, driverid, fl_champion, CASE WHEN year(dt_ref) < 2000 THEN 'before' ELSE 'after' END AS split FROM t3)
    GROUP BY split""", "t3"))(
    lambda t: (lambda a: fc.probabilities(a.select("driverid", "dt_ref", "total_points_last10"), "driverid", "total_points_last10").join(
        a.select("driverid", "dt_ref", "fl_champion").distinct(), ["driverid", "dt_ref"]).groupBy(
        F.when(F.year("dt_ref") < 2000, "before").otherwise("after").alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fl_champion").alias("positives")))(
        t.only("abt_champions_inseason", "driverid", "dt_ref", "fl_champion", "total_points_last10")))
for _name, _abt, _cols in (("champion", "abt_champions_inseason", ("driverid", "dt_ref", "fl_champion", "total_points_last10")),
                           ("constructor", "abt_teams_inseason", ("teamid", "dt_ref", "fl_constructor_champion", "sum_points_last10")),
                           ("departure", "abt_departures_inseason", ("driverid", "dt_ref", "fl_departed", "avg_position_life"))):
    # Raw points would saturate the exponential, so they are scaled to a season's size.
    query(f"m8_evaluate_{_name}")(lambda t, n=_name, a=_abt, c=_cols: rounded(
        fc.evaluate_forecast(t.only(a, *c), n, 1.0 if n == "departure" else 1e-7)))
step("ctx3", """
SELECT driverid, dt_ref, list_avg(list_concat(list_transform(range(32 - len(c)), lambda i: c[1]), c)) AS m
FROM (SELECT driverid, dt_ref, list(total_points_last10 / 1e7) OVER (PARTITION BY driverid ORDER BY dt_ref
             ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS c FROM t3)""", "t3")
query("m7_evaluate_forecast", sql("""
    WITH p AS (SELECT fl_champion AS y, CASE WHEN year(dt_ref) < 2000 THEN 'train' ELSE 'oot' END AS split,
                      exp(m) / SUM(exp(m)) OVER (PARTITION BY dt_ref) AS p
               FROM t3 JOIN ctx3 USING (driverid, dt_ref) WHERE year(dt_ref) <= 2000)
    SELECT q.split, round(AVG(CASE WHEN q.p > n.p THEN 1.0 WHEN q.p = n.p THEN 0.5 ELSE 0.0 END), 3) AS roc_auc
    FROM p q JOIN p n ON n.split = q.split AND q.y = 1 AND n.y = 0 GROUP BY q.split""", "t3", "ctx3"))(
    lambda t: fc.evaluate_forecast(t.only("abt_champions_inseason", "driverid", "dt_ref", "fl_champion", "total_points_last10"), "champion", 1e-7).select("split", F.round("roc_auc", 3).alias("roc_auc")))
