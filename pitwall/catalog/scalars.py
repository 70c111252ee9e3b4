"""Scalar functions on the event and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwall.catalog import bronze, query, rounded  # noqa: F401
from pitwall.catalog.bronze import _LAP, _RACE
from pitwall.catalog.oracle import sql, step
from pitwall.functions import scalars as fn
from pitwall.operators import evaluation as ev
from pitwall.plans import explore as ex

query("x1_year", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders")(
    lambda t: t.table("orders").select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("y")))
query("x2_to_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")(
    lambda t: t.table("events").select("event_id", F.to_date("ts").alias("day")))
query("x5_guarded_ratio", sql("""
    SELECT driverid, year, round(points / NULLIF(CAST(is_finished AS DOUBLE), 0) + 1e-9, 6) AS per_finish,
           round(CAST(overtakes AS DOUBLE) / NULLIF(overtakes, 0) + 1e-9, 6) AS one FROM results""", "results"),
    )(lambda t: rounded(t.results.select("driverid", "year", fn.ratio("points", "is_finished").alias("per_finish"),
                                         fn.ratio("overtakes", "overtakes").alias("one"))))
query("x9_team_color", sql("""
    SELECT DISTINCT TeamName, CASE WHEN TeamColor <> 'nan' THEN '#' || lower(trim(TeamColor)) ELSE '#999999' END AS color
    FROM raw""", "raw"),
    )(lambda t: t.raw.select("TeamName", fn.team_color("TeamName", "TeamColor").alias("color")).distinct())
query("x10_lap_time", f"""
    SELECT event_id, {_LAP.format('ns')} AS lap FROM (
        SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 0
                         ELSE CAST(round(value * 1e9) AS BIGINT) END AS ns FROM events)""")(
    lambda t: t.table("events").select("event_id", fn.lap_time(
        F.expr("CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 0L ELSE bigint(round(value * 1e9)) END")).alias("lap")))
query("x11_race_time", f"""
    SELECT event_id, {_RACE.format('ns', 'winner')} AS race_time FROM (
        SELECT event_id, event_id % 10 = 0 AS winner, CAST(round(value * 1e9) AS BIGINT) *
               CASE WHEN event_id % 10 = 0 THEN 100 ELSE 1 END AS ns FROM events)""")(
    lambda t: t.table("events").select("event_id", fn.race_time(
        F.expr("bigint(round(value * 1e9)) * CASE WHEN event_id % 10 = 0 THEN 100 ELSE 1 END"), F.expr("event_id % 10 = 0")).alias("race_time")))
query("x12_signed_text", sql("""
    SELECT driverid, event_date, mode, CASE WHEN overtakes > 0 THEN '+' ELSE '' END || CAST(overtakes AS VARCHAR) AS delta FROM results""", "results"),
    )(lambda t: t.results.select("driverid", "event_date", "mode", fn.signed("overtakes").alias("delta")))
P = "CAST((event_id * 7919) % 1001 AS DOUBLE) / 1000"
step("chance", f"SELECT event_id, {P} AS p FROM events")


def chance(t):
    return t.table("events").select("event_id", F.expr(P).alias("p"))


query("x14_risk_tier", sql("""
    SELECT event_id, CASE WHEN p <= 0.25 THEN 'Low' WHEN p <= 0.6 THEN 'Medium' ELSE 'High' END AS risk_tier FROM chance""", "chance"),
    )(lambda t: chance(t).select("event_id", fn.risk_tier("p").alias("risk_tier")))
query("x15_risk_label", sql("""
    SELECT event_id, CASE WHEN p <= 0.25 THEN '🟢 Low' WHEN p <= 0.6 THEN '🟡 Medium' ELSE '🔴 High' END
           || printf(' (%.1f%%)', q) AS label
    FROM (SELECT event_id, p, CAST((event_id * 7919) % 1001 AS DOUBLE) / 10 AS q FROM chance)""", "chance"),
    )(lambda t: chance(t).select("event_id", fn.risk_label(fn.risk_tier("p"), F.col("p")).alias("label")))
query("x16_threshold", sql("SELECT event_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM chance", "chance"))(
    lambda t: chance(t).select("event_id", fn.predicted("p").alias("yhat")))
query("x17_constant_imputation", sql("""
    SELECT driverid, event_date, mode, COALESCE(air_temp, -10000) AS air_temp, COALESCE(humidity, -10000) AS humidity FROM results""", "results"),
    )(lambda t: t.results.select("driverid", "event_date", "mode", "air_temp", "humidity").fillna(float(fn.FILL), ["air_temp", "humidity"]))
query("x18_standard_scaling", sql("""
    SELECT driverid, event_date, mode, round((points - m) / s + 1e-9, 6) AS points, round((position - pm) / ps + 1e-9, 6) AS position
    FROM results, (SELECT AVG(points) AS m, stddev_pop(points) AS s, AVG(position) AS pm, stddev_pop(position) AS ps FROM results)""", "results"),
    )(lambda t: rounded(ev.standardise(t.results.select("driverid", "event_date", "mode", "points", "position"), ["points", "position"])))
query("x19_event_label", sql("""
    SELECT DISTINCT printf('R%02d — %s (%s)', round_number, event_name, strftime(event_date, '%Y-%m-%d')) AS label FROM races""", "races"),
    )(lambda t: ex.races(t.results).select(fn.event_label("round_number", "event_name", "event_date").alias("label")).distinct())
query("x20_softmax", sql("""
    SELECT dt_ref, driverid, round(exp(prob * 5) / SUM(exp(prob * 5)) OVER (PARTITION BY dt_ref) + 1e-9, 6) AS p FROM guess""", "guess"),
    )(lambda t: rounded(ev.softmax(ex_guess(t).withColumn("x", F.col("prob") * 5), "dt_ref", "x", "p").select("dt_ref", "driverid", "p")))
query("x20_sigmoid", sql("SELECT event_id, round(1 / (1 + exp(-(p * 8 - 4))) + 1e-9, 6) AS s FROM chance", "chance"))(
    lambda t: rounded(chance(t).select("event_id", fn.sigmoid(F.col("p") * 8 - 4).alias("s"))))
query("x22_rounded_aggregates", sql("""
    SELECT team_name, round(AVG(position), 1) AS p1, round(AVG(overtakes), 2) AS p2, round(AVG(humidity), 1) AS h FROM results GROUP BY ALL""", "results"),
    )(lambda t: t.results.groupBy("team_name").agg(F.round(F.avg("position"), 1).alias("p1"), F.round(F.avg("overtakes"), 2).alias("p2"),
                                                   F.round(F.avg("humidity"), 1).alias("h")))
query("x23_year_list", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [CAST(year(o_orderdate) AS INT)]
           ELSE [CAST(year(o_orderdate) AS INT), CAST(year(o_orderdate) + 1 AS INT)] END AS years FROM orders""")(
    lambda t: t.table("orders").select("o_orderkey", fn.year_list(F.expr(
        "CASE WHEN o_orderkey % 2 = 0 THEN string(year(o_orderdate)) "
        "ELSE concat('[', year(o_orderdate), ', ', year(o_orderdate) + 1, ']') END")).alias("years")))


def ex_guess(t):
    from pitwall.catalog.explore import guesses
    return guesses(t)
