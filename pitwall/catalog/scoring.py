"""Splits, folds, weights, metrics and model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwall.catalog import query, rounded, scalars  # noqa: F401
from pitwall.catalog.explore import guesses
from pitwall.catalog.oracle import sql, step
from pitwall.functions.scalars import risk_tier
from pitwall.operators import evaluation as ev
from pitwall.operators.features import FEATURE_COLUMNS
from pitwall.plans import explore as ex, training

LABEL = "fl_champion"

# -- splits ---------------------------------------------------------------
step("class_years", """
SELECT year(dt_ref) AS y, COUNT(DISTINCT fl_champion) AS k FROM t3 GROUP BY 1""", "t3")
_OOT = "(SELECT COALESCE(MAX(y) FILTER (WHERE k = 2), MAX(y)) FROM class_years)"
_TEST = f"(SELECT MAX(y) FROM class_years WHERE k = 2 AND y < {_OOT})"
query("l1_two_class_year", sql(f"SELECT {_OOT} AS oot_year, {_TEST} AS test_year", "class_years"))(
    lambda t: (lambda a: a.agg(F.lit(ev.two_class_year(a, LABEL)).cast("bigint").alias("oot_year"), F.lit(
        ev.two_class_year(a.where(F.year("dt_ref") < ev.two_class_year(a, LABEL)), LABEL)).cast("bigint").alias("test_year")).limit(1))(
        t.only("abt_champions_inseason", "dt_ref", LABEL)))
query("g17_two_classes_by_year", sql("SELECT y AS year, k AS classes FROM class_years", "class_years"))(
    lambda t: t.only("abt_champions_inseason", "dt_ref", LABEL).groupBy(F.year("dt_ref").cast("bigint").alias("year")).agg(F.countDistinct(LABEL).alias("classes")))
step("dates_back", """
SELECT dt_ref, year(dt_ref) AS y, row_number() OVER (PARTITION BY year(dt_ref) ORDER BY dt_ref DESC) - 1 AS recency
FROM (SELECT DISTINCT dt_ref FROM t3)""", "t3")
_SPLIT = f"""
    SELECT t3.dt_ref, driverid, CASE WHEN y = {_OOT} THEN 'oot' WHEN y = {_TEST} THEN 'test' ELSE 'train' END AS split
    FROM t3 JOIN dates_back USING (dt_ref) WHERE y <= {_OOT}"""
query("l2_split_late_removed", sql(_SPLIT + f" AND (y >= {_TEST} OR recency > 4)", "t3", "dates_back", "class_years"))(
    lambda t: ev.split(t.only("abt_champions_inseason", "dt_ref", "driverid", LABEL), LABEL).select("dt_ref", "driverid", "split"))
query("l2_split_all_rounds", sql(_SPLIT, "t3", "dates_back", "class_years"))(
    lambda t: ev.split(t.only("abt_champions_inseason", "dt_ref", "driverid", LABEL), LABEL, drop_last=0).select("dt_ref", "driverid", "split"))
query("l2_split_given_years", sql(f"""
    SELECT dt_ref, driverid, CASE WHEN year(dt_ref) IN (1999, 2001) THEN 'oot' WHEN year(dt_ref) = 1998 THEN 'test' ELSE 'train' END AS split
    FROM t3 WHERE year(dt_ref) <> 2000""", "t3"))(
    lambda t: ev.split(t.only("abt_champions_inseason", "dt_ref", "driverid", LABEL), LABEL, [1999, 2001], 0).select("dt_ref", "driverid", "split"))
query("w15_date_recency", sql("SELECT y AS year, dt_ref, recency FROM dates_back", "dates_back"))(
    lambda t: ev.recency(t.only("abt_champions_inseason", "dt_ref")).select(F.col("year").cast("bigint").alias("year"), "dt_ref", F.col("recency").cast("bigint").alias("recency")))
query("j21_kept_rounds", sql("SELECT t3.dt_ref, driverid FROM t3 JOIN dates_back USING (dt_ref) WHERE recency > 4", "t3", "dates_back"))(
    lambda t: t.only("abt_champions_inseason", "dt_ref", "driverid").join(
        ex.small(ev.recency(t.only("abt_champions_inseason", "dt_ref", "driverid")).where("recency > 4").select("dt_ref")), "dt_ref", "left_semi"))
query("l3_expanding_folds", sql("""
    WITH ys AS (SELECT DISTINCT year(dt_ref) AS y FROM t3),
         f AS (SELECT y AS val_year, row_number() OVER (ORDER BY y) - 1 AS fold FROM (SELECT y FROM ys ORDER BY y DESC LIMIT 4))
    SELECT CAST(fold AS INT) AS fold, CASE WHEN year(dt_ref) = val_year THEN 'validation' ELSE 'train' END AS role, COUNT(*) AS n
    FROM t3 JOIN f ON year(dt_ref) <= val_year GROUP BY ALL""", "t3"))(
    lambda t: ev.folds(t.only("abt_champions_inseason", "dt_ref"), 4).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n")))
query("l9_class_weights", sql("""
    SELECT dt_ref, driverid, round(COUNT(*) OVER () / (2.0 * COUNT(*) OVER (PARTITION BY fl_champion)) + 1e-9, 6) AS weight FROM t3""", "t3"))(
    lambda t: rounded(ev.with_class_weight(t.only("abt_champions_inseason", "dt_ref", "driverid", LABEL), LABEL).select("dt_ref", "driverid", "weight")))
query("g16_class_balance", sql("""
    SELECT CAST(SUM(fl_champion) AS BIGINT) AS n_pos, CAST(SUM(1 - fl_champion) AS BIGINT) AS n_neg,
           round(SUM(1 - fl_champion) / CAST(SUM(fl_champion) AS DOUBLE) + 1e-9, 6) AS ratio, round(AVG(fl_champion) + 1e-9, 6) AS rate FROM t3""", "t3"))(
    lambda t: rounded(ev.class_balance(t.only("abt_champions_inseason", "dt_ref", LABEL), LABEL)))
query("l24_grouped_holdout", sql("""
    WITH g AS (SELECT driverid, year(dt_ref) AS season, MAX(fl_champion) AS c FROM t3 GROUP BY ALL)
    SELECT dt_ref, t3.driverid, CASE WHEN CAST('0x' || substr(md5(t3.driverid || '|' || season || '|' || c), 1, 8) AS BIGINT) % 1000 < 200
           THEN 'test' ELSE 'train' END AS split
    FROM t3 JOIN g ON g.driverid = t3.driverid AND g.season = year(dt_ref)""", "t3"))(
    lambda t: ev.grouped_holdout(t.only("abt_champions_inseason", "dt_ref", "driverid", LABEL).withColumn("season", F.year("dt_ref")),
                                 LABEL, ["driverid", "season"]).select("dt_ref", "driverid", "split"))
# Metrics by name, as the selector must leave them: no sprint metric but four, two windows.
_SCOPED = "wins podiums top5 grid_top5 poles pole_win sessions_with_points sessions_with_overtake".split()
_INPUTS = [
    "qtd_seasons", "qtd_sessions", "qtd_finished", "qtd_race", "qtd_finished_race", "qtd_sprint",
    *[f"qtd_{n}{s}" for n in _SCOPED for s in ("", "_race")], "qtd_wins_sprint", "qtd_podiums_sprint",
    "total_points", "total_points_race", "total_points_sprint",
    *[f"avg_{n}{s}" for n in ("grid", "position", "overtakes") for s in ("", "_race")],
    "qtd_quali", "avg_quali_position", "qtd_quali_pole", "qtd_quali_top3", "qtd_quali_top10",
    "avg_air_temp", "avg_track_temp", "avg_humidity", "avg_pressure", "avg_wind_speed", "qtd_sessions_rain", "pct_sessions_rain"]
_CHOSEN = [f"{n}_{w}" for w in ("life", "last10") for n in _INPUTS]
query("b14_feature_selector", sql(f"""
    SELECT dt_ref, driverid, {", ".join(f"round(CAST({c} AS DOUBLE) + 1e-9, 6) AS {c}" for c in _CHOSEN)} FROM t1""", "t1"))(
    lambda t: (lambda chosen: rounded(t.only("abt_champions", "dt_ref", "driverid", *chosen).select("dt_ref", "driverid", *[
        F.col(c).cast("double").alias(c) for c in chosen])))(training.feature_columns(["dt_ref", "driverid", *FEATURE_COLUMNS, LABEL])))


# -- metrics on labelled documents ----------------------------------------------
step("judged", "SELECT doc_id, quality AS y, CAST((doc_id * 7919) % 100 AS DOUBLE) / 100 AS p FROM labels")


def judged(t):
    return t.table("labels").select("doc_id", F.col("quality").alias("y"), F.expr("CAST((doc_id * 7919) % 100 AS DOUBLE) / 100").alias("p"))


_AUC = """(SELECT AVG(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)
           FROM judged a JOIN judged b ON a.y = 1 AND b.y = 0)"""
step("cuts", """
SELECT c.p, COUNT(*) FILTER (WHERE j.y = 1) AS tp, COUNT(*) FILTER (WHERE j.y = 0) AS fp,
       COUNT(*) FILTER (WHERE j.y = 1 AND j.p = c.p) AS here,
       (SELECT COUNT(*) FROM judged WHERE y = 1) AS n_pos, (SELECT COUNT(*) FROM judged WHERE y = 0) AS n_neg
FROM (SELECT DISTINCT p FROM judged) c JOIN judged j ON j.p >= c.p GROUP BY c.p""", "judged")
query("l10_roc_auc", sql(f"SELECT round({_AUC} + 1e-9, 6) AS roc_auc", "judged"))(
    lambda t: rounded(ev.ranking_metrics(judged(t), "y", "p").select("roc_auc")))
query("l11_pr_auc", sql("SELECT round(SUM(here / CAST(n_pos AS DOUBLE) * tp / (tp + fp)) + 1e-9, 6) AS pr_auc FROM cuts", "cuts"))(
    lambda t: rounded(ev.ranking_metrics(judged(t), "y", "p").select("pr_auc")))
query("l12_curve_points", sql("""
    SELECT p, tp, fp, round(fp / CAST(n_neg AS DOUBLE) + 1e-9, 6) AS fpr, round(tp / CAST(n_pos AS DOUBLE) + 1e-9, 6) AS tpr,
           round(tp / CAST(tp + fp AS DOUBLE) + 1e-9, 6) AS precision FROM cuts""", "cuts"))(
    lambda t: ev.curve_points(judged(t), "y", "p").select(
        "p", "tp", "fp", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("fpr", "tpr", "precision")]))
_TM = """round(2.0 * COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) /
           NULLIF(COUNT(*) FILTER (WHERE p >= 0.5) + COUNT(*) FILTER (WHERE y = 1), 0) + 1e-9, 6) AS f1,
           round(-AVG(CASE WHEN y = 1 THEN ln(greatest(p, 2.220446049250313e-16)) ELSE ln(1 - least(p, 1 - 2.220446049250313e-16)) END) + 1e-9, 6) AS log_loss,
           round(AVG((p - y) * (p - y)) + 1e-9, 6) AS brier, COUNT(*) AS n_samples"""
query("l13_threshold_metrics", sql(f"SELECT {_TM} FROM judged", "judged"))(
    lambda t: rounded(ev.threshold_metrics(judged(t), "y", "p")))
query("l14_confusion_matrix", sql("""
    SELECT a AS actual, b AS predicted, COUNT(j.doc_id) AS n FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) z(b)
    LEFT JOIN judged j ON j.y = a AND CAST(j.p >= 0.5 AS INT) = b GROUP BY a, b""", "judged"))(
    lambda t: ev.confusion(judged(t), "y", "p"))
query("l15_top1_accuracy", sql("""
    SELECT round(AVG(CAST(g.driverid = c.driverid AS INT)) + 1e-9, 6) AS top1_acc, COUNT(*) AS n_events
    FROM (SELECT * FROM guess QUALIFY row_number() OVER (PARTITION BY dt_ref ORDER BY prob DESC, driverid) = 1) g
    JOIN champions c ON c.year = year(g.dt_ref)""", "guess", "champions"))(
    lambda t: rounded(ev.top1_accuracy(guesses(t), t.champions, "driverid", "prob")))

# -- model tables: four fixed scorings of the same base table --------------------
MODELS = {"alpha": 7919, "beta": 104729, "gamma": 1299709, "delta": 15485863}
_P = "CAST((driverid * {k} + dayofyear(dt_ref) * 31 + standing_position * 17) % 1000 AS DOUBLE) / 1000"
step("models", " UNION ALL ".join(f"""
SELECT '{m}' AS model, CASE year(dt_ref) WHEN 2000 THEN 'oot' WHEN 1999 THEN 'test' ELSE 'train' END AS split,
       dt_ref, driverid, fl_champion AS y, {_P.format(k=k)} AS p FROM t3 WHERE year(dt_ref) <= 2000""" for m, k in MODELS.items()), "t3")


def models(t):
    def build():
        base = t.only("abt_champions_inseason", "dt_ref", "driverid", "standing_position", LABEL).where(F.year("dt_ref") <= 2000)
        kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.expr(_P.format(k=k)).alias("p")) for m, k in MODELS.items()]))
        return base.withColumn("x", kinds).select(
            F.col("x.m").alias("model"), F.expr("CASE year(dt_ref) WHEN 2000 THEN 'oot' WHEN 1999 THEN 'test' ELSE 'train' END").alias("split"),
            "dt_ref", "driverid", F.col(LABEL).alias("y"), F.col("x.p").alias("p"))
    return t.lake.layer("models", build)


def model_metrics(t):
    return t.lake.layer("model_metrics", lambda: ev.evaluate(models(t), "y", "p", ["model", "split"], t.champions, "driverid"))


step("model_metrics", f"""
SELECT a.model, a.split, roc_auc, pr_auc, f1, log_loss, brier, n_samples, top1_acc FROM (
    SELECT model, split, {_TM} FROM models GROUP BY ALL) a
JOIN (SELECT q.model, q.split, round(AVG(CASE WHEN q.p > n.p THEN 1.0 WHEN q.p = n.p THEN 0.5 ELSE 0.0 END) + 1e-9, 6) AS roc_auc
      FROM models q JOIN models n ON n.model = q.model AND n.split = q.split AND q.y = 1 AND n.y = 0 GROUP BY ALL) b USING (model, split)
JOIN (SELECT model, split, round(AVG(tp / CAST(tp + fp AS DOUBLE)) + 1e-9, 6) AS pr_auc FROM (
        SELECT q.model, q.split, q.dt_ref, q.driverid, COUNT(*) FILTER (WHERE n.y = 1) AS tp, COUNT(*) FILTER (WHERE n.y = 0) AS fp
        FROM models q JOIN models n ON n.model = q.model AND n.split = q.split AND n.p >= q.p WHERE q.y = 1 GROUP BY ALL) GROUP BY ALL) c USING (model, split)
JOIN (SELECT model, split, round(AVG(CAST(g.driverid = w.driverid AS INT)) + 1e-9, 6) AS top1_acc FROM (
        SELECT * FROM models QUALIFY row_number() OVER (PARTITION BY model, dt_ref ORDER BY p DESC, driverid) = 1) g
      JOIN champions w ON w.year = year(g.dt_ref) GROUP BY ALL) d USING (model, split)""", "models", "champions")
query("l16_model_metrics", sql("SELECT * FROM model_metrics", "model_metrics"))(lambda t: rounded(model_metrics(t)))
_WIDE = ", ".join(f"MAX({c}) FILTER (WHERE split = '{s}') AS {c}_{s}" for s in ("train", "test", "oot")
                  for c in ("roc_auc", "pr_auc", "f1", "top1_acc", "log_loss", "brier"))
step("compared", f"SELECT model, {_WIDE} FROM model_metrics GROUP BY model", "model_metrics")
query("l16_comparison_table", sql("SELECT * FROM compared", "compared"))(lambda t: rounded(ev.comparison(model_metrics(t))))
query("l17_best_by_score", sql("SELECT model, pr_auc_oot AS score FROM compared ORDER BY pr_auc_oot DESC, model LIMIT 1", "compared"))(
    lambda t: rounded(ev.best_model(ev.comparison(model_metrics(t))).select("model", "score")))
step("ranks", """
SELECT model, (SELECT COUNT(*) + 1 FROM compared o WHERE o.pr_auc_oot > c.pr_auc_oot) +
    (SELECT COUNT(*) - 1 FROM compared o WHERE o.pr_auc_oot = c.pr_auc_oot) / 2.0 AS a,
    (SELECT COUNT(*) + 1 FROM compared o WHERE o.top1_acc_test > c.top1_acc_test) +
    (SELECT COUNT(*) - 1 FROM compared o WHERE o.top1_acc_test = c.top1_acc_test) / 2.0 AS b FROM compared c""", "compared")
query("l17_best_combined", sql("SELECT model, CAST((a + b) / 2 AS DOUBLE) AS score FROM ranks ORDER BY 2, 1 LIMIT 1", "ranks"))(
    lambda t: ev.best_model(rounded(ev.comparison(model_metrics(t))), "combined").select("model", "score"))
query("w18_average_rank", sql("SELECT model, CAST(b AS DOUBLE) AS mean_rank FROM ranks", "ranks"))(
    lambda t: ev.average_rank(rounded(ev.comparison(model_metrics(t))).select("model", "top1_acc_test"), "top1_acc_test", "mean_rank").select("model", "mean_rank"))
query("x21_metric_shading", sql("""
    SELECT model, split, round(CASE WHEN h = l THEN 0.25 ELSE 0.1 + 0.4 * (roc_auc - l) / (h - l) END + 1e-9, 5) AS roc_auc_shade,
           CAST(roc_auc = h AS INT) AS roc_auc_best,
           round(CASE WHEN bh = bl THEN 0.25 ELSE 0.1 + 0.4 * (1 - (brier - bl) / (bh - bl)) END + 1e-9, 5) AS brier_shade,
           CAST(brier = bl AS INT) AS brier_best
    FROM model_metrics, (SELECT MIN(roc_auc) AS l, MAX(roc_auc) AS h, MIN(brier) AS bl, MAX(brier) AS bh FROM model_metrics)""", "model_metrics"))(
    lambda t: ev.shading(rounded(model_metrics(t)).select("model", "split", "roc_auc", "brier"), {"roc_auc": True, "brier": False}).select(
        "model", "split", "roc_auc_best", "brier_best", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("roc_auc_shade", "brier_shade")]))
step("runs", """
SELECT event_id AS run_id, event_type AS model_type, CASE WHEN event_id % 7 = 0 THEN 'zero_shot' ELSE 'batch' END AS learning_mode,
       CAST(event_id % 50 = 0 AS INT) AS is_final, ts AS started FROM events""")


def runs(t):
    return t.table("events").selectExpr(
        "event_id AS run_id", "event_type AS model_type", "CASE WHEN event_id % 7 = 0 THEN 'zero_shot' ELSE 'batch' END AS learning_mode",
        "int(event_id % 50 = 0) AS is_final", "ts AS started")


query("l21_latest_runs", sql("""
    SELECT model_type, run_id FROM runs WHERE learning_mode <> 'zero_shot' AND is_final = 0
    QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY started DESC, run_id) = 1""", "runs"))(
    lambda t: ev.latest_runs(runs(t)).select("model_type", "run_id"))
query("l21_default_run", sql("SELECT run_id, model_type FROM runs ORDER BY is_final DESC, started DESC, run_id LIMIT 1", "runs"))(
    lambda t: ev.default_run(runs(t)).select("run_id", "model_type"))
query("f4_risk_selection", sql("""
    SELECT driverid, risk_tier, CAST(tier_place AS INT) AS tier_place, prob FROM (
        SELECT *, row_number() OVER (PARTITION BY risk_tier ORDER BY prob DESC, driverid) AS tier_place FROM (
            SELECT driverid, prob, CASE WHEN prob <= 0.25 THEN 'Low' WHEN prob <= 0.6 THEN 'Medium' ELSE 'High' END AS risk_tier
            FROM guess WHERE dt_ref = (SELECT MAX(dt_ref) FROM guess)))
    WHERE tier_place <= CASE risk_tier WHEN 'High' THEN 6 WHEN 'Medium' THEN 4 ELSE 2 END""", "guess"))(
    lambda t: ex.risk_selection(ex.newest_date(guesses(t)).withColumn("risk_tier", risk_tier("prob"))).select(
        "driverid", "risk_tier", "tier_place", "prob"))
