"""The search over settings, balanced forests and folds."""

import datetime as dt
import math
import random
import threading
import time
from statistics import mean

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from pitwall.operators import evaluation as ev
from pitwall.plans import training as tr
from pitwall.plans.search import Parzen, Study, Trial, run_folds, search

SPACE = {"x": ("float", 0.0, 10.0), "r": ("log", 1e-4, 10.0), "k": ("int", 2, 40, 2), "c": ("pick", ["a", "b", "c", "d"])}


def quality(p):
    """Best at x = 7.3, r = 0.02, k = 12, c = b."""
    return (1 - ((p["x"] - 7.3) / 10) ** 2 - (math.log10(p["r"] / 0.02) / 5) ** 2 - ((p["k"] - 12) / 38) ** 2
            - 0.2 * (p["c"] != "b"))


def run_without_spark(sampler, seed, n=40):
    study = Study(SPACE, seed, sampler)
    for _ in range(n):
        t = study.propose()
        t.scores, t.state = [quality(t.params)], "finished"
    return study


def test_parzen_draws_beat_uniform_ones():
    model, uniform = ([run_without_spark(s, seed).best().score for seed in range(20)] for s in ("parzen", "uniform"))
    assert mean(model) > mean(uniform) + 0.01
    assert sum(a > b for a, b in zip(model, uniform)) >= 15


def test_draws_stay_in_their_ranges_and_repeat():
    one, two = run_without_spark("parzen", 5), run_without_spark("parzen", 5)
    assert [t.params for t in one.trials] == [t.params for t in two.trials]
    for t in one.trials:
        p = t.params
        assert 0 <= p["x"] <= 10 and 1e-4 <= p["r"] <= 10 and p["k"] in range(2, 41, 2) and p["c"] in "abcd"


@pytest.mark.parametrize("kind,values", [(("float", 0.0, 2.0), [0.3, 0.31, 1.9]), (("log", 1e-3, 10.0), [0.01, 5.0]), (("float", 0.0, 1.0), [])])
def test_densities_add_up_to_one(kind, values):
    d = Parzen(kind, values)
    low, high = (math.log(kind[1]), math.log(kind[2])) if kind[0] == "log" else kind[1:]
    n = 4000
    xs = [low + (high - low) * (i + 0.5) / n for i in range(n)]
    total = sum(math.exp(d.log_density(math.exp(x) if kind[0] == "log" else x)) for x in xs) * (high - low) / n
    assert abs(total - 1) < 1e-3


def test_median_rule():
    study = Study({}, startup=3, warmup=2)
    done = [Trial(i, {}, s, "finished") for i, s in enumerate(([0.2, 0.4, 0.9], [0.4, 0.6, 0.1], [0.8, 0.8, 0.8]))]
    assert not study.hopeless([0.0], done)                 # too few folds
    assert not study.hopeless([0.0, 0.0], done[:2])        # too few finished trials
    assert study.hopeless([0.4, 0.5], done)                # mean 0.45 below the median 0.5 of the first two folds
    assert not study.hopeless([0.5, 0.5], done)
    assert study.hopeless([0.5, 0.5, 0.4], done)           # median of three folds is 0.5


def test_a_planted_bad_setting_is_cancelled_while_it_runs(spark):
    """Of 30 trials in five folds one is bad from the start; its last folds would take minutes."""
    started, ended = [], []

    def slow(batches):
        time.sleep(300)
        yield from batches

    def score(params, fold):
        bad = params["x"] < 2
        if bad and fold >= 2:
            started.append(fold)
            spark.range(4).repartition(4).mapInPandas(slow, "id long").count()
            ended.append(fold)
        n = spark.range(50).where(F.col("id") % 5 == fold).count()
        return 0.0 if bad else n / 10 - 0.001 * abs(params["x"] - 6)

    study = Study({"x": ("float", 0.0, 10.0)}, seed=3, sampler="uniform", startup=4)
    planned = [4.0, 5.0, 6.0, 7.0, 8.0, 1.0] + [3.0 + i / 10 for i in range(24)]
    propose = study.propose

    def planted():
        trial = propose()
        trial.params["x"] = planned[trial.number]
        return trial

    study.propose = planted
    at = time.time()
    search(spark, study, 30, 5, score, at_once=4, name="planted")
    assert time.time() - at < 200
    assert [t.number for t in study.trials if t.state == "stopped" and t.scores == [0.0, 0.0]] == [5]
    assert started and not ended
    assert study.best().params["x"] == 6.0
    table = {r["trial"]: r for r in study.table(spark).collect()}
    assert len(table) == 30 and table[5]["folds"] == 2 and table[5]["state"] == "stopped"
    assert spark.range(3).count() == 3  # nothing else is cancelled


def test_folds_come_back_in_order_and_errors_rise(spark):
    gate = threading.Event()

    def score(fold):
        if fold == 0:
            gate.wait(5)
        gate.set()
        return float(fold)

    assert run_folds(spark, "order", 3, score) == ([0.0, 1.0, 2.0], False)

    def fails(fold):
        if fold == 1:
            raise KeyError("fold")
        return 0.0

    with pytest.raises(KeyError):
        run_folds(spark, "fails", 3, fails)
    study = search(spark, Study({"x": ("float", 0.0, 1.0)}), 3, 2, lambda p, f: fails(f), (KeyError,))
    assert [t.state for t in study.trials] == ["refused"] * 3 and study.best() is None


# -- balanced forests ---------------------------------------------------------------
def rows(spark, n=6000, share=0.04, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < share)
        out.append((f"{1990 + i % 8}-05-01", *[rng.gauss(0.9 * y * (j < 2), 1) for j in range(4)], y))
    return spark.createDataFrame(out, "dt_ref string, a double, b double, c double, d double, y int").withColumn(
        "dt_ref", F.to_date("dt_ref")).repartition(4)


def tree_counts(model):
    """Weighted rows of either class at the root of every tree."""
    return [list(t._java_obj.rootNode().impurityStats().stats()) for t in model.stages[-1].trees]


@pytest.mark.parametrize("share", [0.04, 0.3, 0.93])
def test_every_tree_draws_both_classes_alike(spark, share):
    df = rows(spark, 4000, share)
    c = tr.candidates(BalancedRandomForest={"numTrees": 12, "maxDepth": 4})["BalancedRandomForest"]
    model = tr.fit(c, df, ["a", "b", "c", "d"], "y")
    n = min(df.where("y = 1").count(), df.where("y = 0").count())
    counts = tree_counts(model)
    assert len(counts) == 12 and len({tuple(c) for c in counts}) > 6  # a draw of its own for every tree
    for no, yes in counts:
        expected = 0.8 * n
        assert abs(no - expected) < 5 * math.sqrt(expected) + 1 and abs(yes - expected) < 5 * math.sqrt(expected) + 1
    assert abs(mean(c[0] for c in counts) / mean(c[1] for c in counts) - 1) < 0.1


def test_copies_are_as_many_as_the_commoner_class(spark):
    df = rows(spark, 3000, 0.11)
    counts = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    out, draw = ev.balanced_copies(df, "y", counts)
    got = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert got[0] == counts[0] and abs(got[1] / counts[0] - 1) < 0.05 and math.isclose(draw, counts[1] / counts[0])
    assert out.columns == df.columns
    one = df.where("y = 0")
    assert ev.balanced_copies(one, "y", {0: one.count()})[1] == 1.0


def test_balanced_forest_ranks_like_the_weighted_one(spark):
    train, test = rows(spark, 6000, 0.04, 1), rows(spark, 3000, 0.04, 2)
    features, auc = ["a", "b", "c", "d"], {}
    drawn = tr.candidates(BalancedRandomForest={"numTrees": 40, "maxDepth": 5})["BalancedRandomForest"]
    weighted = tr.Candidate("weighted", RandomForestClassifier, drawn.params)
    for c in (drawn, weighted):
        scored = tr.score(tr.fit(c, train, features, "y"), test, features)
        auc[c.name] = ev.ranking_metrics(scored, "y", "prob").first()["roc_auc"]
    assert min(auc.values()) > 0.75 and abs(auc["BalancedRandomForest"] - auc["weighted"]) < 0.03


def test_folds_score_what_a_fit_of_their_rows_scores(spark):
    df, features = rows(spark, 3000, 0.2), ["a", "b", "c", "d"]
    c = tr.CANDIDATES["LogisticRegression"]
    got = tr.cross_validate(c, df, features, "y", {"regParam": 0.01}, n_folds=3)
    want = []
    for year in (1995, 1996, 1997):
        model = tr.fit(c, df.where(F.year("dt_ref") < year), features, "y", {"regParam": 0.01})
        scored = tr.score(model, df.where(F.year("dt_ref") == year), features)
        want.append(ev.ranking_metrics(scored, "y", "prob").first()["pr_auc"])
    assert got == pytest.approx(want, abs=1e-9)


def test_tune_finds_the_better_setting(spark):
    df, features = rows(spark, 2000, 0.2), ["a", "b", "c", "d"]
    c = tr.Candidate("LogisticRegression", tr.LogisticRegression, {"regParam": 50.0, "elasticNetParam": 1.0}, {
        "regParam": ("pick", [50.0, 0.001])}, scaled=True)
    r = tr.tune(c, df, features, "y", n_trials=8, n_folds=3)
    assert r["params"] == {"regParam": 0.001} and r["tuned_cv_score"] > r["cv_score"]
    assert len(r["study"].trials) == 8
    assert tr.tune(c, df, features, "y", n_trials=0, n_folds=2)["params"] == {}


def test_folds_have_the_parts_their_rows_ask_for(spark, monkeypatch):
    """Small folds of a table in many parts are few parts, large ones keep them; no row is lost."""
    df, features = rows(spark, 3000, 0.2).repartition(12), ["a", "b", "c", "d"]
    per = {r[0]: r[1] for r in df.groupBy(F.year("dt_ref")).count().collect()}
    for values, check in ((4 * 3000, lambda n: n == 1), (4 * 500, lambda n: 1 < n < 12), (4 * 10, lambda n: n == 12)):
        monkeypatch.setattr(tr, "PART_VALUES", values, raising=False)
        for name in ("LogisticRegression", "BalancedRandomForest"):
            with tr.Folds(tr.CANDIDATES[name], df, features, "y", 3) as folds:
                for year, f in zip((1995, 1996, 1997), folds.folds):
                    assert check(f.train.rdd.getNumPartitions()) and f.validation.rdd.getNumPartitions() <= f.train.rdd.getNumPartitions()
                    assert f.validation.count() == per[year]
                    if name == "LogisticRegression":
                        assert f.train.count() == sum(n for y, n in per.items() if y < year)


# -- training as a whole -----------------------------------------------------------------
SMALL = dict(LogisticRegression={"maxIter": 20}, GradientBoosting={"maxIter": 12, "minInstancesPerNode": 5, "stepSize": 0.3},
             BalancedRandomForest={"numTrees": 8, "maxDepth": 4})


def auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    pos = [p for y, p in pairs if y]
    return mean(sum(y for y, q in pairs if q >= p) / sum(q >= p for _, q in pairs) for p in pos)


@pytest.mark.parametrize("name", ["constructor", "departure"])
def test_training_of_the_other_targets(spark, monkeypatch, name):
    """All three candidates, the early stop of boosting, a search each, and every score computed again."""
    task = tr.TASKS[name]
    df = rows(spark, 2400, 0.2, 7).withColumns({task.key: F.pmod(F.xxhash64("a"), F.lit(40)).cast("long"), task.target: F.col("y")})
    features = ["a", "b", "c", "d"]
    small = tr.Task(task.target, task.key, features, "roc_auc", task.drop_last, [1997], task.early_stop, task.overrides)
    stops, fitted = [], tr.fit

    def seen(c, df, features, target, params=None, stop_on=None):
        stops.append((c.name, stop_on))
        return fitted(c, df, features, target, {**(params or {}), **SMALL.get(c.name, {})}, stop_on)

    monkeypatch.setattr(tr, "fit", seen)
    monkeypatch.setattr(tr, "tune", lambda c, *a, **k: {"cv_score": 0.5, "cv_std": 0.0, "params": {}, "tuned_cv_score": 0.5})
    out = tr.train(df, small, tr.candidates(**SMALL))
    assert not out.skipped and set(out.models) == set(SMALL)
    assert ("GradientBoosting", "is_val" if task.early_stop else None) in stops
    if task.early_stop:
        trees = out.models["GradientBoosting"].stages[-1].getNumTrees
        assert 1 <= trees <= 12
    got = {(r["model"], r["split"]): r for r in out.metrics.collect()}
    parts = ev.split(df.select("dt_ref", task.key, task.target, *features), task.target, [1997], task.drop_last).cache()
    for model, fit in out.models.items():
        scored = tr.score(fit, parts, features).select("split", task.target, "prob").collect()
        for split in ("train", "test", "oot"):
            pairs = [(r[1], r["prob"]) for r in scored if r["split"] == split]
            row = got[model, split]
            assert row["n_samples"] == len(pairs) and math.isclose(row["roc_auc"], auc(pairs), abs_tol=1e-9)
            assert math.isclose(row["pr_auc"], average_precision(pairs), abs_tol=1e-9)
            assert math.isclose(row["brier"], mean((p - y) ** 2 for y, p in pairs), abs_tol=1e-9)
    table = {r["model"]: r for r in out.comparison.collect()}
    assert all(table[m]["roc_auc_train"] == got[m, "train"]["roc_auc"] for m in table)
    assert out.best == max(table, key=lambda m: (table[m]["roc_auc_oot"], [-ord(x) for x in m]))
    parts.unpersist()


@pytest.mark.parametrize("name", ["LogisticRegression", "BalancedRandomForest"])
def test_folds_are_scored_in_a_session_that_has_observed_a_write(spark, tmp_path, name):
    """The session of a training summary cannot be sent to tasks once it has observed a write."""
    from pitwall.sources.sessions import write_layer
    rows = [(dt.date(1996 + i % 4, 1 + i % 12, 1), (i // 5) % 2, (i * 37 % 101) / 100 + 0.3 * ((i // 5) % 2)) for i in range(240)]
    df = spark.createDataFrame(rows, "dt_ref date, y int, x double")
    write_layer(df, str(tmp_path / "layer"))
    c = tr.candidates(BalancedRandomForest={"numTrees": 3, "maxDepth": 2})[name]
    scores = tr.cross_validate(c, df, ["x"], "y", n_folds=2)
    assert len(scores) == 2 and all(0 < s <= 1 for s in scores)
