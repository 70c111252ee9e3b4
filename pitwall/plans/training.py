"""Temporal model training, selection and season scoring with Spark ML."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import mean, pstdev

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitwall.functions.metrics import NAMES, SPRINT_METRICS
from pitwall.functions.scalars import FILL, risk_tier
from pitwall.operators import evaluation as ev
from pitwall.operators.career import latest_names
from pitwall.operators.features import WINDOWS
from pitwall.operators.ordering import latest
from pitwall.plans.base_tables import QUALI_ROLLUP, TEAM_ROLLUP
from pitwall.plans.lake import cut, shared_root
from pitwall.plans.search import Study, run_folds, search

# Curated inputs of the three models and of the team explorer.
CHAMPION_FEATURES = [
    "avg_position_last10", "avg_grid_last10", "avg_overtakes_last10", "total_points_last10",
    "qtd_wins_last10", "qtd_podiums_last10", "qtd_top5_last10", "qtd_poles_last10",
    "qtd_pole_win_last10", "qtd_sessions_with_points_last10", "standing_position",
    "points_pct_of_leader", "gap_momentum_3r", "points_accel", "pct_leader_x_wins",
    "pct_leader_x_podiums", "pct_leader_x_points",
]
TEAM_FEATURES = [
    "sum_wins_last10", "sum_podiums_last10", "avg_position_last10", "avg_grid_last10",
    "avg_quali_position_last10", "team_standing_position", "team_points_pct_of_leader",
    "team_gap_momentum_3r",
]
TEAM_EXPLORER_FEATURES = [
    "sum_wins_last10", "sum_podiums_last10", "sum_points_last10", "avg_position_last10",
    "avg_grid_last10", "team_standing_position", "team_points_pct_of_leader",
    "team_points_accel", "team_pct_leader_x_wins", "team_pct_leader_x_podiums",
    "team_pct_leader_x_points",
]
DEPARTURE_FEATURES = [
    "avg_position_last10", "avg_quali_position_last10", "qtd_top5_last10",
    "qtd_quali_top10_last10", "total_points_last10", "total_points_race_last10",
    "total_points_life", "total_points_race_life", "qtd_wins_life", "qtd_top5_life",
    "qtd_podiums_life", "qtd_grid_top5_life", "driver_age", "seasons_since_last_podium",
    "seasons_since_last_win", "team_tenure_years", "career_distinct_teams",
    "teammate_position_gap", "teammate_grid_gap", "team_points_share",
    "season_points_current", "season_dnf_rate", "trend_win_rate", "trend_podium_rate",
]


# Columns that never are inputs, and sprint metrics worth keeping.
NOT_INPUTS = {"dt_ref", "driverid", "year", "teamid", "team_name", "fl_champion",
              "fl_constructor_champion", "fl_departed", "prediction_year", "data_as_of"}
SPRINT_INPUTS = {"qtd_sprint", "qtd_wins_sprint", "total_points_sprint", "qtd_podiums_sprint"}
INPUT_WINDOWS = ("life", "last10")


def _described() -> dict[str, tuple[str, str]]:
    """Every feature column a base table can hold, as (metric, window): of entrants and rolled up to teams."""
    out = {f"{m}_{w}": (m, w) for m in NAMES for w in WINDOWS}
    for source, name, kinds in TEAM_ROLLUP + QUALI_ROLLUP:
        out |= {f"{kind}_{name}": out[source] for kind in kinds.split()}
    return out


def feature_columns(columns: list[str], exclude: tuple[str, ...] = (), windows: tuple[str, ...] = INPUT_WINDOWS,
                    sprint: set[str] = SPRINT_INPUTS) -> list[str]:
    """Model inputs among the columns of a base table.

    Metrics count over the named windows only, sprint metrics only if named;
    columns that are no metric (standings, team mates, age) always do.
    """
    left_out = {c for c, (m, w) in _described().items()
                if w not in windows or (m in SPRINT_METRICS and m not in sprint)}
    return [c for c in columns if c not in NOT_INPUTS | left_out | set(exclude)]


N_FOLDS = 5
N_TRIALS = 30
PARALLEL_TRIALS = 4
PART_VALUES = 4_000_000  # input values in one part of a fold's rows, 32 MB; copies for a balanced forest may double it


@dataclass
class Candidate:
    """An estimator with its defaults and the ranges a search may draw from."""

    name: str
    build: Callable
    params: dict
    space: dict = field(default_factory=dict)
    scaled: bool = False
    early_stop: bool = False
    balanced: bool = False  # every tree draws as many rows of either class


# Defaults and search ranges. ("int", low, high, step), ("float", low,
# high), ("log", low, high), ("share", low, high), a fraction as text, or ("pick", choices).
CANDIDATES = {
    "LogisticRegression": Candidate(
        "LogisticRegression", LogisticRegression, {"maxIter": 200, "tol": 1e-3}, {
            "regParam": ("log", 1e-4, 10.0), "elasticNetParam": ("float", 0.2, 1.0)}, scaled=True),
    "GradientBoosting": Candidate(
        "GradientBoosting", GBTClassifier,
        {"maxIter": 200, "maxDepth": 3, "stepSize": 0.01, "minInstancesPerNode": 200, "seed": 42}, {
            "maxIter": ("int", 50, 500, 50), "maxDepth": ("int", 2, 6, 1), "stepSize": ("log", 0.005, 0.1),
            "subsamplingRate": ("float", 0.5, 0.9), "featureSubsetStrategy": ("share", 0.3, 0.8),
            "minInstancesPerNode": ("int", 5, 100, 1)}, early_stop=True),
    "BalancedRandomForest": Candidate(
        "BalancedRandomForest", RandomForestClassifier,
        {"numTrees": 500, "maxDepth": 10, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt",
         "subsamplingRate": 0.8, "seed": 42}, {
            "numTrees": ("int", 200, 800, 100), "maxDepth": ("int", 5, 20, 1),
            "minInstancesPerNode": ("int", 2, 30, 1), "subsamplingRate": ("float", 0.5, 1.0),
            "featureSubsetStrategy": ("pick", ["sqrt", "log2", "0.3", "0.5", "0.7"])}, balanced=True),
}


def candidates(skip: tuple[str, ...] = (), **overrides: dict) -> dict[str, Candidate]:
    """The three candidates; ``overrides`` replaces defaults by candidate name."""
    out = {}
    for name, c in CANDIDATES.items():
        if name not in skip:
            out[name] = Candidate(c.name, c.build, {**c.params, **overrides.get(name, {})},
                                  c.space, c.scaled, c.early_stop, c.balanced)
    return out


def preparation(c: Candidate, features: list[str]) -> list:
    """The stages before the estimator. They do not depend on its settings."""
    stages = [VectorAssembler(inputCols=features, outputCol="inputs", handleInvalid="keep")]
    if c.scaled:
        stages.append(StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True, withStd=True))
    return stages


def last_stage(c: Candidate, target: str, params: dict | None = None, stop_on: str | None = None, draw: float = 1.0):
    """The estimator; ``draw`` scales the share of rows that a tree draws."""
    params = {**c.params, **(params or {})}
    if c.balanced:
        params["subsamplingRate"] = params.get("subsamplingRate", 1.0) * draw
    more = {"validationIndicatorCol": stop_on} if stop_on and c.early_stop else {}
    return c.build(featuresCol="scaled" if c.scaled else "inputs", labelCol=target, weightCol="weight", **params, **more)


def _ready(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing inputs get a constant far outside their range."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(FILL))) for f in features})


def balanced(c: Candidate, df: DataFrame, target: str, counts: dict[float, int] | None = None) -> tuple[DataFrame, float]:
    """Rows with ``weight`` under which both classes count the same, and the factor of a tree's draw.

    For a balanced forest the rarer class is copied, see ``evaluation.balanced_copies``;
    otherwise rows weigh n / (2 * n_class).
    """
    rows = df.withColumn(target, F.col(target).cast("double")).where(F.col(target).isNotNull())
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy(target).count().collect()}  # one row a class
    if c.balanced:
        rows, draw = ev.balanced_copies(rows, target, counts)
        return rows.withColumn("weight", F.lit(1.0)), draw
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for label, n in counts.items():
        weight = F.when(F.col(target) == label, total / (2.0 * n)).otherwise(weight)
    return rows.withColumn("weight", weight), 1.0


def stored(model):
    """The model as read back from storage, without the training summary.

    The summary refers to the training rows and to the session, which cannot be sent
    to tasks once it has observed a write; a fitted model would take it there.
    """
    path = f"{shared_root(SparkSession.active())}/models/{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def fit(c: Candidate, df: DataFrame, features: list[str], target: str, params: dict | None = None,
        stop_on: str | None = None) -> PipelineModel:
    """Fit with both classes counting the same. The stored copy is returned."""
    rows, draw = balanced(c, _ready(df, features), target)
    return stored(Pipeline(stages=[*preparation(c, features), last_stage(c, target, params, stop_on, draw)]).fit(rows))


def score(model: PipelineModel, df: DataFrame, features: list[str], name: str = "prob") -> DataFrame:
    out = model.transform(_ready(df, features).select("*"))
    keep = [F.col(c) for c in df.columns]
    return out.withColumn(name, vector_to_array("probability")[1]).select(*keep, name)


def _score_of(scored: DataFrame, target: str, scoring: str) -> float:
    if scoring == "f1":
        return ev.threshold_metrics(scored, target, "prob").first()["f1"]
    col = "roc_auc" if scoring == "roc_auc" else "pr_auc"
    return ev.ranking_metrics(scored, target, "prob").first()[col]


@dataclass
class Fold:
    """Prepared rows of one expanding fold, or the score of a validation year of one class: its positive rate."""

    train: DataFrame | None = None
    validation: DataFrame | None = None
    draw: float = 1.0
    rate: float | None = None


class Folds:
    """Expanding folds, prepared once for all settings of a candidate and kept until the block ends.

    A fit passes over its rows hundreds of times and many fits run side by side, so a fold
    has no more parts than its values ask for. They are dealt anew: merged in place, the
    parts of all folds would lie on the executor of the first.
    """

    def __init__(self, c: Candidate, df: DataFrame, features: list[str], target: str, n_folds: int = N_FOLDS,
                 scoring: str = "average_precision"):
        self.c, self.df, self.features, self.target, self.n, self.scoring = c, df, features, target, n_folds, scoring
        self.spark, self.folds, self._kept = df.sparkSession, [], []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self._kept[-1]

    def _dealt(self, df: DataFrame, n_rows: int, parts: int) -> DataFrame:
        enough = max(1, math.ceil(n_rows * len(self.features) / PART_VALUES))
        return df.repartition(enough) if enough < parts else df

    def __enter__(self) -> Folds:
        label = F.col(self.target).cast("double")
        rows = _ready(self.df.select("dt_ref", self.target, *self.features), self.features).where(label.isNotNull())
        rows = self._keep(rows)
        per = {}
        for r in rows.groupBy(F.year("dt_ref").alias("y"), label.alias("label")).count().collect():  # two rows a year
            per.setdefault(r["y"], {})[r["label"]] = r["count"]
        parts = rows.rdd.getNumPartitions()
        for year in ev.fold_years(list(per), self.n):
            here = per[year]
            if len(here) < 2:
                self.folds.append(Fold(rate=float(next(iter(here)))))
                continue
            counts = {}
            for y in per:
                for k, n in per[y].items():
                    counts[k] = counts.get(k, 0) + n * (y < year)
            counts = {k: n for k, n in counts.items() if n}
            train, draw = balanced(self.c, rows.where(F.col("dt_ref") < F.lit(f"{year}-01-01").cast("date")), self.target, counts)
            prepared = Pipeline(stages=preparation(self.c, self.features)).fit(train)
            inputs = "scaled" if self.c.scaled else "inputs"
            train = self._dealt(prepared.transform(train).select(self.target, "weight", inputs), sum(counts.values()), parts)
            validation = self._dealt(
                prepared.transform(_season(rows, year)).select("dt_ref", self.target, inputs), sum(here.values()), parts)
            self.folds.append(Fold(self._keep(train), self._keep(validation), draw))
        return self

    def __exit__(self, *_) -> None:
        for df in self._kept:
            df.unpersist()

    def score(self, params: dict | None, fold: int) -> float:
        f = self.folds[fold]
        if f.rate is not None:
            return f.rate
        model = stored(last_stage(self.c, self.target, params, None, f.draw).fit(f.train))
        scored = model.transform(f.validation).withColumn("prob", vector_to_array("probability")[1])
        return float(_score_of(scored.select("dt_ref", self.target, "prob"), self.target, self.scoring) or 0.0)


def cross_validate(c: Candidate, df: DataFrame, features: list[str], target: str, params: dict | None = None,
                   n_folds: int = N_FOLDS, scoring: str = "average_precision") -> list[float]:
    """Score of each expanding fold. A one-class validation year scores its positive rate."""
    with Folds(c, df, features, target, n_folds, scoring) as folds:
        return run_folds(df.sparkSession, f"validate-{uuid.uuid4().hex}", len(folds.folds), lambda i: folds.score(params, i))[0]


def _space(space: dict, overrides: dict | None) -> dict:
    return {**space, **{k: v for k, v in (overrides or {}).items() if k in space}}


def draws(space: dict, n: int, seed: int = 42, overrides: dict | None = None) -> list[dict]:
    """``n`` seeded uniform settings from the ranges."""
    study = Study(_space(space, overrides), seed, "uniform")
    return [study.propose().params for _ in range(n)]


def tune(c: Candidate, df: DataFrame, features: list[str], target: str, n_trials: int = N_TRIALS,
         scoring: str = "average_precision", n_folds: int = N_FOLDS,
         overrides: dict | None = None, sampler: str = "parzen", seed: int = 42) -> dict:
    """Best of the tried settings and of the defaults; a tie keeps the defaults. ``study`` holds the trials."""
    study = Study(_space(c.space, overrides), seed, sampler)
    with Folds(c, df, features, target, n_folds, scoring) as folds:
        n, spark = len(folds.folds), df.sparkSession
        base = run_folds(spark, f"defaults-{uuid.uuid4().hex}", n, lambda i: folds.score(None, i))[0]
        # a setting that the estimator refuses loses; anything else rises
        search(spark, study, n_trials, n, folds.score, (IllegalArgumentException,), PARALLEL_TRIALS, f"tune-{uuid.uuid4().hex}")
    best = study.best()
    better = best is not None and best.score > mean(base)
    return {"cv_score": mean(base), "cv_std": pstdev(base), "params": best.params if better else {},
            "tuned_cv_score": best.score if better else mean(base), "study": study}


def importances(model: PipelineModel, features: list[str], n: int = 30) -> list[tuple[str, float]]:
    """Largest importances, absolute coefficients for a linear model."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(f, abs(float(v))) for f, v in zip(features, values.toArray())]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


@dataclass
class Task:
    """One prediction target."""

    target: str
    key: str
    features: list[str]
    scoring: str
    drop_last: int
    oot_years: list[int] | None = None
    early_stop: bool = False
    overrides: dict = field(default_factory=dict)


# The three targets and how each is trained.
TASKS = {
    "champion": Task("fl_champion", "driverid", CHAMPION_FEATURES, "average_precision", 0, [2024, 2025, 2026]),
    "constructor": Task("fl_constructor_champion", "teamid", TEAM_FEATURES, "combined", 0, [2024, 2025], True,
                        {"maxIter": ("int", 50, 300, 50), "minInstancesPerNode": ("int", 50, 200, 1)}),
    "departure": Task("fl_departed", "driverid", DEPARTURE_FEATURES, "roc_auc", 5, [2025]),
}


@dataclass
class Trained:
    metrics: DataFrame
    comparison: DataFrame
    best: str
    models: dict[str, PipelineModel]
    final: PipelineModel
    skipped: dict[str, str] = field(default_factory=dict)


def train(abt: DataFrame, task: Task, cands: dict[str, Candidate] | None = None,
          winners: DataFrame | None = None, n_trials: int = N_TRIALS, n_folds: int = N_FOLDS) -> Trained:
    """Tune, fit and measure every candidate, pick the best and refit it on all rows."""
    cands = cands or candidates()
    spark = abt.sparkSession
    cols = ["dt_ref", task.key, task.target, *task.features]
    rows = abt.select(*cols).where(F.col(task.target).isNotNull())
    parts = ev.split(rows, task.target, task.oot_years, task.drop_last).persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows = parts.where("split = 'train'")
    cv_scoring = "average_precision" if task.scoring == "combined" else task.scoring
    tuned, models, scored, skipped = {}, {}, [], {}
    for name, c in cands.items():
        try:
            t = tune(c, fit_rows, task.features, task.target, n_trials, cv_scoring, n_folds, task.overrides)
            stop = None
            source = fit_rows
            if task.early_stop and c.early_stop:
                newest = fit_rows.agg(F.max(F.year("dt_ref"))).first()[0]
                stop, source = "is_val", fit_rows.withColumn("is_val", F.year("dt_ref") == newest)
            models[name] = fit(c, source, task.features, task.target, t["params"], stop)
        except IllegalArgumentException as e:  # refused rows or settings; anything else rises
            skipped[name] = str(e)
            continue
        tuned[name] = t
        scored.append(score(models[name], parts, task.features).select(
            F.lit(name).alias("model"), "split", "dt_ref", task.key, F.col(task.target).alias("y"), "prob"))
    if not scored:
        raise RuntimeError(f"no candidate could be trained: {skipped}")
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    every = cut(every)  # scored once for all metrics
    parts.unpersist()
    metrics = ev.evaluate(every, "y", "prob", ["model", "split"], winners, task.key)
    cv = spark.createDataFrame([(m, t["cv_score"], t["tuned_cv_score"]) for m, t in tuned.items()],
                               "model string, cv_score double, tuned_cv_score double")
    have = [c for c in ev.HIGHER + ev.LOWER if c in metrics.columns]
    table = ev.comparison(metrics, have).join(cv, "model")
    if "top1_acc" not in have:
        table = table.withColumn("top1_acc_test", F.lit(None).cast("double"))
    best = ev.best_model(table, task.scoring).first()["model"]
    # the winner is tuned again on all rows before its last fit
    last = tune(cands[best], rows, task.features, task.target, n_trials, cv_scoring, n_folds, task.overrides)
    final = fit(cands[best], rows, task.features, task.target, last["params"])
    return Trained(metrics, table, best, models, final, skipped)


def _season(abt: DataFrame, year: int) -> DataFrame:
    return abt.where((F.col("dt_ref") >= F.lit(f"{year}-01-01").cast("date"))
                     & (F.col("dt_ref") < F.lit(f"{year + 1}-01-01").cast("date")))


def score_season(model: PipelineModel, abt: DataFrame, year: int, features: list[str], key: str,
                 context: list[str], name: str) -> DataFrame:
    """Probabilities by race date; before the first race, from last season's final rows."""
    rows = _season(abt, year)
    if not rows.limit(1).count():
        rows = latest(_season(abt, year - 1), [key], [F.col("dt_ref").desc()])
    out = score(model, rows, features, name)
    return out.select("dt_ref", key, name, *context, F.lit(year).alias("year"))


def score_departures(model: PipelineModel, abt: DataFrame, features: list[str],
                     results: DataFrame, year: int | None = None) -> DataFrame:
    """Departure risk by race date with its tier; the newest season unless given."""
    if year is None:
        year = abt.agg(F.max(F.year("dt_ref"))).first()[0]
    out = score(model, _season(abt, year), features, "prob_departure")
    out = out.select("dt_ref", "driverid", "prob_departure", risk_tier("prob_departure").alias("risk_tier"),
                     "season_race_number", "season_fraction", F.lit(year).alias("year"))
    return out.join(latest_names(results), "driverid", "left")
