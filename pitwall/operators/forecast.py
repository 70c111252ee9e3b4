"""Signals, trailing contexts and one-step forecasts over entrant series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.functions.scalars import sigmoid
from pitwall.operators import evaluation as ev
from pitwall.operators.features import scoring

CONTEXT = 32
NO_FINISH = 15.0


def _of_year(results: DataFrame, year: int | None) -> DataFrame:
    """Scoring rows of a season: by its folder or column, and by date, which files can skip by."""
    r = scoring(results)
    if not year:
        return r
    day = F.col("event_date")
    return r.where((F.col("year") == year) & (day >= F.lit(f"{year}-01-01").cast("date")) & (day < F.lit(f"{year + 1}-01-01").cast("date")))


def _roster(results: DataFrame, cols: list[str], year: int | None) -> DataFrame:
    r = _of_year(results, year)
    return r.select(*cols, F.col("event_date").alias("dt_ref")).distinct()


def points_signal(features: DataFrame, results: DataFrame, year: int | None = None) -> DataFrame:
    """Recent points of each entrant present on a race date."""
    roster = _roster(results, ["driverid", "full_name", "team_name", "team_color"], year)
    f = features.select("driverid", "dt_ref", "total_points_last10")
    return f.join(roster, ["driverid", "dt_ref"]).select(
        "driverid", "dt_ref", "full_name", "team_name", "team_color",
        F.coalesce(F.col("total_points_last10").cast("double"), F.lit(0.0)).alias("score"))


def team_signal(features: DataFrame, results: DataFrame, year: int | None = None) -> DataFrame:
    """Recent points summed over a team's sessions of the date."""
    r = _of_year(results, year)
    r = r.select("driverid", "teamid", "team_name", F.col("event_date").alias("dt_ref"))
    f = features.select("driverid", "dt_ref", "total_points_last10")
    return r.join(f, ["driverid", "dt_ref"]).groupBy("teamid", "team_name", "dt_ref").agg(
        F.sum(F.coalesce(F.col("total_points_last10").cast("double"), F.lit(0.0))).alias("score"))


def departure_signal(avg_position: Column) -> Column:
    return -F.coalesce(avg_position, F.lit(NO_FINISH))


def contexts(df: DataFrame, entity: str, score: str, at: str = "dt_ref", length: int = CONTEXT) -> DataFrame:
    """The last ``length`` values up to each date; the first fills a short start.

    A series has one value per race date, so the calendar bounds its length.
    """
    value = F.coalesce(F.col(score).cast("float"), F.lit(0.0).cast("float"))
    w = W.partitionBy(entity).orderBy(at).rowsBetween(-(length - 1), 0)
    got = F.collect_list(value).over(w)
    out = df.withColumn("__got", got)
    pad = F.array_repeat(F.element_at("__got", 1), F.lit(length) - F.size("__got"))
    return out.withColumn("context", F.concat(pad, F.col("__got"))).drop("__got")


def trailing_mean(context="context") -> Column:
    return F.aggregate(context, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(context)


def linear_trend(context="context", length: int = CONTEXT) -> Column:
    """Least-squares line through the context, read one step ahead."""
    mean = (length - 1) / 2
    spread = sum((i - mean) ** 2 for i in range(length))
    weights = F.array(*[F.lit(1 / length + (length - mean) * (i - mean) / spread) for i in range(length)])
    parts = F.zip_with(context, weights, lambda x, c: x.cast("double") * c)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


# The rates that are tried, of the level and of the trend.
LEVEL_RATES = (0.1, 0.3, 0.5, 0.8)
TREND_RATES = (0.0, 0.1, 0.3)


def _smoothed(context: Column, level_rate: float, trend_rate: float) -> Column:
    """One pass over a context: the squared errors of its one-step forecasts, and the next forecast."""
    start = F.struct(F.element_at(context, 1).cast("double").alias("level"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("errors"))

    def step(a: Column, x: Column) -> Column:
        x, expected = x.cast("double"), a["level"] + a["trend"]
        level = F.lit(level_rate) * x + F.lit(1 - level_rate) * expected
        trend = F.lit(trend_rate) * (level - a["level"]) + F.lit(1 - trend_rate) * a["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), (a["errors"] + (x - expected) * (x - expected)).alias("errors"))

    rest = F.slice(context, F.lit(2), F.greatest(F.size(context) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda a: F.struct(a["errors"].alias("errors"), (a["level"] + a["trend"]).alias("forecast")))


def smoothed_trend(context="context", level_rates: tuple[float, ...] = LEVEL_RATES,
                   trend_rates: tuple[float, ...] = TREND_RATES) -> Column:
    """Level-and-trend smoothing with the rates that would have forecast the context best: their
    squared errors, rates and next forecast. Of equally good rates the first pair counts; an
    empty context has no forecast.
    """
    context = F.col(context) if isinstance(context, str) else context
    tried = []
    for i, (a, b) in enumerate((a, b) for a in level_rates for b in trend_rates):
        fit = _smoothed(context, a, b)
        tried.append(F.struct(fit["errors"].alias("errors"), F.lit(i).alias("i"), F.lit(a).alias("level_rate"),
                              F.lit(b).alias("trend_rate"), fit["forecast"].alias("forecast")))
    return F.when(F.size(context) > 0, F.array_min(F.array(*tried)))


def model_forecast(predict: Callable) -> Callable[[str], Column]:
    """Wrap ``predict(batch of contexts as a 2-d array) -> values`` for use on the column."""
    @F.pandas_udf("double")
    def run(context: pd.Series) -> pd.Series:
        return pd.Series(predict(np.stack(context.to_numpy())))
    return run


def probabilities(df: DataFrame, entity: str, score: str, normalize: str = "softmax",
                  forecast: Column | None = None, at: str = "dt_ref") -> DataFrame:
    """Forecast each series one step ahead and turn the values into probabilities."""
    raw = contexts(df, entity, score, at).withColumn(
        "__raw", forecast if forecast is not None else trailing_mean())
    if normalize == "softmax":
        raw = ev.softmax(raw, at, "__raw", "prob")
    else:
        raw = raw.withColumn("prob", sigmoid("__raw"))
    return raw.drop("__raw", "context")


# Signal and normalisation per target.
TARGETS = {
    "champion": ("driverid", "fl_champion", "total_points_last10", "softmax"),
    "constructor": ("teamid", "fl_constructor_champion", "sum_points_last10", "softmax"),
    "departure": ("driverid", "fl_departed", "departure_signal", "sigmoid"),
}


def evaluate_forecast(abt: DataFrame, target: str, scale: float = 1.0) -> DataFrame:
    """AUC before and in the newest year that has both classes."""
    entity, label, signal, normalize = TARGETS[target]
    if signal == "departure_signal":
        abt = abt.withColumn(signal, departure_signal(F.col("avg_position_life")))
    abt = abt.select(entity, "dt_ref", label, (F.col(signal) * F.lit(scale)).alias("score"))
    oot = ev.two_class_year(abt, label)
    probs = probabilities(abt.drop(label), entity, "score", normalize).select(entity, "dt_ref", "prob")
    scored = probs.join(abt.select(entity, "dt_ref", label).distinct(), [entity, "dt_ref"])
    year = F.year("dt_ref")
    part = F.when(year < oot, "train").when(year == oot, "oot")
    scored = scored.withColumn("split", part).where(F.col("split").isNotNull())
    out = ev.ranking_metrics(scored, label, "prob", ["split"])
    n = scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return out.join(n, "split").select("split", "roc_auc", "n_rows", F.lit(oot).alias("oot_year"))
