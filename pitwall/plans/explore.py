"""Console, explorer and prediction-page queries over the layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.functions.metrics import GROUPS
from pitwall.functions.scalars import lap_time, race_time, signed
from pitwall.operators import career
from pitwall.operators.features import scoring
from pitwall.operators.ordering import latest, quantiles, row_number, running, top_k
from pitwall.plans.lake import small

PERSON = ["driverid", "full_name"]


def won() -> Column:
    return F.col("position") == 1


def races(results: DataFrame) -> DataFrame:
    return results.where(F.col("mode") == "Race")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def pct(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part.cast("double") * 100 / F.nullif(whole, F.lit(0)), digits)


def first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


# -- results ----------------------------------------------------------------
def most_races(results: DataFrame, n: int = 20) -> DataFrame:
    out = races(results).groupBy(*PERSON).agg(F.count(F.lit(1)).alias("races"))
    return first(out, [F.desc("races"), F.col("driverid")], n)


def season_points(results: DataFrame, year: int) -> DataFrame:
    return (races(results).where(F.col("year") == year)
            .groupBy(*PERSON, "team_name").agg(F.sum("points").alias("total_points")))


def dnf_rate(results: DataFrame, min_races: int = 50, n: int = 20) -> DataFrame:
    lost = F.sum(1 - F.col("is_finished"))
    out = races(results).groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("races"), lost.alias("dnfs"),
        pct(lost, F.count(F.lit(1)), 1).alias("dnf_pct"))
    return first(out.where(F.col("races") >= min_races), [F.desc("dnf_pct"), F.col("driverid")], n)


def wet_races(results: DataFrame, n: int = 50) -> DataFrame:
    cols = ["year", "event_name", *PERSON, "team_name", "grid_position", "position", "points", "air_temp", "humidity"]
    out = races(results).where("rainfall = 1").select(*cols)
    return first(out, [F.desc("year"), F.col("position"), F.col("event_name")], n)


def circuit_weather(results: DataFrame) -> DataFrame:
    known = races(results).where("air_temp IS NOT NULL")
    return known.groupBy("location", "country").agg(
        F.countDistinct("year").alias("seasons"),
        *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in ("air_temp", "track_temp", "humidity", "wind_speed")],
        F.sum("rainfall").alias("rain_sessions"))


def team_wins(results: DataFrame) -> DataFrame:
    return races(results).groupBy("year", "team_name").agg(count_if(won()).alias("wins")).where("wins > 0")


def pole_conversion(results: DataFrame, min_poles: int = 3) -> DataFrame:
    pole = F.col("grid_position") == 1
    out = races(results).groupBy(*PERSON).agg(
        count_if(pole).alias("poles"), count_if(pole & won()).alias("pole_wins"),
        pct(count_if(pole & won()), count_if(pole), 1).alias("conversion_pct"))
    return out.where(F.col("poles") >= min_poles)


def overtakers(results: DataFrame, min_races: int = 30, n: int = 20) -> DataFrame:
    gain = F.col("grid_position") - F.col("position")
    out = races(results).where("is_finished = 1").where(gain.isNotNull()).groupBy(*PERSON).agg(
        F.count(F.lit(1)).alias("races"), F.round(F.avg(gain), 2).alias("avg_positions_gained"),
        F.max(gain).alias("best_recovery"))
    return first(out.where(F.col("races") >= min_races),
                 [F.desc("avg_positions_gained"), F.col("driverid")], n)


# -- features ---------------------------------------------------------------
def evolution(features: DataFrame, entrant, cols: list[str], n: int = 20) -> DataFrame:
    return first(features.where(F.col("driverid") == entrant).select("dt_ref", *cols), [F.desc("dt_ref")], n)


def newest_rows(df: DataFrame, key: str) -> DataFrame:
    return latest(df, [key], [F.col("dt_ref").desc_nulls_last()])


def named(df: DataFrame, results: DataFrame) -> DataFrame:
    """Newest name and team of each entrant; the id stands in for a missing name."""
    out = df.join(career.latest_names(results), "driverid", "left")
    return out.withColumn("full_name", F.coalesce("full_name", F.col("driverid").cast("string")))


def metric_column(group: str, window: str, nth: int = 0) -> str:
    return f"{GROUPS[group][nth]}_{window}"


def explorer(features: DataFrame, results: DataFrame, metric: str, years: tuple[int, int],
             by: str = "driver") -> DataFrame:
    upto = F.col("dt_ref") < F.make_date(F.lit(years[1] + 1), F.lit(1), F.lit(1))  # a range of dates, which reaches the scan
    rows = features.where((F.col("dt_ref") >= F.make_date(F.lit(years[0]), F.lit(1), F.lit(1))) & upto)
    rows = named(rows.select("dt_ref", "driverid", metric), results)
    if by == "driver":
        return rows
    return rows.groupBy("dt_ref", "team_name").agg(F.avg(F.col(metric).cast("double")).alias(metric))


def last_values(df: DataFrame, key: str, cols: list[str], at: str = "dt_ref") -> DataFrame:
    """Last non-null value of every column on its own."""
    return df.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in cols])


def leading(df: DataFrame, key: str, by: str, k: int, cols: list[str], descending: bool = False) -> DataFrame:
    last = last_values(df, key, list(dict.fromkeys([by, *cols])))
    by_col = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return first(last, [by_col, F.col(key)], k)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson matrix over the rows where both are known; a constant gives NULL.

    A first pass finds columns without NULLs; their spread is shared by all pairs.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in cols
                                                  for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    whole = {c for c in cols if stats[f"n_{c}"] == stats["n"]}
    flat = {c for c in cols if stats[f"lo_{c}"] == stats[f"hi_{c}"]}

    def corr(a, b):
        if a in flat or b in flat:
            return F.max(F.lit(None).cast("double"))
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        if a in whole and b in whole:
            return F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        return F.when(~constant, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs) for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])]
    return one.select(F.inline(F.array(*rows)))


def points_distribution(results: DataFrame, years: tuple[int, int]) -> DataFrame:
    per = (races(results).where(F.col("year").between(*years))
           .groupBy("year", *PERSON).agg(F.sum("points").alias("points")))
    ends = per.groupBy("year").agg(F.min("points").alias("low"), F.max("points").alias("high"))
    mid = quantiles(per.withColumn("points", F.col("points").cast("double")), ["year"], "points", "driverid",
                    {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return mid.join(ends, "year")


def cumulative_win_rate(results: DataFrame) -> DataFrame:
    w = (W.partitionBy("driverid").orderBy("event_date", "round_number")
         .rowsBetween(W.unboundedPreceding, 0))
    out = races(results).select(*PERSON, "event_date", F.count(F.lit(1)).over(w).alias("cum_races"),
                                F.sum(won().cast("int")).over(w).alias("cum_wins"))
    return out.withColumn("win_rate", F.col("cum_wins").cast("double") / F.col("cum_races"))


def team_points(results: DataFrame, years: tuple[int, int]) -> DataFrame:
    return (races(results).where(F.col("year").between(*years))
            .groupBy("year", "team_name").agg(F.sum("points").alias("points")))


def grid_vs_finish(results: DataFrame, year: int) -> DataFrame:
    gain = F.col("grid_position") - F.col("position")
    return (races(results).where(F.col("year") == year).dropna(subset=["grid_position", "position"])
            .select("driverid", "event_name", "team_name", "grid_position", "position",
                    signed(gain).alias("gained"),
                    F.when(gain > 0, "gained").when(gain < 0, "lost").otherwise("held").alias("change")))


def average_finish(results: DataFrame) -> DataFrame:
    return races(results).groupBy("year", "full_name").agg(F.avg(F.col("position").cast("double")).alias("position"))


def season_progression(results: DataFrame, year: int, k: int = 10) -> DataFrame:
    rows = races(results).where(F.col("year") == year)
    top = first(rows.groupBy("driverid").agg(F.sum("points").alias("total")),
                [F.desc("total"), F.col("driverid")], k).select("driverid")
    w = W.partitionBy("driverid").orderBy("round_number").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(F.broadcast(top), "driverid", "left_semi").select(
        "driverid", "round_number", F.sum("points").over(w).alias("cum_points"))


# -- current season ---------------------------------------------------------
def current_season(results: DataFrame) -> DataFrame:
    rows = races(results)
    return rows.join(F.broadcast(rows.agg(F.max("year").alias("year"))), "year")


def current_standings(results: DataFrame) -> DataFrame:
    per = current_season(results).groupBy(*PERSON, "team_name", "team_color").agg(
        F.sum("points").alias("total_points"), F.count(F.lit(1)).alias("races"),
        count_if(won()).alias("wins"), count_if(F.col("position") <= 3).alias("podiums"),
        F.round(F.avg(F.col("position").cast("double")), 1).alias("avg_position"))
    return row_number(per, [], [-F.col("total_points"), F.col("driverid")], "pos")


def season_events(results: DataFrame) -> DataFrame:
    return current_season(results).select("round_number", "event_name", "event_date", "year").distinct()


# -- predictions ------------------------------------------------------------
def top_pick(scored: DataFrame, key: str, prob: str) -> DataFrame:
    return top_k(scored, ["dt_ref"], [F.col(prob).desc_nulls_last(), F.col(key)], 1)


def standing_leader(scored: DataFrame, key: str, prob: str, place: str) -> DataFrame:
    return top_pick(scored.where(F.col(place) == 1), key, prob)


def top1_evolution(scored: DataFrame, labels: DataFrame, key: str, prob: str, place: str) -> DataFrame:
    """Three series by date: the pick, the eventual champion, the standings leader."""
    year = F.year("dt_ref")

    def series(df, name):
        return df.select(F.lit(name).alias("series"), "dt_ref", key, F.col(prob).alias("prob"))

    won = small(labels.select("year", F.col(key)))
    champion = scored.withColumn("year", year).join(won, ["year", key])
    return (series(top_pick(scored, key, prob), "pick")
            .unionByName(series(champion, "champion"))
            .unionByName(series(standing_leader(scored, key, prob, place), "leader")))


def newest_date(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max("dt_ref").alias("dt_ref"))), "dt_ref")


def risk_selection(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Up to six high, four medium and two low risks, else the six highest."""
    quota = F.when(F.col("risk_tier") == "High", 6).when(F.col("risk_tier") == "Medium", 4).otherwise(2)
    order = [F.col(prob).desc_nulls_last(), F.col("driverid")]
    tiers = scored.where(F.col("risk_tier").isNotNull())
    per = top_k(tiers, ["risk_tier"], order, 6, "tier_place").where(F.col("tier_place") <= quota)
    spare = first(scored, order, 6).withColumn("tier_place", F.lit(None).cast("int"))
    return per if tiers.limit(1).count() else spare


def season_of(df: DataFrame, year: int, at: str = "dt_ref") -> DataFrame:
    """One season: by the folders of a table stored by season, and as a date range, which files can skip by."""
    day = F.col(at)
    if "season" in df.columns:
        df = df.where(F.col("season") == year)
    return df.where((day >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
                    & (day < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))


def season_list(df: DataFrame, current_year: int) -> DataFrame:
    """Seasons in the table and the current one, newest first."""
    now = df.sparkSession.createDataFrame([(current_year,)], "year int")
    return df.select(F.year("dt_ref").alias("year")).unionByName(now).distinct().orderBy(F.desc("year"))


# Fixed values: (source, heading) of the event result table.
RESULT_COLUMNS = [
    ("position", "Pos"), ("full_name", "Driver"), ("team_name", "Team"), ("quali_position", "Quali"),
    ("grid_position", "Grid"), ("change", "+/-"), ("quali_text", "Quali Time"),
    ("race_text", "Race Time"), ("points", "Points"), ("status", "Status"),
]


def result_table(event: DataFrame) -> DataFrame:
    """Display form of one event: whole numbers, formatted times, headings."""
    best = event.agg(F.min("position")).first()[0]
    out = event.withColumns({
        "change": signed("positions_gained"),
        "quali_text": lap_time("best_quali_time"),
        "race_text": race_time("race_time", F.col("position") == F.lit(best)),
        **{c: F.col(c).cast("bigint") for c in ("position", "grid_position", "quali_position", "points")},
    })
    return out.select(*[F.col(c).alias(h) for c, h in RESULT_COLUMNS]).orderBy(F.col("Pos").asc_nulls_last())
