"""Career features of an entrant: team mates, tenure, moves and departure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.operators.features import numbered_days, race_dates, scoring, spread
from pitwall.operators.ordering import latest
from pitwall.plans.lake import small

ID = "driverid"


def entrant_years(results: DataFrame) -> DataFrame:
    return results.select(ID, "year").distinct()


def departure_label(results: DataFrame, open_season: bool = False) -> DataFrame:
    """1 if the entrant has no session in the following year.

    With ``open_season`` the newest year is NULL: its following year is unknown.
    """
    years = entrant_years(results)
    following = F.lead("year").over(W.partitionBy(ID).orderBy("year"))
    gone = F.when(following == F.col("year") + 1, 0).otherwise(1)
    out = years.withColumn("fl_departed", gone)
    if open_season:
        newest = results.agg(F.max("year")).first()[0]
        out = out.withColumn("fl_departed", F.when(F.col("year") != F.lit(newest), F.col("fl_departed")))
    return out


def last_session(results: DataFrame) -> DataFrame:
    return results.groupBy(ID, "year").agg(F.max("event_date").alias("dt_ref"))


def season_team(results: DataFrame) -> DataFrame:
    """Team at the last session of the year, if that day had a race or sprint."""
    at = last_session(results)
    on_day = scoring(results).join(
        at.withColumnRenamed("dt_ref", "event_date"), [ID, "year", "event_date"], "left_semi")
    return on_day.groupBy(ID, "year").agg(F.min("teamid").alias("teamid"))


def _season_sums() -> list[Column]:
    return [F.sum("points").alias("season_points"),
            F.avg(F.col("position").cast("double")).alias("season_avg_position"),
            F.avg(F.col("grid_position").cast("double")).alias("season_avg_grid"),
            F.count(F.lit(1)).alias("season_races"),
            F.count(F.when(F.col("is_finished") == 0, 1)).alias("season_dnfs")]


def _compare(stats: DataFrame, teams: DataFrame, keys: list[str]) -> DataFrame:
    """Entrant against its team; the grid gap is measured to the team's finish."""
    share = F.when(F.col("team_total_points") > 0,
                   F.col("season_points").cast("double") / F.col("team_total_points")).otherwise(0.5)
    return stats.join(teams, keys).withColumns({
        "team_points_share": share,
        "teammate_position_gap": F.col("season_avg_position") - F.col("team_avg_position"),
        "teammate_grid_gap": F.col("season_avg_grid") - F.col("team_avg_position"),
        "season_dnf_rate": F.col("season_dnfs").cast("double") / F.col("season_races"),
        "season_points_current": F.col("season_points"),
    })


TEAMMATE = ["team_points_share", "teammate_position_gap", "teammate_grid_gap",
            "season_dnf_rate", "season_points_current"]


def _team_totals(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(F.sum("season_points").alias("team_total_points"),
                                    F.avg("season_avg_position").alias("team_avg_position"))


def teammate_gap(results: DataFrame, on_transfer: str = "fanout") -> DataFrame:
    """Season-end comparison with the last team.

    An entrant who changed team gets one row per team it drove for ("fanout"),
    all measured against the last team, or only the last team's row
    ("last_team").
    """
    stats = scoring(results).groupBy(ID, "teamid", "year").agg(*_season_sums())
    teams = _team_totals(stats, ["teamid", "year"])
    at_end = season_team(results)
    if on_transfer == "last_team":
        own = stats.join(at_end, [ID, "year", "teamid"])
    else:
        own = stats.drop("teamid").join(at_end, [ID, "year"])
    return _compare(own, teams, ["teamid", "year"]).select(ID, "year", *TEAMMATE)


def season_so_far(results: DataFrame) -> DataFrame:
    """Season sums per (entrant, team) strictly before each race date.

    Running sums give the state after each day. Race dates are numbered, and each
    state names the dates up to the pair's next day, so no date meets another state.
    """
    per = scoring(results).groupBy(ID, "teamid", "year", "event_date").agg(
        F.sum("points").alias("p"), F.sum("position").alias("ps"), F.count("position").alias("pn"),
        F.sum("grid_position").alias("gs"), F.count("grid_position").alias("gn"),
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_finished") == 0, 1)).alias("d"))
    days = small(numbered_days(results))
    refs = days.where("is_ref = 1").select(F.col("n").alias("i"), F.col("event_date").alias("dt_ref"))
    ends = days.where("is_ref = 1").join(small(race_dates(results)), days.event_date == F.col("dt_ref")).groupBy(
        F.col("ref_year").alias("year")).agg(F.max("n").alias("season_end"))
    per = per.join(days.select("event_date", F.col("n").alias("i0")), "event_date").join(small(ends), "year")
    own = W.partitionBy(ID, "teamid", "year").orderBy("event_date")
    upto = own.rowsBetween(W.unboundedPreceding, 0)
    state = per.select(
        ID, "teamid", "year", "i0", F.coalesce(F.lead("i0").over(own), "season_end").alias("i1"),
        *[F.sum(c).over(upto).alias(c) for c in ("p", "ps", "pn", "gs", "gn", "n", "d")])
    return spread(state, F.col("i0") + 1, F.col("i1"), refs).select(
        "dt_ref", ID, "teamid", "year", F.col("p").alias("season_points"),
        (F.col("ps").cast("double") / F.nullif(F.col("pn"), F.lit(0))).alias("season_avg_position"),
        (F.col("gs").cast("double") / F.nullif(F.col("gn"), F.lit(0))).alias("season_avg_grid"),
        F.col("n").alias("season_races"), F.col("d").alias("season_dnfs"))


def current_team(results: DataFrame) -> DataFrame:
    return scoring(results).select(F.col("event_date").alias("dt_ref"), ID, "teamid").distinct()


def teammate_gap_inseason(results: DataFrame) -> DataFrame:
    """The same comparison before each race date, for the team driven for there."""
    stats = season_so_far(results)
    teams = _team_totals(stats, ["dt_ref", "teamid"])
    own = stats.join(current_team(results), ["dt_ref", ID, "teamid"])
    return _compare(own, teams, ["dt_ref", "teamid"]).select("dt_ref", ID, *TEAMMATE)


def tenure(results: DataFrame) -> DataFrame:
    """Consecutive seasons with the same team, restarting after a gap."""
    years = results.select(ID, "teamid", "year").distinct()
    stint = F.col("year") - F.row_number().over(W.partitionBy(ID, "teamid").orderBy("year"))
    years = years.withColumn("stint", stint)
    n = F.row_number().over(W.partitionBy(ID, "teamid", "stint").orderBy("year"))
    return years.select(ID, "teamid", "year", n.alias("team_tenure_years"))


def career_teams(results: DataFrame) -> DataFrame:
    """Distinct teams up to the end of each year the entrant took part in."""
    first = scoring(results).groupBy(ID, "teamid").agg(F.min("year").alias("year"))
    new = first.groupBy(ID, "year").agg(F.count(F.lit(1)).alias("new_teams"))
    years = entrant_years(results).join(new, [ID, "year"], "left")
    upto = W.partitionBy(ID).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.coalesce("new_teams", F.lit(0))).over(upto)
    return years.select(ID, "year", total.alias("career_distinct_teams")).where("career_distinct_teams > 0")


def _hold(changes: DataFrame, results: DataFrame, cols: list[str]) -> DataFrame:
    """Spread a state that changes on some days over the later race dates."""
    days = small(numbered_days(results))
    refs = days.where("is_ref = 1").select(F.col("n").alias("i"), F.col("event_date").alias("dt_ref"))
    at = changes.join(days.select("event_date", F.col("n").alias("i0"), "n_all"), "event_date")
    until = F.coalesce(F.lead("i0").over(W.partitionBy(ID).orderBy("event_date")), "n_all")
    return spread(at.withColumn("i1", until), F.col("i0") + 1, F.col("i1"), refs).select("dt_ref", ID, *cols)


def career_teams_inseason(results: DataFrame) -> DataFrame:
    """Distinct teams before each race date."""
    first = scoring(results).groupBy(ID, "teamid").agg(F.min("event_date").alias("event_date"))
    per = first.groupBy(ID, "event_date").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy(ID).orderBy("event_date").rowsBetween(W.unboundedPreceding, 0)
    per = per.withColumn("career_distinct_teams", F.sum("n").over(upto)).drop("n")
    return _hold(per, results, ["career_distinct_teams"])


def _achievement_years(results: DataFrame) -> DataFrame:
    return scoring(results).groupBy(ID, "year", "event_date").agg(
        F.max(F.when(F.col("position") == 1, F.col("year"))).alias("last_win_year"),
        F.max(F.when(F.col("position") <= 3, F.col("year"))).alias("last_podium_year"))


def _so_far(per: DataFrame) -> DataFrame:
    upto = W.partitionBy(ID).orderBy("event_date").rowsBetween(W.unboundedPreceding, 0)
    return per.withColumns({c: F.max(c).over(upto) for c in ("last_win_year", "last_podium_year")})


def last_achievement(results: DataFrame) -> DataFrame:
    """Year of the last win and podium up to the end of each season."""
    years = entrant_years(results)
    per = _achievement_years(results).groupBy(ID, "year").agg(
        F.max("last_win_year").alias("last_win_year"),
        F.max("last_podium_year").alias("last_podium_year"), F.lit(1).alias("raced"))
    upto = W.partitionBy(ID).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    out = years.join(per, [ID, "year"], "left").select(
        ID, "year", *[F.max(c).over(upto).alias(c) for c in ("last_win_year", "last_podium_year", "raced")])
    return out.where("raced = 1").drop("raced")


def last_achievement_inseason(results: DataFrame) -> DataFrame:
    """Year of the last win and podium before each race date."""
    per = _so_far(_achievement_years(results)).drop("year")
    return _hold(per, results, ["last_win_year", "last_podium_year"])


def age(born: Column, at: Column) -> Column:
    return F.round(F.datediff(at, born) / F.lit(365.25), 1)


def latest_names(results: DataFrame, key: str = ID,
                 cols: tuple[str, ...] = ("full_name", "team_name")) -> DataFrame:
    """Newest attributes per key; ties go to the later round and higher mode."""
    order = [F.col(c).desc_nulls_last() for c in ("event_date", "round_number", "mode")]
    return latest(results.select(key, *cols, "event_date", "round_number", "mode"), [key], order).select(key, *cols)


def _totals_before(sessions: DataFrame, results: DataFrame, points: str, count: str) -> DataFrame:
    per = sessions.groupBy(ID, "event_date").agg(F.sum("points").alias(points), F.count(F.lit(1)).alias(count))
    upto = W.partitionBy(ID).orderBy("event_date").rowsBetween(W.unboundedPreceding, 0)
    return _hold(per.withColumns({c: F.sum(c).over(upto) for c in (points, count)}), results, [points, count])


def career_to_date(results: DataFrame) -> DataFrame:
    """Race and sprint points before each race date, for everyone seen so far."""
    return _totals_before(scoring(results), results, "career_points", "career_sessions")


def past_totals(results: DataFrame) -> DataFrame:
    """Points and sessions of any mode before each race date.

    Stands for joining each date with all earlier rows and adding them up.
    """
    return _totals_before(results, results, "points", "sessions")


def team_history(results: DataFrame) -> DataFrame:
    """Every team driven for up to each year: this year's, and earlier ones."""
    pairs = results.select(ID, "year", "teamid").distinct()
    years = entrant_years(results)
    earlier = years.join(pairs.withColumnRenamed("year", "past"), ID).where("past < year").drop("past")
    return pairs.unionByName(earlier).distinct()


def season_ages(results: DataFrame, births: DataFrame) -> DataFrame:
    """Age at the last session of each season, NULL without a birth date."""
    return last_session(results).join(births, ID, "left").select(
        ID, "year", age(F.col("date_of_birth"), F.col("dt_ref")).alias("driver_age"))
