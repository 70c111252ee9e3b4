"""Labelled base tables: features, season context and target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitwall.functions.metrics import NAMES
from pitwall.operators import career, standings as st
from pitwall.operators.features import WINDOWS
from pitwall.operators.ordering import latest
from pitwall.plans.lake import small

# Fixed values: (feature, aggregates) rolled up from entrants to their team.
TEAM_ROLLUP = [
    ("qtd_sessions_life", "sessions_life", "sum avg"), ("qtd_wins_life", "wins_life", "sum avg"),
    ("qtd_podiums_life", "podiums_life", "sum avg"), ("total_points_life", "points_life", "sum avg"),
    ("avg_position_life", "position_life", "avg"), ("avg_grid_life", "grid_life", "avg"),
    ("qtd_sessions_last10", "sessions_last10", "sum"), ("qtd_wins_last10", "wins_last10", "sum"),
    ("qtd_podiums_last10", "podiums_last10", "sum"), ("total_points_last10", "points_last10", "sum"),
    ("avg_position_last10", "position_last10", "avg"), ("avg_grid_last10", "grid_last10", "avg"),
    ("qtd_sessions_last20", "sessions_last20", "sum"), ("qtd_wins_last20", "wins_last20", "sum"),
    ("qtd_podiums_last20", "podiums_last20", "sum"), ("total_points_last20", "points_last20", "sum"),
    ("avg_position_last20", "position_last20", "avg"), ("avg_grid_last20", "grid_last20", "avg"),
    ("qtd_wins_race_last20", "wins_race_last20", "sum"),
    ("qtd_podiums_race_last20", "podiums_race_last20", "sum"),
    ("total_points_race_last20", "points_race_last20", "sum"),
    ("avg_position_race_last20", "position_race_last20", "avg"),
]
# The same for qualifying.
QUALI_ROLLUP = [
    ("qtd_quali_life", "quali_life", "sum"), ("avg_quali_position_life", "quali_position_life", "avg"),
    ("qtd_quali_pole_life", "quali_pole_life", "sum"), ("qtd_quali_top3_life", "quali_top3_life", "sum"),
    ("qtd_quali_top10_life", "quali_top10_life", "sum"), ("qtd_quali_last10", "quali_last10", "sum"),
    ("avg_quali_position_last10", "quali_position_last10", "avg"),
    ("qtd_quali_pole_last10", "quali_pole_last10", "sum"), ("qtd_quali_last20", "quali_last20", "sum"),
    ("avg_quali_position_last20", "quali_position_last20", "avg"),
    ("qtd_quali_pole_last20", "quali_pole_last20", "sum"),
]
MISSING_PLACE = 99
METRIC_COLUMNS = {f"{n}_{k}" for n in NAMES for k in WINDOWS}


def rollup(spec) -> list[Column]:
    out = []
    for feature, name, kinds in spec:
        for kind in kinds.split():
            c = F.sum(feature) if kind == "sum" else F.avg(F.col(feature).cast("double"))
            out.append(c.alias(f"{kind}_{name}"))
    return out


def season_end(features: DataFrame, key: str = "driverid") -> DataFrame:
    """The last snapshot of each year; it excludes that date's own results."""
    f = features.withColumn("stats_year", F.year("dt_ref"))
    return latest(f, [key, "stats_year"], [F.col("dt_ref").desc_nulls_last()])


def with_next_label(snapshot: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    won = labels.select(key, (F.col("year") - 1).alias("stats_year"), F.lit(1).alias(name))
    return snapshot.join(small(won), [key, "stats_year"], "left").fillna(0, [name])


def champions(features: DataFrame, labels: DataFrame, first_year: int = 1999) -> DataFrame:
    s = season_end(features).where(F.col("stats_year") >= first_year)
    return with_next_label(s, labels, "driverid", "fl_champion").drop("stats_year")


def teams(features: DataFrame, results: DataFrame, labels: DataFrame,
          first_year: int = 1999) -> DataFrame:
    s = season_end(features).where(F.col("stats_year") >= first_year)
    roster = results.select("driverid", "teamid", "team_name", F.col("event_date").alias("dt_ref")).distinct()
    t = s.join(roster, ["driverid", "dt_ref"]).groupBy("dt_ref", "stats_year", "teamid", "team_name").agg(
        *rollup(TEAM_ROLLUP), F.count(F.lit(1)).alias("num_drivers"))
    return with_next_label(t, labels, "teamid", "fl_constructor_champion").drop("stats_year")


MOMENTUM = ["standings_momentum_3r", "standings_momentum_1r", "gap_momentum_3r",
            "points_last3", "points_prev3", "points_accel"]


def _same_year_label(df: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """1 on every date of the season for its eventual winner; unknown is 0."""
    won = small(labels.select("year", F.col(key).alias("__winner")))
    hit = F.when(F.col(key) == F.col("__winner"), 1).otherwise(0)
    return df.join(won, "year", "left").withColumn(name, hit).drop("__winner")


def champions_inseason(features: DataFrame, results: DataFrame, table: DataFrame,
                       labels: DataFrame, since: str = "2000-01-01",
                       clinch: DataFrame | None = None) -> DataFrame:
    """One row per active entrant and race date, present or not."""
    m = st.momentum(table, "driverid").drop("year", "cum_points")
    share = F.col("points_pct_of_leader")
    out = (
        features.where(F.col("dt_ref") >= F.lit(since).cast("date"))
        .join(small(st.race_calendar(results)), "dt_ref")
        .join(m, ["driverid", "dt_ref"], "left")
        .withColumn("season_fraction", st.season_fraction())
        .withColumns({f"pct_leader_x_{n}": F.coalesce(share * F.col(c), F.lit(0.0)) for n, c in {
            "wins": "qtd_wins_last10", "podiums": "qtd_podiums_last10", "points": "total_points_last10"}.items()})
        .fillna(MISSING_PLACE, ["standing_position"])
        .fillna(0, ["points_gap_to_leader", "points_pct_of_leader", *MOMENTUM])
    )
    out = _same_year_label(out, labels, "driverid", "fl_champion")
    if clinch is not None:
        out = out.join(small(clinch.drop("year")), "dt_ref", "left")
    return out.drop("year")


def teams_inseason(features: DataFrame, results: DataFrame, table: DataFrame,
                   labels: DataFrame, first_year: int = 2000) -> DataFrame:
    """One row per team and race date over the entrants present that day."""
    from pitwall.operators.features import scoring
    roster = scoring(results).select(
        "driverid", F.col("event_date").alias("dt_ref"), "teamid", "team_name").distinct()
    cal = st.race_calendar(results).withColumn("season_fraction", st.season_fraction())
    day = ["dt_ref", "year", "season_race_number", "season_total_races", "season_fraction"]
    t = (
        features.join(roster, ["driverid", "dt_ref"])
        .groupBy("dt_ref", "teamid", "team_name")
        .agg(*rollup(TEAM_ROLLUP + QUALI_ROLLUP), F.countDistinct("driverid").alias("num_drivers"))
        .join(small(cal.where(F.col("year") >= first_year)), "dt_ref")
    )
    m = st.momentum(table, "teamid").drop("year", "cum_points")
    m = m.select("teamid", "dt_ref", *[F.col(c).alias(f"team_{c}") for c in m.columns if c not in ("teamid", "dt_ref")])
    share = F.col("team_points_pct_of_leader")
    out = (
        t.join(m, ["teamid", "dt_ref"], "left")
        .fillna(0, [f"team_{c}" for c in MOMENTUM])
        .withColumns({f"team_pct_leader_x_{n}": F.coalesce(share * F.col(f"sum_{n}_last10"), F.lit(0.0))
                      for n in ("wins", "podiums", "points")})
    )
    return _same_year_label(out, labels, "teamid", "fl_constructor_champion")


def _rate(part: Column, suffix: str) -> Column:
    n = F.col(f"qtd_sessions_{suffix}")
    return F.when(n > 0, part.cast("double") / n).otherwise(0.0)


def trends() -> dict[str, Column]:
    """Last ten rounds against the career."""
    out = {f"trend_avg_{c}": F.col(f"avg_{c}_last10") - F.col(f"avg_{c}_life")
           for c in ("position", "grid", "overtakes")}
    parts = {
        "win": lambda s: F.col(f"qtd_wins_{s}"),
        "podium": lambda s: F.col(f"qtd_podiums_{s}"),
        "dnf": lambda s: F.col(f"qtd_sessions_{s}") - F.col(f"qtd_finished_{s}"),
    }
    for name, part in parts.items():
        out[f"trend_{name}_rate"] = _rate(part("last10"), "last10") - _rate(part("life"), "life")
    return out


# The few features the profile is computed from. Only these go through its joins.
_USED = [f"{c}_{k}" for c in ("avg_position", "avg_grid", "avg_overtakes", "qtd_sessions", "qtd_wins",
                              "qtd_podiums", "qtd_finished") for k in ("last10", "life")] + ["qtd_seasons_life"]


DEPARTURES = ("abt_departures", "abt_departures_inseason")


def metrics_used(table: str, columns: tuple[str, ...]) -> list[str]:
    """The metrics that these columns of a base table are, or that the table works others out from."""
    if table in DEPARTURES:
        used = _USED
    elif table in ("abt_teams", "abt_teams_inseason"):
        used = [feature for feature, _, _ in TEAM_ROLLUP + QUALI_ROLLUP]
    else:
        used = ["qtd_wins_last10", "qtd_podiums_last10", "total_points_last10"] if table == "abt_champions_inseason" else []
    return [c for c in dict.fromkeys([*used, *columns]) if c in METRIC_COLUMNS]


def _profile(df: DataFrame, features: DataFrame) -> DataFrame:
    """Defaults and derived columns of both departure tables, beside all features."""
    never = F.col("qtd_seasons_life") + 1
    out = df.withColumns({
        **trends(),
        "driver_age": career.age(F.col("date_of_birth"), F.col("dt_ref")),
        "seasons_since_last_win": F.coalesce(F.col("year") - F.col("last_win_year"), never),
        "seasons_since_last_podium": F.coalesce(F.col("year") - F.col("last_podium_year"), never),
        "team_points_share": F.coalesce("team_points_share", F.lit(0.5)),
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("teammate_position_gap", "teammate_grid_gap", "season_dnf_rate")},
        "season_points_current": F.coalesce("season_points_current", F.lit(0)),
        **{c: F.coalesce(c, F.lit(1)) for c in ("team_tenure_years", "career_distinct_teams")},
    }).drop("date_of_birth", "last_win_year", "last_podium_year", "teamid", "year", *_USED)
    return features.join(out, ["dt_ref", "driverid"])


def departures(features: DataFrame, results: DataFrame, births: DataFrame, as_of_year: int,
               since: str = "2000-01-01", on_transfer: str = "fanout") -> DataFrame:
    """Closed seasons: one snapshot per entrant at its last session of the year."""
    features = features.where(F.col("dt_ref") >= F.lit(since).cast("date"))
    end = career.last_session(results).where(F.col("year") < as_of_year)
    key = ["driverid", "year"]
    team = career.season_team(results).join(career.tenure(results), ["driverid", "teamid", "year"], "left")
    return _profile(
        features.select("dt_ref", "driverid", *_USED)
        .join(end, ["driverid", "dt_ref"])
        .join(career.departure_label(results), key)
        .join(career.teammate_gap(results, on_transfer), key, "left")
        .join(team, key, "left")
        .join(births, "driverid", "left")
        .join(career.career_teams(results), key, "left")
        .join(career.last_achievement(results), key, "left"), features)


def departures_inseason(features: DataFrame, results: DataFrame, births: DataFrame,
                        first_year: int = 2000) -> DataFrame:
    """Every active entrant at every race date; the open season has no label."""
    cal = st.race_calendar(results).where(F.col("year") >= first_year)
    cal = small(cal.withColumn("season_fraction", st.season_fraction()))
    key = ["dt_ref", "driverid"]
    team = (career.current_team(results).join(cal.select("dt_ref", "year"), "dt_ref")
            .join(career.tenure(results), ["driverid", "teamid", "year"], "left").drop("year"))
    return _profile(
        features.select(*key, *_USED).join(cal, "dt_ref")
        .join(career.departure_label(results, open_season=True), ["driverid", "year"], "left")
        .join(career.teammate_gap_inseason(results), key, "left")
        .join(team, key, "left")
        .join(births, "driverid", "left")
        .join(career.career_teams_inseason(results), key, "left")
        .join(career.last_achievement_inseason(results), key, "left"), features)
