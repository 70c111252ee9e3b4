"""Season calendar, standings, momentum and championship arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.operators.features import scoring, spread
from pitwall.operators.ordering import rank, top_k
from pitwall.plans.lake import small

EVENT = ["year", "dt_ref"]


def prior(n: int):
    """Rows before the current one."""
    return W.unboundedPreceding, -n


def race_calendar(results: DataFrame) -> DataFrame:
    """Number of each race date in its season, and the season's total."""
    dates = scoring(results).select("year", F.col("event_date").alias("dt_ref")).distinct()
    season = W.partitionBy("year")
    return dates.select(
        "year", "dt_ref",
        F.row_number().over(season.orderBy("dt_ref")).alias("season_race_number"),
        F.count(F.lit(1)).over(season).cast("int").alias("season_total_races"))


def season_fraction() -> Column:
    return F.round(F.col("season_race_number") / F.col("season_total_races").cast("double"), 3)


def event_points(results: DataFrame, key: str) -> DataFrame:
    return scoring(results).groupBy("year", F.col("event_date").alias("dt_ref"), key).agg(
        F.sum("points").alias("points"))


def running_points(results: DataFrame, key: str) -> DataFrame:
    """Season points of each entrant up to and including each of its events."""
    w = W.partitionBy("year", key).orderBy("dt_ref").rowsBetween(W.unboundedPreceding, 0)
    return event_points(results, key).withColumn("cum_points", F.sum("points").over(w))


def standings(running: DataFrame, key: str, as_of: str = "after",
              limit: int | None = None) -> DataFrame:
    """Position, gap to and share of the leader among the entrants present.

    ``as_of="before"`` leaves out the points of the event itself.
    """
    pts = running
    if as_of == "before":
        pts = pts.withColumn("cum_points", F.col("cum_points") - F.col("points"))
    pts = pts.select(*EVENT, key, "cum_points")
    lead = small(pts.groupBy(*EVENT).agg(F.max("cum_points").alias("__lead")))
    out = rank(pts, EVENT, "cum_points", "standing_position", limit=limit).join(lead, EVENT)
    share = F.col("cum_points").cast("double") / F.nullif(F.col("__lead"), F.lit(0))
    return out.select(
        *EVENT, key, "cum_points", "standing_position",
        (F.col("__lead") - F.col("cum_points")).alias("points_gap_to_leader"),
        F.round(share, 4).alias("points_pct_of_leader"))


def carried_standings(running: DataFrame, key: str, calendar: DataFrame,
                      limit: int | None = None) -> DataFrame:
    """Standings over everyone who has scored a start this season.

    An entrant missing an event keeps the points of its last one.
    """
    season = W.partitionBy("year")
    days = small(calendar.select("year", "dt_ref").distinct().select(
        "year", "dt_ref", F.row_number().over(season.orderBy("dt_ref")).alias("i"), F.count(F.lit(1)).over(season).cast("int").alias("n")))
    own = W.partitionBy("year", key).orderBy("i")
    spans = running.join(days, EVENT).select(
        "year", key, "cum_points", "i", F.coalesce(F.lead("i").over(own) - 1, "n").alias("upto"))
    refs = days.select("year", "i", "dt_ref")
    held = spread(spans.withColumnRenamed("i", "since"), F.col("since"), F.col("upto"), refs, ["year"]).select(
        "year", "dt_ref", key, "cum_points", F.lit(0).alias("points"))
    return standings(held, key, limit=limit)


def momentum(table: DataFrame, key: str) -> DataFrame:
    """Change in place, gap and points over the entrant's last events."""
    w = W.partitionBy("year", key).orderBy("dt_ref")

    def back(col, n):
        return F.lag(col, n).over(w)

    return table.withColumns({
        "standings_momentum_3r": back("standing_position", 3) - F.col("standing_position"),
        "standings_momentum_1r": back("standing_position", 1) - F.col("standing_position"),
        "gap_momentum_3r": back("points_gap_to_leader", 3) - F.col("points_gap_to_leader"),
        "points_last3": F.col("cum_points") - back("cum_points", 3),
        "points_prev3": back("cum_points", 3) - back("cum_points", 6),
    }).withColumn("points_accel", F.col("points_last3") - F.col("points_prev3"))


def leader_gap(running: DataFrame, key: str) -> DataFrame:
    """Leader of each event and its lead over the second place, NULL if alone."""
    two = top_k(running, EVENT, [F.col("cum_points").desc_nulls_last(), F.col(key)], 2, "place")
    first, second = F.when(F.col("place") == 1, F.col("cum_points")), F.when(F.col("place") == 2, F.col("cum_points"))
    return two.groupBy(*EVENT).agg(
        (F.max(first) - F.max(second)).alias("leader_gap"),
        F.max(F.when(F.col("place") == 1, F.col(key))).alias("leader"))


def remaining_points(results: DataFrame, key: str) -> DataFrame:
    """Best possible points still to come in the season after each event.

    An entrant's best score counts per session, a team's per event.
    """
    if key == "driverid":
        per = scoring(results).select("year", F.col("event_date").alias("dt_ref"), "points")
    else:
        per = event_points(results, key)
    best = per.groupBy(*EVENT).agg(F.max("points").alias("max_points"))
    later = W.partitionBy("year").orderBy("dt_ref").rowsBetween(1, W.unboundedFollowing)
    total = F.coalesce(F.sum("max_points").over(later), F.lit(0))
    return best.select(*EVENT, total.alias("max_remaining_points"))


def clinch(leaders: DataFrame, remaining: DataFrame) -> DataFrame:
    """Decided once the lead exceeds what is still to be won."""
    return leaders.join(remaining, EVENT).withColumn(
        "is_clinched", F.coalesce((F.col("leader_gap") > F.col("max_remaining_points")).cast("int"), F.lit(0)))
