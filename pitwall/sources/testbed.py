"""The results model derived from the driver tables.

Entrant = supplier, team = its nation, season and round = ship year and month,
session mode = return flag. The race falls a day after the other sessions, so a
round spans two dates. Customers ordering under changing priorities stand in
for entrants who change team.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitwall.operators.ordering import row_number
from pitwall.operators.features import calendar_slots, feature_store, WINDOWS
from pitwall.operators import career, standings
from pitwall.plans import base_tables
from pitwall.plans.lake import Lake

FIRST_WEATHER_YEAR = 1996
CLOSED_BEFORE = 2001


def _int(c) -> Column:
    return c.cast("bigint")


def _tag(columns: tuple[str, ...]) -> str:
    """A short name for a set of columns."""
    return hashlib.md5(" ".join(sorted(columns)).encode()).hexdigest()[:12]


class Testbed:
    """All layers of one set of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.lake = Lake.open(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- bronze ---------------------------------------------------------
    def _session_totals(self) -> DataFrame:
        flag = F.col("l_returnflag")
        ship = F.col("l_shipdate")
        mode = F.when(flag == "A", "Race").when(flag == "N", "Sprint").otherwise("Qualifying")
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("driverid"),
                F.year(ship).alias("year"),
                F.month(ship).alias("round_number"),
                mode.alias("mode"),
            )
            .agg(
                F.sum(_int(F.round(F.col("l_extendedprice") * 100))).alias("points"),
                F.sum(_int(F.col("l_quantity"))).alias("qty"),
                F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("is_finished"),
                F.count(F.lit(1)).alias("n"),
                F.sum(_int(F.col("l_linenumber"))).alias("ln"),
                F.sum(_int(F.round(F.col("l_discount") * 100))).alias("disc"),
                F.sum(_int(F.round(F.col("l_tax") * 100))).alias("tax"),
            )
        )

    def _results(self) -> DataFrame:
        event = ["year", "round_number", "mode"]
        totals = self.lake.layer("session_totals", self._session_totals)
        ranked = row_number(totals, event, [-F.col("points"), F.col("driverid")], "position")
        ranked = row_number(ranked, event, [-F.col("qty"), F.col("driverid")], "grid_position")

        s = totals.groupBy(*event).agg(*[F.sum(c).alias(c) for c in ("n", "qty", "ln", "disc", "tax", "points")])
        known = F.col("year") >= FIRST_WEATHER_YEAR
        n = F.col("n").cast("double")
        weather = s.select(
            *event,
            *[F.when(known, F.round(e * 8) / 8).alias(name) for name, e in {
                "air_temp": F.col("qty") / n,
                "track_temp": (F.col("qty") + F.col("ln")) / n,
                "humidity": F.col("disc") * 10 / n,
                "pressure": F.col("tax") / n + 990,
                "wind_speed": F.col("ln") / n,
                "wind_direction": (F.col("points") % 360).cast("double"),
            }.items()],
            F.when(known & (F.col("qty") % 3 == 0), 1).otherwise(0).alias("rainfall"),
        )
        people = self.table("supplier").select(
            F.col("s_suppkey").alias("driverid"), F.col("s_name").alias("full_name"),
            F.col("s_nationkey").alias("teamid"))
        teams = self.table("nation").select(
            F.col("n_nationkey").alias("teamid"), F.col("n_name").alias("team_name"),
            F.lower(F.lpad(F.hex(F.col("n_nationkey") * 655360 + 255), 6, "0")).alias("team_color"))
        first_day = F.make_date("year", "round_number", F.lit(1))
        return (
            ranked.join(weather, event)
            .join(people, "driverid").join(teams, "teamid")
            .select(
                "driverid", "full_name", "teamid", "team_name", "team_color",
                "year", "round_number", "mode",
                F.date_add(first_day, F.when(F.col("mode") == "Race", 1).otherwise(0)).alias("event_date"),
                F.format_string("Round %d-%02d", "year", "round_number").alias("event_name"),
                F.format_string("Country %d", F.col("round_number") % 5).alias("country"),
                F.format_string("Circuit %d", "round_number").alias("location"),
                "points", "qty", "position", "grid_position", "is_finished",
                F.when(F.col("is_finished") == 1, "Finished").otherwise("Retired").alias("status"),
                (F.col("grid_position") - F.col("position")).alias("overtakes"),
                "air_temp", "track_temp", "humidity", "pressure", "wind_speed",
                "wind_direction", "rainfall",
            )
        )

    def by_season(self, name: str, *columns: str) -> DataFrame:
        """A dated layer, or some of its columns, stored by season, with the column its folders are named by."""
        stored = f"{name}_by_season" + (f"_{_tag(columns)}" if columns else "")
        return self.lake.layer(stored, lambda: (self._narrow(name, columns) if columns else getattr(self, name)).withColumn(
            "season", F.year("dt_ref")), ("season",))

    def only(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a layer. Without the whole layer at hand, these are worked out and stored alone."""
        if self.lake.has(name):
            return getattr(self, name).select(*columns)
        return self.lake.layer(f"{name}_{_tag(columns)}", lambda: self._narrow(name, columns))

    def _narrow(self, name: str, columns: tuple[str, ...]) -> DataFrame:
        """Columns of a layer from the metrics that they need and no others."""
        if self.lake.has(name):
            return getattr(self, name).select(*columns)
        if name == "features":
            return feature_store(self.results, WINDOWS, columns=list(columns)).select(*columns)
        used = base_tables.metrics_used(name, columns)
        # the departure tables read their features twice
        features = (self.only("features", "dt_ref", "driverid", *used) if name in base_tables.DEPARTURES
                    else feature_store(self.results, WINDOWS, columns=used))
        return self._base(name, features).select(*columns)

    def _base(self, name: str, features: DataFrame) -> DataFrame:
        """A base table from features, all of them or those that the columns asked for need."""
        results = self.results
        if name == "abt_champions":
            return base_tables.champions(features, self.champions, first_year=1995)
        if name == "abt_teams":
            return base_tables.teams(features, results, self.team_champions, first_year=1995)
        if name == "abt_champions_inseason":
            return base_tables.champions_inseason(features, results, self.driver_standings, self.champions, since="1996-01-01")
        if name == "abt_teams_inseason":
            return base_tables.teams_inseason(features, results, self.team_standings, self.team_champions, first_year=1996)
        if name == "abt_departures":
            return base_tables.departures(features, results, self.births, as_of_year=CLOSED_BEFORE, since="1996-01-01")
        return base_tables.departures_inseason(features, results, self.births, first_year=1996)

    @property
    def results(self) -> DataFrame:
        return self.lake.layer("results", self._results)

    @property
    def transfers(self) -> DataFrame:
        """Results whose entrants change team between and within seasons."""
        def build():
            day = F.to_date("o_orderdate")
            per = self.table("orders").groupBy(
                F.col("o_custkey").alias("driverid"),
                F.col("o_orderpriority").alias("teamid"),
                F.year(day).alias("year"), day.alias("event_date"),
            ).agg(
                F.sum(_int(F.round(F.col("o_totalprice") * 100))).alias("points"),
                F.min("o_orderkey").alias("first_order"),
                F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("is_finished"),
            )
            per = self.lake.layer("transfer_totals", lambda: per)
            day_key = ["year", "event_date"]
            per = row_number(per, day_key, [-F.col("points"), F.col("first_order")], "position")
            per = row_number(per, day_key, [F.col("first_order")], "grid_position")
            return per.drop("first_order").withColumns({
                "mode": F.lit("Race"), "round_number": F.dayofyear("event_date")})
        return self.lake.layer("transfers", build)

    @property
    def raw(self) -> DataFrame:
        """Raw session rows: unclean ids, odd positions, some sessions collected twice."""
        def build():
            r = self.results
            place, key = F.col("position").cast("bigint"), F.col("driverid")

            def ns(start, gap, upto):
                return F.when((F.col("mode") == "Qualifying") & (place <= upto),
                              F.lit(start) + place * gap).cast("bigint")
            first = r.select(
                key.cast("string").alias("DriverNumber"), F.concat(F.lit("B "), "full_name").alias("BroadcastName"),
                F.col("full_name").alias("FullName"), F.upper(F.substring("full_name", 1, 3)).alias("Abbreviation"),
                F.when(key % 29 == 7, F.lit(None)).when(key % 23 == 5, "nan")
                .otherwise(F.concat(F.lit("d"), key)).alias("DriverId"),
                F.col("team_name").alias("TeamName"),
                F.when(F.col("teamid") % 5 == 0, "nan").otherwise(F.upper("team_color")).alias("TeamColor"),
                F.concat(F.lit("t"), "teamid").alias("TeamId"),
                F.col("position").cast("string").alias("ClassifiedPosition"),
                F.when(F.col("is_finished") == 1, "Finished").when(key % 3 == 0, "+1 Lap").otherwise("Retired").alias("Status"),
                F.when(key % 11 != 0, F.col("grid_position") + (key % 2) * 0.5).alias("GridPosition"),
                F.when(key % 13 != 0, place.cast("double")).alias("Position"),
                F.when(key % 17 != 0, F.col("points").cast("double")).alias("Points"),
                F.when(F.col("mode") == "Race", F.when(place == 1, F.lit(5_400_250_000_000))
                       .otherwise(place * 1_370_000_000)).cast("bigint").alias("Time"),
                ns(80_000_000_000, 137_000_000, 10_000_000).alias("Q1"),
                ns(79_000_000_000, 130_000_000, 15).alias("Q2"),
                ns(58_500_000_000, 120_000_000, 10).alias("Q3"),
                F.col("year").alias("Year"), F.col("event_date").cast("timestamp").alias("Date"),
                F.col("mode").alias("Mode"), F.col("round_number").alias("RoundNumber"),
                F.concat(F.lit("Grand "), "event_name").alias("OfficialEventName"),
                F.col("event_name").alias("EventName"), F.col("country").alias("Country"),
                F.col("location").alias("Location"),
                F.col("air_temp").alias("AirTemp"), F.col("track_temp").alias("TrackTemp"),
                F.col("humidity").alias("Humidity"), F.col("pressure").alias("Pressure"),
                F.col("wind_speed").alias("WindSpeed"), F.col("wind_direction").alias("WindDirection"),
                F.when(F.col("year") >= FIRST_WEATHER_YEAR, F.col("rainfall")).alias("Rainfall"))
            again = first.where("RoundNumber = 6").withColumns({
                "Date": F.expr("Date + INTERVAL 12 HOURS"), "Position": F.col("Position") + 1})
            return first.unionByName(again)
        return self.lake.layer("raw", build)

    # -- labels -----------------------------------------------------------
    def _season_best(self, key: str) -> DataFrame:
        totals = self.results.groupBy("year", key).agg(F.sum("points").alias("points"))
        best = totals.groupBy("year").agg(
            F.max(F.struct("points", (-F.col(key)).alias("k"))).alias("b"))
        last = best.agg(F.max("year")).first()[0]
        return best.where(F.col("year") < last).select(
            F.col("year").cast("int"), (-F.col("b.k")).alias(key))

    @property
    def champions(self) -> DataFrame:
        return self.lake.layer("champions", lambda: self._season_best("driverid"))

    @property
    def team_champions(self) -> DataFrame:
        return self.lake.layer("team_champions", lambda: self._season_best("teamid"))

    @property
    def births(self) -> DataFrame:
        key = F.col("s_suppkey")
        born = F.date_add(F.lit("1960-01-01").cast("date"), (key % 9000).cast("int"))
        return self.table("supplier").select(
            key.alias("driverid"), F.when(key % 17 != 0, born).alias("date_of_birth"))

    # -- silver and gold ------------------------------------------------
    @property
    def features(self) -> DataFrame:
        return self.lake.layer("features", lambda: feature_store(self.results, WINDOWS))

    @property
    def driver_running(self) -> DataFrame:
        return self.lake.layer(
            "driver_running", lambda: standings.running_points(self.results, "driverid"))

    @property
    def team_running(self) -> DataFrame:
        return self.lake.layer(
            "team_running", lambda: standings.running_points(self.results, "teamid"))

    @property
    def driver_standings(self) -> DataFrame:
        return self.lake.layer(
            "driver_standings", lambda: standings.standings(self.driver_running, "driverid"))

    @property
    def team_standings(self) -> DataFrame:
        return self.lake.layer(
            "team_standings", lambda: standings.standings(self.team_running, "teamid"))

    @property
    def abt_champions(self) -> DataFrame:
        return self.lake.layer("abt_champions", lambda: self._base("abt_champions", self.features))

    @property
    def abt_teams(self) -> DataFrame:
        return self.lake.layer("abt_teams", lambda: self._base("abt_teams", self.features))

    @property
    def abt_champions_inseason(self) -> DataFrame:
        return self.lake.layer("abt_champions_inseason", lambda: self._base("abt_champions_inseason", self.features))

    @property
    def abt_teams_inseason(self) -> DataFrame:
        return self.lake.layer("abt_teams_inseason", lambda: self._base("abt_teams_inseason", self.features))

    @property
    def abt_departures(self) -> DataFrame:
        return self.lake.layer("abt_departures", lambda: self._base("abt_departures", self.features))

    @property
    def abt_departures_inseason(self) -> DataFrame:
        return self.lake.layer("abt_departures_inseason", lambda: self._base("abt_departures_inseason", self.features))
