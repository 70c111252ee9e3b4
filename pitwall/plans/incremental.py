"""Layers that grow by sessions, without going through history again.

``update`` takes the rows of new or replaced sessions and publishes a lake in which every
season from the earliest of them on is rebuilt and every earlier one is left as it is.
What a later season needs of earlier ones is stored:

* ``career``, for every season and entrant the sums over all seasons before it: the
  state of the unbounded window, one row instead of a history;
* ``results`` by season, of which the bounded windows read the seasons that their
  rounds before the first rebuilt season reach back to, and activity two more.

A session that comes out of order is one of an earlier season: the update starts there.
Departure labels look ahead to the seasons after, so both departure tables are rebuilt
from the stored layers; all others are rebuilt for the seasons from the first one on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pitwall.operators import standings as st
from pitwall.operators.features import ACTIVE_YEARS, ROUND, WINDOWS, career_sums, driver_window, join_windows
from pitwall.plans import base_tables as bt
from pitwall.plans.lake import small
from pitwall.plans.publish import Layers, current, new_run, publish, read, version_of, written
from pitwall.sources.sessions import write_layer

SESSION = ["year", "round_number", "mode"]
KEYS = ["dt_ref", "driverid"]


def _reach(spark: SparkSession, root: str, layers: Layers, first: int) -> int:
    """The first season whose results the seasons from ``first`` on still need."""
    longest = max(n for n in WINDOWS.values() if n)
    slots = read(spark, root, "results", layers, before=first).select(*ROUND).distinct()
    newest = slots.orderBy(F.desc("event_date"), F.desc("year"), F.desc("round_number")).limit(longest)
    years = newest.agg(F.min("year").alias("y")).first()[0]
    return min(first - ACTIVE_YEARS, years if years is not None else first)


def _careers(before: DataFrame | None, added: DataFrame, seasons: list[int]) -> DataFrame:
    """State at the start of each of ``seasons``: the one before the first of them and what the seasons since have added."""
    names = [c for c in added.columns if c not in ("driverid", "year")]
    every = added.select("driverid", "year", *names)
    if before is not None:
        every = every.unionByName(before.select("driverid", F.lit(seasons[0] - 1).alias("year"), *names))
    last = F.lit(seasons[-1])
    every = every.withColumn("season", F.explode(F.sequence(F.greatest(F.col("year") + 1, F.lit(seasons[0])), last)))
    return every.groupBy("driverid", "season").agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def update(spark: SparkSession, root: str, sessions: DataFrame, labels: dict[str, DataFrame], first_year: int = 2000,
           closed_before: int | None = None, label_year: int | None = None) -> dict[str, int]:
    """Publish the lake with these sessions' rows; the first season rebuilt, the first one read and the version.

    ``sessions`` holds whole sessions of the ``results`` table; one that is already there
    is replaced. Without a published version this builds everything.
    """
    start, old = version_of(spark, root), current(spark, root)
    run, folder = new_run(root)
    layers: Layers = {name: {"by": v["by"], "runs": dict(v["runs"])} for name, v in (old or {}).items()}
    ends = sessions.agg(F.min("year"), F.max("year")).first()
    if ends[0] is None:
        return {"first": 0, "read": 0, "version": start}
    first, known = int(ends[0]), [int(s) for s in layers.get("results", {}).get("runs", {})]
    last = max([int(ends[1]), *known])

    def put(name: str, df: DataFrame, by: str = "season") -> DataFrame:
        if by not in df.columns:
            df = df.withColumn(by, F.year("dt_ref"))
        write_layer(df, f"{folder}/{name}", (by,))
        kept = {s: r for s, r in layers.get(name, {}).get("runs", {}).items() if int(s) < first}
        layers[name] = {"by": by, "runs": kept | written(spark, root, run, name, by)}
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns)

    # results: the stored sessions of the rebuilt seasons, but those that come again, and the new ones
    fresh = sessions
    if known:
        stored = read(spark, root, "results", old, first=first).select(*sessions.columns)
        again = small(sessions.select(*SESSION).distinct())
        fresh = stored.join(again, SESSION, "left_anti").unionByName(sessions)
    fresh = put("results", fresh, "year")

    back = _reach(spark, root, old, first) if any(s < first for s in known) else first
    recent, career = fresh, None
    if back < first and any(s < first for s in known):
        recent = read(spark, root, "results", old, first=back, before=first).select(*fresh.columns).unionByName(fresh)
    if str(back) in layers.get("career", {}).get("runs", {}):
        career = read(spark, root, "career", old, first=back, before=back + 1).drop("season")
    since = f"{first}-01-01"

    added = career_sums(fresh)
    state = None
    if str(first) in layers.get("career", {}).get("runs", {}):
        state = read(spark, root, "career", old, first=first, before=first + 1).drop("season")
    # the state at the start of ``first`` itself is as it was; it is written again with its successors
    put("career", _careers(state, added, list(range(first, last + 2))))

    stores = [put(f"fs_driver_{k}", driver_window(recent, n, k, career=career, since=since)).drop("season") for k, n in WINDOWS.items()]
    features = put("fs_driver_all", join_windows(stores, KEYS)).drop("season")

    tables = {key: st.standings(st.running_points(fresh, key), key) for key in ("driverid", "teamid")}
    label_year, from_year = label_year or first_year, max(first_year, first)
    put("abt_champions", bt.champions(features, labels["champions"], first_year=label_year))
    put("abt_champions_inseason", bt.champions_inseason(features, fresh, tables["driverid"], labels["champions"], since=f"{from_year}-01-01"))
    put("abt_teams", bt.teams(features, fresh, labels["team_champions"], first_year=label_year))
    put("abt_teams_inseason", bt.teams_inseason(features, fresh, tables["teamid"], labels["team_champions"], first_year=from_year))

    # labels of earlier seasons depend on the new ones
    every = read(spark, root, "results", layers).select(*fresh.columns)
    whole = read(spark, root, "fs_driver_all", layers).drop("season").select(*features.columns)
    closed = closed_before or last
    for name in ("abt_departures", "abt_departures_inseason"):
        layers.pop(name, None)
    put("abt_departures", bt.departures(whole, every, labels["births"], as_of_year=closed, since=f"{first_year}-01-01"))
    put("abt_departures_inseason", bt.departures_inseason(whole, every, labels["births"], first_year=first_year))
    return {"first": first, "read": back, "version": publish(spark, root, layers, start)}
