"""Raw session rows to the typed, deduplicated results table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitwall.functions import scalars as fn
from pitwall.operators.ordering import latest

# Raw column -> results column.
TEXT = {
    "BroadcastName": "broadcast_name", "FullName": "full_name", "Abbreviation": "abbreviation",
    "DriverId": "driverid", "TeamName": "team_name", "TeamColor": "team_color", "TeamId": "teamid",
    "ClassifiedPosition": "classified_position", "Status": "status", "Mode": "mode",
    "OfficialEventName": "official_event_name", "EventName": "event_name",
    "Country": "country", "Location": "location",
}
WEATHER = {
    "AirTemp": "air_temp", "TrackTemp": "track_temp", "Humidity": "humidity",
    "Pressure": "pressure", "WindSpeed": "wind_speed", "WindDirection": "wind_direction",
}
KEY = ["driverid", "year", "round_number", "mode"]


def projection() -> dict[str, Column]:
    grid, place = fn.whole("GridPosition"), fn.whole("Position")
    return {
        "driver_number": F.col("DriverNumber").cast("int"),
        **{new: F.col(old).cast("string") for old, new in TEXT.items()},
        "grid_position": grid,
        "position": place,
        "points": fn.number_or_zero("Points"),
        "year": F.col("Year").cast("int"),
        "event_date": F.to_date("Date"),
        "round_number": F.col("RoundNumber").cast("int"),
        "is_finished": fn.finished("Status"),
        "overtakes": fn.gained(grid, place),
        **{new: fn.number(old) for old, new in WEATHER.items()},
        "rainfall": F.coalesce(fn.whole("Rainfall"), F.lit(0)),
    }


def newest(df: DataFrame, key: list[str] = KEY, at: str = "Date") -> DataFrame:
    """Newest row per key; each task drops older copies before the shuffle."""
    rest = [F.col(c).desc_nulls_last() for c in (at, "points", "position", "grid_position") if c in df.columns]
    return latest(df, key, rest)


def build_results(raw: DataFrame) -> DataFrame:
    rows = raw.where(fn.has_key("DriverId"))
    typed = rows.select("Date", *[c.alias(n) for n, c in projection().items()])
    return newest(typed).drop("Date")
