"""Column expressions for casts, flags, texts and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Colours of known teams, used when the data has none.
TEAM_COLORS = {
    "Red Bull Racing": "#3671C6",
    "Mercedes": "#27F4D2",
    "Ferrari": "#E8002D",
    "McLaren": "#FF8000",
    "Aston Martin": "#229971",
    "Alpine": "#FF87BC",
    "Williams": "#64C4FF",
    "RB": "#6692FF",
    "Kick Sauber": "#52E252",
    "Haas F1 Team": "#B6BABD",
}
NO_COLOR = "#999999"
FILL = -10000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole(c, text: bool = False) -> Column:
    """Number to int, NULL where it is none. Halves go to even, in text away from 0."""
    number = _col(c).try_cast("double")
    return (F.round(number) if text else F.rint(number)).try_cast("int")


def number(c) -> Column:
    return _col(c).try_cast("double")


def number_or_zero(c) -> Column:
    return F.coalesce(number(c), F.lit(0.0))


def finished(status) -> Column:
    """Finished, or classified some laps behind ("+n ...")."""
    s = _col(status)
    return F.when((s == "Finished") | s.startswith("+"), 1).otherwise(0)


def gained(grid: Column, place: Column) -> Column:
    return F.coalesce(grid - place, F.lit(0))


def has_key(c) -> Column:
    return _col(c).isNotNull() & (_col(c).cast("string") != "nan")


def ratio(a, b) -> Column:
    """NULL instead of a division by zero."""
    return _col(a).cast("double") / F.nullif(_col(b), F.lit(0))


def _clock(ns: Column, *units: tuple[str, int]) -> Column:
    """Nanoseconds as counts of ``units`` (format, thousandths of a second), largest first, in whole numbers."""
    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b))

    rest = div(ns + 500_000, 1_000_000)
    fields, form = [], ""
    for mark, size in units:
        fields.append(div(rest, size))
        form += mark
        rest = rest % size
    return F.format_string(form + "%03d", *fields, rest)


def _if_timed(ns: Column, text: Column) -> Column:
    return F.coalesce(F.when(ns != 0, text), F.lit(""))


def lap_time(ns) -> Column:
    """m:ss.SSS, or s.SSS under a minute; empty for NULL and 0. Rounded to the thousandth first."""
    ns = _col(ns).cast("bigint")
    long = _clock(ns, ("%d:", 60_000), ("%02d.", 1000))
    return _if_timed(ns, F.when(ns >= 59_999_500_000, long).otherwise(_clock(ns, ("%d.", 1000))))


def race_time(ns, is_winner: Column) -> Column:
    """h:mm:ss.SSS for the winner, +s.SSSs behind it for the others."""
    ns = _col(ns).cast("bigint")
    total = _clock(ns, ("%d:", 3_600_000), ("%02d:", 60_000), ("%02d.", 1000))
    behind = F.concat(F.lit("+"), _clock(ns, ("%d.", 1000)), F.lit("s"))
    return _if_timed(ns, F.when(is_winner, total).otherwise(behind))


def signed(delta) -> Column:
    """+n for a gain, the plain number otherwise, empty for NULL."""
    text = _col(delta).cast("int").cast("string")
    return F.coalesce(F.when(_col(delta) > 0, F.concat(F.lit("+"), text)).otherwise(text), F.lit(""))


def _stated(c) -> Column:
    """The text, NULL where it is missing or the word for missing."""
    return F.nullif(_col(c), F.lit("nan"))


def hex_color(c) -> Column:
    """Lower-case colour with one leading mark, grey if none is stated."""
    digits = F.regexp_replace(F.lower(F.trim(_stated(c))), "^#", "")
    return F.coalesce(F.concat(F.lit("#"), digits), F.lit(NO_COLOR))


def team_color(team, color) -> Column:
    """The stated colour, else the known one of the team, else grey."""
    fallback = F.lit(NO_COLOR)
    for name, known in TEAM_COLORS.items():
        fallback = F.when(_col(team) == name, known).otherwise(fallback)
    own = F.nullif(_stated(color), F.lit(""))
    return F.when(own.isNull(), fallback).otherwise(hex_color(own))


def risk_tier(p) -> Column:
    p = _col(p)
    return F.when(p <= 0.25, "Low").when(p <= 0.60, "Medium").when(p <= 1.01, "High")


def risk_label(tier, p) -> Column:
    mark = F.when(_col(tier) == "High", "🔴").when(_col(tier) == "Medium", "🟡").otherwise("🟢")
    return F.format_string("%s %s (%.1f%%)", mark, _col(tier), _col(p) * 100)


def predicted(p, threshold: float = 0.5) -> Column:
    return (_col(p) >= threshold).cast("int")


def event_label(round_number, name, date) -> Column:
    return F.format_string("R%02d — %s (%s)", _col(round_number), _col(name),
                           F.date_format(_col(date), "yyyy-MM-dd"))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def year_list(text) -> Column:
    """ "[2024, 2025]" or "2024" to an array of years."""
    t = F.trim(_col(text))
    return F.when(t.startswith("["), F.from_json(t, "array<int>")).otherwise(F.array(t.try_cast("int")))
