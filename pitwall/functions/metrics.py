"""The 55 feature-store metrics, described once.

Each metric is a sum, a count of rows meeting a condition, or a mean. The
description is turned into per-round partial sums and back into the metric.
"""

from __future__ import annotations

from dataclasses import dataclass

HIGH = "1048576D"
LOW = "1073741824D"

RACE = ("Race",)
SPRINT = ("Sprint", "Sprint Race")
SCORING = RACE + SPRINT
QUALIFYING = ("Qualifying",)


@dataclass(frozen=True)
class Metric:
    name: str
    kind: str              # "count", "sum" or "mean"
    value: str | None = None
    where: str | None = None

    def expr(self) -> str:
        value = "1" if self.kind == "count" else self.value
        return f"CASE WHEN {self.where} THEN {value} END" if self.where else value

    def partials(self, doubles: set[str]) -> dict[str, str]:
        """Aggregates that add up over rows, all of them whole numbers.

        A double is split into two fixed-point halves (2^-20 and 2^-50), so that
        running sums can be subtracted later without rounding. A half of a row is
        under 2^30, so eight billion rows add up without overflow.
        """
        e = self.expr()
        if self.kind == "count":
            return {f"c_{self.name}": f"count({e})"}
        out = {}
        if self.value in doubles:
            e = f"nullif({e}, double('NaN'))"
            high = f"floor({e} * {HIGH})"
            out[f"h_{self.name}"] = f"sum({high})"
            out[f"l_{self.name}"] = f"sum(floor(({e} * {HIGH} - {high}) * {LOW}))"
        else:
            out[f"s_{self.name}"] = f"sum(bigint({e}))"
        if self.kind == "mean":
            out[f"c_{self.name}"] = f"count({e})"
        return out

    def total(self, get, doubles: set[str]) -> str:
        """The metric from its summed partials; ``get`` names a partial's sum."""
        if self.kind == "count":
            return get(f"c_{self.name}")
        if self.value in doubles:
            s = f"({get(f'h_{self.name}')} / {HIGH} + {get(f'l_{self.name}')} / {HIGH} / {LOW})"
        else:
            s = get(f"s_{self.name}")
        return f"(double({s}) / nullif({get(f'c_{self.name}')}, 0))" if self.kind == "mean" else s


def _modes(modes) -> str:
    return "mode IN (" + ", ".join(f"'{m}'" for m in modes) + ")"


def _scoped(base: str, kind: str, value: str | None, cond: str | None) -> list[Metric]:
    out = []
    for suffix, modes in (("", None), ("_race", RACE), ("_sprint", SPRINT)):
        parts = [p for p in (cond, _modes(modes) if modes else None) if p]
        out.append(Metric(base + suffix, kind, value, " AND ".join(parts) or None))
    return out


def _quali(cond: str | None = None) -> str:
    return _modes(QUALIFYING) + (f" AND {cond}" if cond else "")


# Metric names and the conditions they count.
COUNTED = {
    "qtd_wins": "position = 1",
    "qtd_podiums": "position <= 3",
    "qtd_top5": "position <= 5",
    "qtd_grid_top5": "grid_position <= 5",
    "qtd_poles": "grid_position = 1",
    "qtd_pole_win": "grid_position = 1 AND position = 1",
    "qtd_sessions_with_points": "points > 0",
    "qtd_sessions_with_overtake": "position < grid_position",
}
AVERAGED = {
    "avg_grid": "grid_position",
    "avg_position": "position",
    "avg_overtakes": "grid_position - position",
}
WEATHER = {
    "avg_air_temp": "air_temp",
    "avg_track_temp": "track_temp",
    "avg_humidity": "humidity",
    "avg_pressure": "pressure",
    "avg_wind_speed": "wind_speed",
}
SEASONS = "qtd_seasons"

METRICS: list[Metric] = [
    Metric("qtd_sessions", "count"),
    Metric("qtd_finished", "sum", "is_finished"),
    Metric("qtd_race", "count", None, _modes(RACE)),
    Metric("qtd_finished_race", "count", None, _modes(RACE) + " AND is_finished = 1"),
    Metric("qtd_sprint", "count", None, _modes(SPRINT)),
    Metric("qtd_finished_sprint", "count", None, _modes(SPRINT) + " AND is_finished = 1"),
    *[m for n, c in COUNTED.items() for m in _scoped(n, "count", None, c)],
    *_scoped("total_points", "sum", "points", None),
    *[m for n, v in AVERAGED.items() for m in _scoped(n, "mean", v, None)],
    Metric("qtd_quali", "count", None, _quali()),
    Metric("avg_quali_position", "mean", "position", _quali()),
    Metric("qtd_quali_pole", "count", None, _quali("position = 1")),
    Metric("qtd_quali_top3", "count", None, _quali("position <= 3")),
    Metric("qtd_quali_top10", "count", None, _quali("position <= 10")),
    *[Metric(n, "mean", v) for n, v in WEATHER.items()],
    Metric("qtd_sessions_rain", "sum", "rainfall"),
    Metric("pct_sessions_rain", "mean", "rainfall"),
]
NAMES = [SEASONS] + [m.name for m in METRICS]
SPRINT_METRICS = {m.name for m in METRICS if m.where and _modes(SPRINT) in m.where}

# Groups offered by the feature explorer.
GROUPS = {
    "Points": ["total_points", "total_points_race", "total_points_sprint"],
    "Wins": ["qtd_wins", "qtd_wins_race", "qtd_wins_sprint"],
    "Podiums": ["qtd_podiums", "qtd_podiums_race", "qtd_podiums_sprint"],
    "Top 5": ["qtd_top5", "qtd_top5_race", "qtd_top5_sprint"],
    "Poles": ["qtd_poles", "qtd_poles_race", "qtd_poles_sprint"],
    "Pole-to-Win": ["qtd_pole_win", "qtd_pole_win_race", "qtd_pole_win_sprint"],
    "Avg Grid Position": ["avg_grid", "avg_grid_race", "avg_grid_sprint"],
    "Avg Finish Position": ["avg_position", "avg_position_race", "avg_position_sprint"],
    "Avg Overtakes": ["avg_overtakes", "avg_overtakes_race", "avg_overtakes_sprint"],
    "Sessions": ["qtd_sessions", "qtd_finished", "qtd_race", "qtd_sprint",
                 "qtd_sessions_with_points", "qtd_sessions_with_overtake"],
    "Weather": [*WEATHER, "qtd_sessions_rain", "pct_sessions_rain"],
}
