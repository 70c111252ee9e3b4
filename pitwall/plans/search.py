"""Search over settings: model-based draws, folds side by side, trials that cannot win stopped.

A study holds every trial with its scores fold by fold. Trials are drawn in batches;
within a batch they run side by side, and so do the folds of a trial. A trial is hopeless
when, after at least ``warmup`` of its folds in order, its mean score lies below the
median of what the finished trials of earlier batches had after as many folds. Its jobs
carry a tag of their own: those still running are cancelled, later folds never start.
Only earlier batches are asked, so the same seed gives the same study however the
cluster times its jobs.

Settings are drawn from Parzen estimates: the best trials and the others each make a
density per setting, and of several draws from the good one that with the largest ratio
of the two is tried. The first draws are uniform, and so are all with
``sampler="uniform"``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from statistics import mean, median

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

Space = dict[str, tuple]


# -- settings ---------------------------------------------------------------
def uniform(kind: tuple, rnd: random.Random):
    """One value of a range; see ``training.CANDIDATES`` for the kinds."""
    name, *a = kind
    if name == "int":
        return rnd.randrange(a[0], a[1] + 1, a[2])
    if name == "float":
        return rnd.uniform(*a)
    if name == "share":
        return f"{rnd.uniform(*a):.4f}"
    if name == "log":
        return math.exp(rnd.uniform(math.log(a[0]), math.log(a[1])))
    return rnd.choice(a[0])


def _on_line(kind: tuple, value) -> float:
    """A numeric value's place on the line its density is estimated on."""
    return math.log(value) if kind[0] == "log" else float(value)


def _from_line(kind: tuple, x: float):
    name, low, high = kind[:3]
    if name == "log":
        return min(max(math.exp(x), low), high)
    x = min(max(x, low), high)
    if name == "int":
        return low + kind[3] * round((x - low) / kind[3])
    return f"{x:.4f}" if name == "share" else x


class Parzen:
    """Density of one setting: equal kernels on the values seen and one as wide as the range."""

    def __init__(self, kind: tuple, values: list):
        self.kind = kind
        if kind[0] == "pick":
            counts = [1.0 + sum(v == c for v in values) for c in kind[1]]
            self.weights = [n / sum(counts) for n in counts]
            return
        self.low, self.high = (_on_line(kind, kind[1]), _on_line(kind, kind[2]))
        width = self.high - self.low
        points = sorted(_on_line(kind, v) for v in values)
        self.kernels = [((self.low + self.high) / 2, width)]
        for i, x in enumerate(points):
            left = points[i - 1] if i else self.low
            right = points[i + 1] if i + 1 < len(points) else self.high
            self.kernels.append((x, min(width, max(x - left, right - x, width / (1 + len(points))))))

    def draw(self, rnd: random.Random):
        if self.kind[0] == "pick":
            return rnd.choices(self.kind[1], self.weights)[0]
        centre, spread = rnd.choice(self.kernels)
        while True:
            x = rnd.gauss(centre, spread)
            if self.low <= x <= self.high:
                return _from_line(self.kind, x)

    def log_density(self, value) -> float:
        if self.kind[0] == "pick":
            return math.log(self.weights[self.kind[1].index(value)])
        x, total = _on_line(self.kind, value), 0.0
        for centre, spread in self.kernels:
            inside = (math.erf((self.high - centre) / spread / math.sqrt(2)) - math.erf((self.low - centre) / spread / math.sqrt(2))) / 2
            total += math.exp(-((x - centre) / spread) ** 2 / 2) / (math.sqrt(2 * math.pi) * spread * inside)
        return math.log(total / len(self.kernels))


# -- study --------------------------------------------------------------------
@dataclass
class Trial:
    number: int
    params: dict
    scores: list[float] = field(default_factory=list)
    state: str = "running"  # finished, stopped or refused

    @property
    def score(self) -> float:
        return mean(self.scores) if self.state == "finished" else 0.0


@dataclass
class Study:
    """All trials of a search and the two rules that read them."""

    space: Space
    seed: int = 42
    sampler: str = "parzen"
    first_draws: int = 10   # uniform draws before densities are estimated
    startup: int = 5        # finished trials before any is stopped
    warmup: int = 2         # folds a trial always gets
    draws: int = 24         # draws compared for one trial
    trials: list[Trial] = field(default_factory=list)

    def propose(self) -> Trial:
        """The next trial, by what the trials with an outcome say."""
        n = len(self.trials)
        rnd = random.Random(self.seed * 1_000_003 + n)
        done = [t for t in self.trials if t.state != "running"]
        if self.sampler == "uniform" or len(done) < self.first_draws:
            params = {k: uniform(v, rnd) for k, v in self.space.items()}
        else:
            ranked = sorted((t for t in done if t.state == "finished"), key=lambda t: (-t.score, t.number))
            best = ranked[:max(1, min(25, math.ceil(len(done) / 10)))]
            rest = [t for t in done if t not in best]
            params = {}
            for k, kind in self.space.items():
                good, bad = (Parzen(kind, [t.params[k] for t in side]) for side in (best, rest))
                tried = [good.draw(rnd) for _ in range(self.draws)]
                params[k] = max(tried, key=lambda v: good.log_density(v) - bad.log_density(v))
        self.trials.append(Trial(n, params))
        return self.trials[-1]

    def hopeless(self, scores: list[float], finished: list[Trial]) -> bool:
        """Whether a trial with these first scores lies below the median of the finished ones."""
        f = len(scores)
        return (f >= self.warmup and len(finished) >= self.startup
                and mean(scores) < median(mean(t.scores[:f]) for t in finished))

    def best(self) -> Trial | None:
        finished = [t for t in self.trials if t.state == "finished"]
        return max(finished, key=lambda t: (t.score, -t.number), default=None)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a trial: number, state, folds, score and settings as text."""
        rows = [(t.number, t.state, len(t.scores), t.score, ", ".join(f"{k}={v}" for k, v in sorted(t.params.items())))
                for t in self.trials]
        return spark.createDataFrame(rows, "trial int, state string, folds int, score double, params string")


def _cancel(sc: SparkContext, tag: str, rest: list[Future]) -> None:
    """End what still runs under a tag. A fold starts job after job, so its tag is cancelled until it is over."""
    rest = [f for f in rest if not f.cancel()]
    while rest:
        sc.cancelJobsWithTag(tag)
        rest = list(wait(rest, timeout=0.2).not_done)


def run_folds(spark: SparkSession, tag: str, n_folds: int, score_fold: Callable[[int], float],
              hopeless: Callable[[list[float]], bool] = lambda scores: False) -> tuple[list[float], bool]:
    """Scores of the folds in order, and whether the trial was stopped before the last one counted."""
    sc = spark.sparkContext

    def one(fold: int) -> float:
        sc.addJobTag(tag)
        sc.setInterruptOnCancel(True)
        try:
            return score_fold(fold)
        finally:
            sc.removeJobTag(tag)

    scores: list[float] = []
    with ThreadPoolExecutor(max(1, n_folds)) as pool:
        jobs = [pool.submit(one, fold) for fold in range(n_folds)]
        try:
            for job in jobs:
                scores.append(job.result())
                if len(scores) < n_folds and hopeless(scores):
                    return scores, True
        finally:
            _cancel(sc, tag, jobs[len(scores):])
    return scores, False


def search(spark: SparkSession, study: Study, n_trials: int, n_folds: int, score_fold: Callable[[dict, int], float],
           refused: tuple[type[Exception], ...] = (), at_once: int = 4, name: str = "search") -> Study:
    """Run ``n_trials`` trials; ``score_fold(params, fold)`` fits and scores one fold.

    A setting for which it raises one of ``refused`` loses; anything else rises.
    """
    def run(trial: Trial, finished: list[Trial]) -> None:
        try:
            trial.scores, stopped = run_folds(
                spark, f"{name}-{study.seed}-{trial.number}", n_folds, lambda fold: score_fold(trial.params, fold),
                lambda scores: study.hopeless(scores, finished))
            trial.state = "stopped" if stopped else "finished"
        except refused:
            trial.state = "refused"

    while len(study.trials) < n_trials:
        finished = [t for t in study.trials if t.state == "finished"]
        batch = [study.propose() for _ in range(min(at_once, n_trials - len(study.trials)))]
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda t: run(t, finished), batch))
    return study
