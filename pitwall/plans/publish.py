"""Layers published as a whole: every run writes folders of its own, a pointer is written last.

Under a root, ``runs/<run>/<layer>/season=...`` holds what a run wrote, and
``published/<version>.json`` says for every layer and season which run's folder counts.
A version is one small file that appears by a rename after all data is there, so readers
see the former run or the whole new one, never half of it. A run that extends the lake
names its own folders for the seasons it rewrote and the old ones for the rest; nothing
is copied and nothing that a reader may hold is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# layer -> {"by": column the folders are named by, "runs": {season: run}}
Layers = dict[str, dict]


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _folder(spark, f"{root}/published")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def new_run(root: str) -> tuple[str, str]:
    """The name of a run and the folder it writes to."""
    run = uuid.uuid4().hex
    return run, f"{root}/runs/{run}"


def current(spark: SparkSession, root: str) -> Layers | None:
    """The layers of the newest published version; None if there is none."""
    versions = _versions(spark, root)
    if not versions:
        return None
    text = spark.read.text(f"{root}/published/{versions[-1]:012d}.json", wholetext=True).first()[0]  # one small file
    return json.loads(text)


def publish(spark: SparkSession, root: str, layers: Layers, after: int | None = None) -> int:
    """Make ``layers`` the newest version and return its number.

    ``after`` is the version the run started from; if another run has published since,
    this is an error rather than a loss of that run's work.
    """
    fs, folder = _folder(spark, f"{root}/published")
    fs.mkdirs(folder)
    versions = _versions(spark, root)
    last = versions[-1] if versions else 0
    if after is not None and after != last:
        raise RuntimeError(f"version {last} was published after version {after}, which this run read")
    version = last + 1
    _, draft = _folder(spark, f"{root}/published/draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(layers, sort_keys=True).encode()))
    out.close()
    _, final = _folder(spark, f"{root}/published/{version:012d}.json")
    if not fs.rename(draft, final):
        raise RuntimeError(f"version {version} was published meanwhile")
    return version


def version_of(spark: SparkSession, root: str) -> int:
    return max(_versions(spark, root), default=0)


def written(spark: SparkSession, root: str, run: str, layer: str, by: str) -> dict[str, str]:
    """The seasons of a layer that a run wrote, as entries for ``runs``."""
    fs, at = _folder(spark, f"{root}/runs/{run}/{layer}")
    if not fs.exists(at):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return {n.removeprefix(f"{by}="): run for n in names if n.startswith(f"{by}=")}


def read(spark: SparkSession, root: str, layer: str, layers: Layers | None = None,
         first: int | None = None, before: int | None = None) -> DataFrame:
    """A published layer, or its seasons from ``first`` on and before ``before``: only their folders are opened."""
    layers = layers if layers is not None else current(spark, root)
    if not layers or layer not in layers:
        raise ValueError(f"no layer {layer} is published under {root}")
    by, by_run = layers[layer]["by"], {}
    for season, run in layers[layer]["runs"].items():
        by_run.setdefault(run, []).append(int(season))
    if not by_run:
        raise ValueError(f"layer {layer} has no season under {root}")
    parts = []
    for run, seasons in sorted(by_run.items()):
        df = spark.read.parquet(f"{root}/runs/{run}/{layer}").where(F.col(by).isin(seasons))
        if first is not None:
            df = df.where(F.col(by) >= first)
        if before is not None:
            df = df.where(F.col(by) < before)
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
