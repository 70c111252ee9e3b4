"""Shared storage: where layers are written and how lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# A side is broadcast only after its size was found below this.
BROADCAST_BYTES = 64 << 20

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        root = sc.getConf().get("spark.checkpoint.dir")
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            root = tempfile.mkdtemp(prefix="pitwall-")
            sc.setCheckpointDir(root)
        _roots[app] = f"{root.rstrip('/')}/pitwall/{app}"
    return _roots[app]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages restart from it if executors are lost."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(df: DataFrame):
    """Bytes of a row as an expression: texts and arrays by their length, anything else at 16."""
    width = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, T.ArrayType):
            width = width + 16 * F.greatest(F.lit(1), F.size(c))
        else:
            width = width + 16
    return width.cast("bigint")


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast after measuring; a larger side stays a shuffle join."""
    stored = cut(df)
    size = stored.agg(F.sum(_bytes(stored))).first()[0] or 0
    return F.broadcast(stored) if size <= max_bytes else stored


class Lake:
    """Named layers, each written once per application and read back."""

    _open: dict[tuple[str, str], "Lake"] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._have: set[str] = set()

    @classmethod
    def open(cls, spark: SparkSession, source: str) -> "Lake":
        key = (spark.sparkContext.applicationId, source)
        if key not in cls._open:
            tag = source.strip("/").replace("/", "_")
            cls._open[key] = cls(spark, f"{shared_root(spark)}/{tag}")
        return cls._open[key]

    def built(self, name: str, build: Callable[[str], object]) -> str:
        """The folder of that name, filled by ``build`` the first time it is asked for."""
        if name not in self._have:
            build(self.path(name))
            self._have.add(name)
        return self.path(name)

    def has(self, name: str) -> bool:
        return name in self._have

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def layer(self, name: str, build: Callable[[], DataFrame],
              partition_by: tuple[str, ...] = ()) -> DataFrame:
        if name not in self._have:
            writer = build().write.mode("overwrite")
            if partition_by:
                writer = writer.partitionBy(*partition_by)
            writer.parquet(self.path(name))
            self._have.add(name)
        return self.spark.read.parquet(self.path(name))
