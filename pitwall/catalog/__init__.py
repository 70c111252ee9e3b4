"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from pitwall.sources.testbed import Testbed

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(testbed)`` under ``name``; the oracle is optional."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles so that neither summation order nor exact halves show."""
    return df.select(*[
        F.round(F.col(f.name) + 1e-9, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields])


def load_all() -> None:
    import importlib
    for part in ("bronze", "store", "season", "tables", "explore", "scalars", "scoring", "forecasts", "streams", "training"):
        importlib.import_module(f"pitwall.catalog.{part}")
