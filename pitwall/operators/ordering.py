"""Order-dependent operators that stay spread out when one group is huge.

A Spark window sends a whole group to one task. That is right for groups the
calendar bounds, and wrong for "all entrants of an event" or "all scored rows".
Here the largest group is counted first. Up to ``LIMIT`` rows the plain window
runs; beyond it all rows are dealt into ranges of (group, order), as many as their
number asks for, each range is ordered on its own, and the totals of a group's
ranges before it are added. Both ways give the same rows: NULL is a group like any
other, and NULL values rank last, tied with each other, whatever the direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.plans.lake import cut, small

LIMIT = 2_000_000


def _largest(df: DataFrame, by: list[str]) -> int:
    if not by:
        return df.count()
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return row[0] or 0


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys under which NULL meets NULL; the keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _ranges(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """Add ``__b``: the number of the range of (group, order) a row falls into."""
    parts = max(2, -(-2 * df.count() // limit))
    dealt = df.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    return cut(dealt.withColumn("__b", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[Column],
            sums: dict[str, Column], limit: int | None = None) -> DataFrame:
    """Running totals, own row included, along a unique order."""
    limit = limit or LIMIT
    keys = by or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    if _largest(df, by) <= limit:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        out = src.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
        return out if by else out.drop("__all")

    src = _ranges(src.withColumns({f"__v_{n}": c for n, c in sums.items()}), keys, order, limit)
    totals = src.groupBy(*keys, "__b").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b", *[F.sum(f"__t_{n}").over(before).alias(f"__o_{n}") for n in sums])
    w = W.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = src.withColumns({n: F.sum(f"__v_{n}").over(w) for n in sums})
    out = meet(inner, small(offsets), [*keys, "__b"])
    # a NULL total has no rows with a value before; a NULL sum has none up to here
    out = out.withColumns({n: F.when(F.col(n).isNull(), F.col(f"__o_{n}")).otherwise(
        F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))) for n in sums})
    return out.drop("__all", "__b", *[f"__v_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def row_number(df: DataFrame, by: list[str], order: list[Column], name: str,
               limit: int | None = None) -> DataFrame:
    out = running(df, by, order, {name: F.lit(1).cast("bigint")}, limit)
    return out.withColumn(name, F.col(name).cast("int"))


def rank(df: DataFrame, by: list[str], value: str, name: str,
         descending: bool = True, limit: int | None = None) -> DataFrame:
    """RANK with ties, NULL last. A large group is first reduced to its distinct values."""
    limit = limit or LIMIT
    key = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    if by and _largest(df, by) <= limit:
        w = W.partitionBy(*by).orderBy(key)
        return df.withColumn(name, F.rank().over(w))
    values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    values = running(cut(values), by, [key], {"__upto": F.col("__n")}, limit)
    values = values.select(*by, value, (F.col("__upto") - F.col("__n") + 1).cast("int").alias(name))
    return meet(df, values, [*by, value])


def quantiles(df: DataFrame, by: list[str], value: str, key: str,
              probs: dict[str, float], limit: int | None = None) -> DataFrame:
    """Exact interpolated quantiles, reading only the rows around each cut."""
    rows = row_number(df.where(F.col(value).isNotNull()), by,
                      [F.col(value), F.col(key)], "__rn", limit)
    rows = meet(rows, small(df.groupBy(*by).agg(F.count(value).alias("__n"))), by)
    aggs = []
    for name, p in probs.items():
        at = (F.col("__n") - 1) * F.lit(float(p)) + 1
        low = F.max(F.when(F.col("__rn") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("__rn") == F.ceil(at), F.col(value)))
        frac = F.max(at - F.floor(at))
        aggs.append((low + (high - low) * frac).alias(name))
    return rows.groupBy(*by).agg(*aggs)


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key. Spark trims every map task to one row per key first."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int,
          name: str | None = None) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name or "__rn", F.row_number().over(w)).where(F.col(name or "__rn") <= k)
    return out if name else out.drop("__rn")
