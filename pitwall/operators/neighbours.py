"""Exact nearest neighbours by buckets, and rebalancing of classes along the border between them.

Rows are dealt to the nearest of a bounded number of pivots. A query looks into its own
bucket first; the distance of its k-th neighbour there bounds all others, so by the
triangle inequality it has to visit another bucket only if that bucket's pivot is nearer
than this distance plus the bucket's radius. Nothing else is left out. A bucket is split
into parts of bounded size, so equal rows, however many, never meet in one task; queries
stream past a part in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pitwall.operators.ordering import row_number
from pitwall.plans.lake import cut, small

PIVOTS = 64       # rows, at most, that buckets are built around; they travel with the tasks
PART_ROWS = 20_000
BLOCK = 1 << 22   # differences held at once
SLACK = 1e-9      # of a distance, for rounding


def _points(df: DataFrame, features: list[str], key: str) -> DataFrame:
    """key and the vector ``x``; rows with a missing key or feature take no part."""
    values = [F.col(f).cast("double") for f in features]
    some = F.col(key).isNotNull()
    for v in values:
        some = some & v.isNotNull() & ~F.isnan(v)
    return df.where(some).select(F.col(key).alias("key"), F.array(*values).alias("x"))


def _nearest_pivot(pivots: np.ndarray):
    @F.pandas_udf("struct<bucket:int,r:double>")
    def assign(x: pd.Series) -> pd.DataFrame:
        m = np.stack(x.to_numpy()) if len(x) else np.empty((0, pivots.shape[1]))
        d = np.sqrt(((m[:, None, :] - pivots[None]) ** 2).sum(axis=2))
        at = d.argmin(axis=1)
        return pd.DataFrame({"bucket": at.astype("int32"), "r": d[np.arange(len(m)), at]})
    return assign


def _buckets_in_reach(pivots: np.ndarray, radii: np.ndarray):
    """Buckets but the own one that can hold a row within ``bound`` of x."""
    @F.pandas_udf("array<int>")
    def reach(x: pd.Series, own: pd.Series, bound: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()) if len(x) else np.empty((0, pivots.shape[1]))
        d = np.sqrt(((m[:, None, :] - pivots[None]) ** 2).sum(axis=2))
        limit = np.nan_to_num(bound.to_numpy(float), nan=np.inf)[:, None]
        near = (d - radii[None]) * (1 - SLACK) <= limit * (1 + SLACK)
        near &= radii[None] >= 0
        near[np.arange(len(m)), own.to_numpy(int)] = False
        return pd.Series([np.flatnonzero(row).astype("int32").tolist() for row in near])
    return reach


def _met(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest rows to each query in each part it visits: query, key and squared distance.

    ``rows`` has bucket, part, key, x; ``queries`` has bucket, part, key, x. Rows of a part come first.
    """
    kind = dict(rows.dtypes)["key"]
    both = rows.select("bucket", "part", F.lit(0).alias("kind"), "key", "x").unionByName(
        queries.select("bucket", "part", F.lit(1).alias("kind"), "key", "x"))
    both = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")

    def near(part: tuple[np.ndarray, np.ndarray], asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        keys, m = part
        q, names = np.stack(asked["x"].to_numpy()), asked["key"].to_numpy()
        step = max(1, BLOCK // max(1, m.size))
        for at in range(0, len(q), step):
            d = ((q[at:at + step, None, :] - m[None]) ** 2).sum(axis=2)
            d[names[at:at + step, None] == keys[None]] = np.inf
            kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d))
            if len(i):
                out = pd.DataFrame({"query": names[at + i], "key": keys[j], "d2": d[i, j]})
                # of rows equally far the smaller keys stay
                out = out.sort_values(["query", "d2", "key"]).groupby("query", sort=False).head(k)
                yield out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, rows_of = None, [], None
        for frame in frames:
            for (bucket, part, kind_), some in frame.groupby(["bucket", "part", "kind"], sort=True):
                if (bucket, part) != now:
                    now, parts, rows_of = (bucket, part), [], None
                if kind_ == 0:
                    parts.append(some)
                    continue
                if rows_of is None and parts:
                    every = pd.concat(parts)
                    rows_of, parts = (every["key"].to_numpy(), np.stack(every["x"].to_numpy())), []
                if rows_of is not None:
                    yield from near(rows_of, some)

    return both.mapInPandas(run, f"query {kind}, key {kind}, d2 double")


def nearest(queries: DataFrame, rows: DataFrame, features: list[str], key: str, k: int) -> DataFrame:
    """query, key, place (from 1) and distance of each query's k nearest rows but itself.

    Keys identify rows; of rows equally far those with the smaller key come first.
    """
    points, asked = cut(_points(rows, features, key)), cut(_points(queries, features, key))
    chosen = points.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).select("x").distinct().collect()  # PIVOTS vectors
    if not chosen:
        return _ranked(points.select(F.col("key").alias("query"), "key", F.lit(0.0).alias("d2")), k)
    pivots = np.array([r["x"] for r in chosen])
    assign = _nearest_pivot(pivots)
    dealt = cut(points.withColumn("a", assign("x")).select("key", "x", "a.bucket", "a.r"))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"))
    parts, radii = {}, np.full(len(pivots), -1.0)  # a bucket without rows is never visited
    for r in sizes.collect():  # one row a pivot
        parts[r["bucket"]] = max(1, -(-r["n"] // PART_ROWS))
        radii[r["bucket"]] = r["radius"]
    n_parts = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), n_parts[F.col("bucket")]).cast("int"))

    def visits(q: DataFrame, buckets: Column) -> DataFrame:
        q = q.select("key", "x", F.explode(buckets).alias("bucket")).where(n_parts[F.col("bucket")].isNotNull())
        return q.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts[F.col("bucket")] - 1)))

    asked = asked.withColumn("own", assign("x")["bucket"])
    first = cut(_met(dealt, visits(asked, F.array("own")), k))
    bound = _ranked(first, k).groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    bounded = asked.join(bound.withColumnRenamed("query", "key"), "key", "left")
    other = _met(dealt, visits(bounded, _buckets_in_reach(pivots, radii)("x", "own", "bound")), k)
    return _ranked(first.unionByName(other), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window as W
    order = W.partitionBy("query").orderBy("d2", "key")  # at most k rows of each part a query visits
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(
        "query", "key", "place", F.sqrt("d2").alias("distance"))


def border(df: DataFrame, target: str, features: list[str], key: str, m: int = 10) -> DataFrame:
    """Rows of the class 1 with how many of their m nearest rows are of class 0, and whether they lie on the border.

    On the border at least half of the neighbours, but not all, are of class 0.
    """
    rows = cut(df.select(key, F.col(target).cast("int").alias("__y"), *[f for f in features if f != key]).where(F.col(target).isNotNull()))
    found = nearest(rows.where("__y = 1"), rows, features, key, m)
    labels = rows.select(F.col(key).alias("key"), "__y")
    per = found.join(labels, "key").groupBy("query").agg(
        F.count(F.lit(1)).alias("neighbours"), F.sum(1 - F.col("__y")).alias("others"))
    danger = (2 * F.col("others") >= F.col("neighbours")) & (F.col("others") < F.col("neighbours"))
    return per.select(F.col("query").alias(key), "neighbours", "others", danger.alias("on_border"))


def rebalanced(df: DataFrame, target: str, features: list[str], key: str, ratio: float = 1.0, k: int = 3, m: int = 10,
               seed: int = 42) -> DataFrame:
    """target, features and ``made``: all rows, and new rows of class 1 until there are ``ratio`` times as many as of class 0.

    A new row lies between a border row and one of its k nearest rows of class 1, at a place
    drawn by a hash. Border rows make as many new rows each, give or take one. Without a
    border row, or with rows of class 1 enough, nothing is made.
    """
    rows = cut(df.select(key, F.col(target).cast("int").alias(target), *[F.col(f).cast("double").alias(f) for f in features]).where(
        F.col(target).isNotNull()))
    kept = rows.select(target, *features, F.lit(False).alias("made"))
    counts = {r[0]: r[1] for r in rows.groupBy(target).count().collect()}  # two rows
    needed = round(counts.get(0, 0) * ratio) - counts.get(1, 0)
    if needed <= 0 or not counts.get(1):
        return kept
    edge = cut(border(rows, target, features, key, m).where("on_border").select(key))
    ones = rows.where(F.col(target) == 1)
    start = ones.join(edge, key, "left_semi")
    near = nearest(start, ones, features, key, k).groupBy(F.col("query").alias(key)).agg(
        F.sort_array(F.collect_list(F.struct("place", "key"))).alias("__near"))  # k of them
    start = cut(start.join(near, key))
    n = start.count()
    if n == 0:
        return kept
    start = row_number(start, [], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "__turn")
    copies = F.lit(needed // n) + (F.col("__turn") <= needed % n).cast("int")
    made = start.withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    pick = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), "__copy"), F.size("__near")).cast("int")
    place = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(key), "__copy"), F.lit(1 << 30)) / float(1 << 30)
    made = made.withColumns({"__to": F.get("__near", pick)["key"], "__at": place})
    ends = small(ones.select(F.col(key).alias("__to"), *[F.col(f).alias(f"__end_{f}") for f in features]))
    made = made.join(ends, "__to").select(target, *[
        (F.col(f) + F.col("__at") * (F.col(f"__end_{f}") - F.col(f))).alias(f) for f in features], F.lit(True).alias("made"))
    return kept.unionByName(made)
