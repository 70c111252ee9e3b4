"""Nearest neighbours against brute force, and what rebalancing makes."""

import math
import random
from functools import reduce
from operator import add  # sum() compensates, which numpy does not

import pytest
from pyspark.sql import functions as F

from pitwall.operators import neighbours
from pitwall.operators.neighbours import border, nearest, rebalanced

SCHEMA = "id string, y int, a double, b double, c int"
FEATURES = ["a", "b", "c"]


def points(n=500, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.12)
        out.append((f"p{i:04d}", y, float(rng.randint(0, 12)) + 3 * y, round(rng.gauss(2 * y, 1), 2), rng.randint(0, 2)))
    out += [(f"q{i:04d}", int(i % 9 == 0), 5.0, 0.5, 1) for i in range(n // 2)]  # a third of all rows is one point
    return out


def brute(queries, rows, k):
    out = {}
    for q in queries:
        far = sorted((reduce(add, [(float(u) - float(v)) * (float(u) - float(v)) for u, v in zip(q[2:], r[2:])]), r[0]) for r in rows if r[0] != q[0])
        out[q[0]] = [(r, i + 1, math.sqrt(d)) for i, (d, r) in enumerate(far[:k])]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query"], []).append((r["key"], r["place"], r["distance"]))
    return {q: sorted(v, key=lambda t: t[1]) for q, v in out.items()}


def same(got, want):
    assert set(got) == {q for q, v in want.items() if v}
    for q, rows in got.items():
        assert [r[:2] for r in rows] == [r[:2] for r in want[q]]
        assert [r[2] for r in rows] == pytest.approx([r[2] for r in want[q]])


@pytest.mark.parametrize("pivots,part", [(64, 20_000), (7, 30), (1, 50)])
def test_neighbours_are_those_of_brute_force(spark, monkeypatch, pivots, part):
    monkeypatch.setattr(neighbours, "PIVOTS", pivots)
    monkeypatch.setattr(neighbours, "PART_ROWS", part)
    rows = points()
    asked = [r for r in rows if r[1] == 1]
    same(found(nearest(table(spark, asked), table(spark, rows), FEATURES, "id", 10)), brute(asked, rows, 10))


def test_few_rows_nulls_and_empty_tables(spark):
    rows = [("a", 1, 1.0, 1.0, 1), ("b", 0, None, 1.0, 1), ("c", 0, 2.0, float("nan"), 1), (None, 1, 1.0, 1.0, 1), ("d", 1, 1.0, 3.0, 1)]
    df = table(spark, rows)
    assert found(nearest(df, df, FEATURES, "id", 3)) == {"a": [("d", 1, 2.0)], "d": [("a", 1, 2.0)]}
    assert nearest(df.limit(0), df, FEATURES, "id", 3).count() == 0
    assert nearest(df, df.limit(0), FEATURES, "id", 3).count() == 0


def test_border_and_made_rows(spark):
    rows = points(seed=4)
    df, by = table(spark, rows), {r[0]: r for r in rows}
    want = brute([r for r in rows if r[1] == 1], rows, 10)
    others = {q: sum(1 - by[k][1] for k, _, _ in near) for q, near in want.items()}
    got = {r["id"]: (r["others"], r["on_border"]) for r in border(df, "y", FEATURES, "id").collect()}
    assert got == {q: (n, 5 <= n < 10) for q, n in others.items()}
    edge = {q for q, (_, b) in got.items() if b}
    assert len(edge) > 5

    for ratio in (1.0, 0.5):
        out = rebalanced(df, "y", FEATURES, "id", ratio).collect()
        n0, n1 = sum(r["y"] == 0 for r in out), sum(r["y"] == 1 for r in out)
        assert n1 == max(round(n0 * ratio), sum(r[1] for r in rows)) and n0 == sum(1 - r[1] for r in rows)
    made = [tuple(float(r[f]) for f in FEATURES) for r in rebalanced(df, "y", FEATURES, "id").where("made").collect()]
    ones = [r for r in rows if r[1] == 1]
    ends = [(tuple(map(float, by[q][2:])), tuple(map(float, by[k][2:]))) for q, near in brute([by[q] for q in edge], ones, 3).items() for k, _, _ in near]

    def between(p):
        for u, v in ends:
            d = [y - x for x, y in zip(u, v)]
            if not any(d):
                if p == u:
                    return True
                continue
            at = sum((c - x) * e for c, x, e in zip(p, u, d)) / sum(e * e for e in d)
            if -1e-9 <= at <= 1 + 1e-9 and all(abs(x + at * e - c) < 1e-6 for x, e, c in zip(u, d, p)):
                return True
        return False

    assert all(between(p) for p in made) and len(set(made)) > 20
    again = rebalanced(df.repartition(3), "y", FEATURES, "id").where("made")
    assert sorted(made) == sorted(tuple(float(r[f]) for f in FEATURES) for r in again.collect())


def test_nothing_to_make(spark):
    apart = [(f"n{i}", 0, float(i % 7), 0.0, 0) for i in range(40)] + [(f"p{i}", 1, 500.0 + i, 0.0, 0) for i in range(12)]
    assert rebalanced(table(spark, apart), "y", FEATURES, "id").where("made").count() == 0
    assert rebalanced(table(spark, apart).where("y = 0"), "y", FEATURES, "id").count() == 40
    many = [(i, 1 - y, a, b, c) for i, y, a, b, c in apart]
    assert rebalanced(table(spark, many), "y", FEATURES, "id").count() == 52
