"""Hard negatives and whitening against brute force on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.shapes import CLASH
from pitwall.llm import negatives, whitening
from pitwall.llm.negatives import best_negatives, best_positives, labelled_vectors, mine
from pitwall.llm.queries import QUERIES
from pitwall.llm.whitening import components_of, whiten, whole_rows

SCHEMA = "vec_id long, embedding array<double>, label int"


def embeddings(n=260, width=7, seed=3):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(width)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    rows += [(5, rows[5][1], rows[5][2]), (6, rows[7][1], 1), (n, [0.5] * (width - 3), 0), (n + 1, [], 1), (n + 2, rows[0][1], 0),
             (n + 3, None, 1), (n + 4, [0.1, None, 0.2], 1), (n + 5, [math.nan] + [0.0] * (width - 1), 0),
             (n + 6, [math.inf] * width, 0), (n + 7, [0.2] * width, None), (None, [0.2] * width, 1), (None, None, None)]
    return rows + [(n + 100 + i, [0.25] * width, 3) for i in range(90)]  # a third of all rows is one vector


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in (*CLASH, "v", "x", "h", "rank", "group", "common")}).repartition(3)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def expected(rows, every=50, positives=5, negatives=3):
    least = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            key = (label, [math.floor(256 * c) for c in v])
            least[i] = min(least.get(i, key), key)
    for i, (label, v) in least.items():
        least[i] = ((label + 1) % 10 if i % 7 == 0 else label, v)
    out = []
    for a, (label, v) in least.items():
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in least.items()}
        ranked = sorted(least, key=lambda b: (-score[b], b))
        for p in [b for b in ranked if b != a and least[b][0] == label][:positives]:
            fit = [b for b in ranked if least[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(df, every=50, **settings):
    rows = labelled_vectors(df)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(tuple(r) for r in mine(rows, rows.where(f"vec_id % {every} = 0"), **settings).collect())


@pytest.mark.parametrize("every", [50, 10])
def test_negatives_of_odd_rows(spark, every):
    rows = embeddings()
    want = expected(rows, every)
    assert len(want) > 20 and mined(frame(spark, rows), every) == want


def test_negatives_whatever_the_blocks(spark, monkeypatch):
    rows = embeddings(seed=9)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    monkeypatch.setattr(negatives, "GROUP_BYTES", 2000)
    assert mined(frame(spark, rows), 20) == expected(rows, 20)


def test_negatives_with_other_bounds(spark):
    rows = embeddings(seed=4)
    assert mined(frame(spark, rows), 20, positives=2, negatives=1) == expected(rows, 20, 2, 1)
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, rows[:1])) == []


@pytest.mark.parametrize("scale", [1, 1000, 10 ** 6])
def test_summaries_bound_every_score(scale):
    rng = np.random.default_rng(scale)
    m = rng.integers(-scale, scale, (60, 33))
    rows = negatives._Rows(np.arange(60), np.zeros(60, np.int64), m)
    score = rows.vectors @ rows.vectors.T
    every, reach = slice(0, 60), []
    for level in range(len(negatives.LENGTHS)):
        low, high = rows.bounds(level, every, rows, every)
        assert (low <= score).all() and (score <= high).all()
        reach.append((high - low).sum())
    assert reach[0] > reach[1] > reach[2]


@pytest.mark.parametrize("columns", [16, 4096])
def test_best_rows_of_a_group(monkeypatch, columns):
    monkeypatch.setattr(negatives, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    labels = rng.integers(0, 3, 400)
    labels[100:300] = 1
    group = negatives._Rows(np.arange(400), labels, rng.integers(-3, 4, (400, 16)))  # many ties
    anchors = negatives._Rows(group.ids[::40], group.labels[::40], group.vectors[::40])
    score = anchors.vectors @ group.vectors.T
    top = best_positives(anchors, group, 4)
    low, high = np.full((10, 2), [[3, 20]]), np.full((10, 2), [[12, 1000]])
    near = best_negatives(anchors, group, low, high, 3)
    for i in range(10):
        order = np.lexsort((group.ids, -score[i]))
        same = [j for j in order if group.labels[j] == anchors.labels[i] and group.ids[j] != anchors.ids[i]][:4]
        assert sorted(top.id[top.slot == i]) == sorted(group.ids[same])
        for w in range(2):
            fit = [j for j in order if group.labels[j] != anchors.labels[i] and low[i, w] <= score[i, j] <= high[i, w]][:3]
            assert sorted(near.id[near.slot == 2 * i + w]) == sorted(group.ids[fit])


def check_whitening(rows, got, components, weights="rows"):
    fit = [(i, v) for i, v, _ in rows if usable(v)]
    width = max(len(v) for _, v in fit)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in fit])
    base = x if weights == "rows" else np.unique(x, axis=0)
    n, total = len(base), base.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(base.T.astype(float), bias=True))
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > e[0] * 1e-12).sum()))
    w = (x - total / n) @ q[:, :k] / np.sqrt(e[:k])
    want = {}
    for (i, _), deviation, values in zip(fit, ((n * x - total) ** 2).sum(axis=1), w):
        want.setdefault((i, int(deviation)), []).append(values)
    by = {}
    for r in got:
        assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 and r["identity_error"] < 1e-6
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert len(got) == len(fit) * k and set(by) == set(want)
    signs = np.zeros(k)
    for key, values in want.items():
        found = np.array([sorted(by[key][c]) for c in range(1, k + 1)])
        exact = np.sort(np.array(values).T, axis=1)
        if len(values) == 1:
            signs = np.where(signs == 0, np.sign(found[:, 0] * exact[:, 0]), signs)
            np.testing.assert_allclose(found[:, 0], signs * exact[:, 0], atol=1e-6)


@pytest.mark.parametrize("components", [3, 32])
@pytest.mark.parametrize("weights", ["rows", "distinct"])
def test_whitening_of_odd_rows(spark, components, weights):
    rows = embeddings()
    got = components_of(whiten(whole_rows(frame(spark, rows)), components, weights)).collect()
    check_whitening(rows, got, components, weights)


def test_whitening_meets_hot_and_rare_vectors_alike(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_SHARE", 10)  # the common vector goes one way, all others the other
    rows = embeddings(seed=5)
    check_whitening(rows, components_of(whiten(whole_rows(frame(spark, rows)), 4)).collect(), 4)


def test_whitening_without_spread(spark):
    same = [(i, [0.5, 0.25], 1) for i in range(5)]
    for rows in (same, same[:1], [(1, [], 0)], [(1, None, 0)]):
        assert components_of(whiten(whole_rows(spark.createDataFrame(rows, SCHEMA)))).count() == 0
    assert components_of(whiten(whole_rows(spark.createDataFrame(same, SCHEMA).limit(0)))).count() == 0
    line = components_of(whiten(whole_rows(spark.createDataFrame(same + [(9, [0.75, 0.5], 1)], SCHEMA)))).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 6


def test_deviations_are_exact_or_null():
    n, x = 10 ** 7, np.array([[5 * 10 ** 9, 1], [1_000_003, 0]])
    sums = np.array([10 ** 6 * n + 17, 3])
    centred = whitening._centred(x, n, sums)
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening._deviations(centred) == [v if v < 2 ** 63 else None for v in exact] and exact[0] >= 2 ** 63 > exact[1]


def test_registered_whitening(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = QUERIES["op12_weighted_whitening"](spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check_whitening(rows, got.collect(), 32)
