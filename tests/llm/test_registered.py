"""Registered queries on the smallest tables: against their SQL, or against the rules of the contract."""

import duckdb
import pytest

from check import TABLES, canon, frame
from conftest import SF
from llm.shapes import CLASH

import corpus_pipeline
from pitwall.llm import quality, secrets
from pitwall.llm.queries import ORACLES, QUERIES
from pitwall.llm.simhash import simhash_groups


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = frame([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(ORACLES[name])
    want = frame(cur.fetchall(), [d[0] for d in cur.description])
    assert list(got.columns) == list(want.columns)
    assert canon(got) == canon(want)


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= names


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if docs.columns == columns else {}
        docs = stage(spark, docs, SF)
        kept[name] = before, {r["doc_id"] for r in docs.collect()}
        if name != "best-fit packing":
            assert docs.columns == columns
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = quality.resample(whole, spark.read.parquet(f"{SF}/labels.parquet"))[0]
    assert kept["quality classifier"][1] == {r["doc_id"] for r in drawn.collect()}
    before, after = kept["simhash near-dedup"]
    groups = simhash_groups(whole.where(whole.doc_id.isin(list(before))))
    assert after == {r["component_id"] for r in groups.collect()}
    before, after = kept["benchmark decontamination"]
    bad = {r["doc_id"] for r in QUERIES["op4_winnowed_decontamination"](spark, SF).where("contaminated").collect()}
    assert after == set(before) - bad
    before, after = kept["secret scans"]
    assert after == set(before)
    assert kept["best-fit packing"][1] == after
    for text in kept["best-fit packing"][0].values():
        assert not any(s in text for s in ("AKIA", "password="))


def test_stages_stand_odd_rows(spark):
    from llm.shapes import odd
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and set(CLASH) <= set(out.columns)
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert secrets.redact(docs).count() == docs.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).where("doc_id = 1").count() == 1


def test_near_duplicates_keep_one_of_each_group(spark):
    import random
    from llm.shapes import SCHEMA
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"{x}{rng.randrange(10 ** 6)}" for _ in range(80)) for x in "abcdef")
    # distinct texts without an id, a copy of a kept document without one, and ids with two texts
    pairs = [(None, a), (None, b), (None, b), (None, c), (9, c), (1, d), (2, d), (1, e), (3, f), (4, f), (3, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, a), (None, b), (9, c), (2, d), (1, e), (3, f)]))
