"""The corpus pipeline: what a raw corpus goes through before training.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
and all but the last return the columns of documents. ``run`` writes each stage as
Parquet in the shared folder and reads it back, so a lost executor never costs more
than the tasks of one stage.

1. quality classifier: documents the resampling rejects go
2. SimHash near-dedup: one document of each group stays, the one with the least id
3. benchmark decontamination: contaminated documents go
4. secret scans: reported spans are replaced by a mark
5. best-fit packing: the rest becomes sequences of at most 4096 tokens

Stage 2 keeps one row of each group. Rows with a null doc_id are documents of their
own there and come after all ids; of equal ids the least hash of the text comes first.
Rows of one doc_id count as one document and only one of them is kept: if they are in
several groups it stands for the smallest of these that picks it, and the others take
their next document. A group goes without only if each of its documents stands for another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pitwall.llm.common import stored
from pitwall.llm.decontaminate import contaminated_out
from pitwall.llm.packing import pack_documents
from pitwall.llm.quality import resample
from pitwall.llm.secrets import redact
from pitwall.llm.simhash import simhash_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    drawn, _, _ = resample(docs, _table(spark, sf_dir, "labels"))
    return drawn.select(*docs.columns)


def _one_of_each(rows: DataFrame) -> DataFrame:
    """doc_id, h1 and h2 of the row that stays of each group ``root``; no doc_id is there twice but null."""
    texts = stored(rows.groupBy("root", "doc_id").agg(F.min(F.struct("h1", "h2")).alias("text")), "texts")
    left, out = texts, None
    while True:
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text")
        picks = stored(left.groupBy("root").agg(F.min(order).alias("p"), F.count(F.lit(1)).alias("size")).select(
            "root", "size", "p.doc_id", "p.text"), "picks")
        named = picks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("size", "root", "text")).alias("p"))
        won = stored(named.select("doc_id", "p.root", "p.text").unionByName(
            picks.where("doc_id IS NULL").select("doc_id", "root", "text")), "won")
        out = won if out is None else out.unionByName(won)
        if won.count() == picks.count():
            return out.select("doc_id", "text.h1", "text.h2")
        left = left.join(won.select("root"), "root", "left_anti")
        left = stored(left.join(won.select("doc_id"), "doc_id", "left_anti"), "left")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")
    rows = simhash_rows(docs.select("doc_id", "text", *hashes), shingle=3, max_bits=2, carried=("h1", "h2"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key, *hashes).join(
        _one_of_each(rows).select(*key, "h1", "h2"), ["id", "none", "h1", "h2"], "left_semi")
    one = W.partitionBy("id", "none", "h1", "h2").orderBy("h1")  # equal rows, dealt as the join left them
    return kept.withColumn("n", F.row_number().over(one)).where("n = 1").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contaminated_out(docs, _table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

# Hashed models, fingerprints and tokenisation have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
