"""Queries over the given tables, one for each operator, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_language_spans")
def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.language import identify
    return identify(table(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn documents with their log weight and Gumbel key."""
    from pitwall.llm.quality import resample
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn, weight, key = resample(docs, table(spark, sf_dir, "labels"))
    return drawn.select("doc_id", F.col(weight).alias("log_weight"), F.col(key).alias("gumbel_key"))


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op4_winnowed_decontamination", f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, w[i:i + least(13, len(w)) - 1] AS win
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, s.size, w[i:i + s.size - 1] AS win
       FROM (SELECT DISTINCT size FROM bw) s, d, unnest(range(1, len(w) - s.size + 2)) t(i)),
h AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""")
def winnowed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.decontaminate import contamination_hits
    hits = contamination_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items",
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_license_alignment")
def license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.licenses import scan_licenses, templates
    return scan_licenses(table(spark, sf_dir, "documents"), templates(spark))


@query("op6_simhash_groups")
def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.simhash import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


_SECRETS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, name, pattern, part, least) AS (VALUES
    (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
    (2, 'hex', '[0-9a-f]+', 0, 16),
    (3, 'secret', '[A-Za-z0-9+/_=-]{24,}', 0, 24),
    (4, 'endpoint', '[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20"''<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}', 0, 7)),
"""
_SECRETS += ",\n".join(f"""m{k} AS (
    SELECT doc_id, {k} AS kind, unnest(range(1, len(m) + 1)) AS i, m, part, gap
    FROM (SELECT doc_id, regexp_extract_all(text, p{k}) AS m, regexp_extract_all(text, p{k}, {int(k == 0)}) AS part,
                 string_split_regex(text, p{k}) AS gap
          FROM d, (SELECT '_P{k}_' AS p{k})))""" for k in range(5))
_SECRETS += r""",
a AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3
      UNION ALL SELECT * FROM m4),
s AS (SELECT doc_id, kind, part[i] AS part, len(m[i]) AS n,
             list_sum(list_transform(gap[1:i], lambda x: len(x))) +
             coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s FROM a),
c AS (SELECT doc_id, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM s JOIN p USING (kind)
      WHERE len(s.part) >= least AND (kind <> 3 OR regexp_matches(s.part, '[0-9]') AND regexp_matches(s.part, '[A-Za-z]'))),
k AS (SELECT * FROM c WHERE kind < 3
      OR kind = 3 AND EXISTS (FROM c b WHERE b.doc_id = c.doc_id AND b.kind = 1 AND b.s - c.e <= 200 AND c.s - b.e <= 200)
                  AND NOT EXISTS (FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.s < c.e AND b.e > c.s)
      OR kind = 4 AND EXISTS (FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 2 AND b.s - c.e <= 200 AND c.s - b.e <= 200)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans
      FROM k JOIN p USING (kind) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
for _k, _p in enumerate((
        r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]{24,}",
        r"""[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20"''<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}""")):
    _SECRETS = _SECRETS.replace(f"_P{_k}_", _p)


@query("op7_linked_secrets", _SECRETS)
def linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.secrets import find_secrets
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op8_block_max_search", """
WITH e AS (SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e q, e c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""")
def block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.topk import top_k, whole_vectors
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op9_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.tokenfiles import token_table
    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_repeated_substrings")
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.substrings import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_segment_negatives", """
WITH e AS (SELECT vec_id, min({'label': CAST(label AS BIGINT), 'v': list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))}) AS m
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           GROUP BY vec_id),
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (m.label + 1) % 10 ELSE m.label END AS label, m.v AS v FROM e),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM r a, r b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""")
def segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth row; where the id is divisible by 7 the label is moved on by one first."""
    from pitwall.llm.negatives import labelled_vectors, mine
    rows = labelled_vectors(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("vec_id % 50 = 0"))


@query("op12_weighted_whitening")
def weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.whitening import components_of, whiten, whole_rows
    return components_of(whiten(whole_rows(table(spark, sf_dir, "embeddings")), components=32))


@query("op13_likelihood_rules")
def likelihood_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pitwall.llm.likelihood import judge
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, name = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", F.col(name)["n_words"].alias("n_words"), *[F.col(name)[f].alias(f) for f in (
        "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "term_score", "pair_score")])
