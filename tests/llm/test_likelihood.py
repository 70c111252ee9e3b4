"""Quality rules against plain Python."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.shapes import CLASH, LONG, ROWS, odd
from pitwall.llm import likelihood
from pitwall.llm.likelihood import FIELDS, judge, kept, rule_counts
from pitwall.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-`{-~]+")
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times, covered, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


TEXTS = [t for _, t, *_ in ROWS] + [
    "a", "a a a a", "a b c a b c", "x\nx\nx \n x\n\n\nx", "\n", "é\n é\né", "     ", "a\rb\r\na\rb\r", "# * $%&|<>##", "a b\u000bc\u000cd",
    "one two\nthree one two\nthree", "last line\nlast line", "\nq\nq", LONG + "\n" + LONG, "w " * 300_000]


def test_counts_are_those_of_plain_python():
    got = list(zip(*rule_counts(pa.array(TEXTS, pa.string()))))
    assert [tuple(int(v) for v in g) for g in got] == [plain_counts(t) for t in TEXTS]
    assert [len(c) for c in rule_counts(pa.array([], pa.string()))] == [0] * len(FIELDS)


def terms_of(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = TERM.findall((text or "").translate(table))
    return Counter(terms), Counter(zip(terms, terms[1:]))


def plain_scores(docs, target, smoothing, size, part):
    """Mean log ratios of each text for the given target documents, counter by counter."""
    out = []
    for order in range(2):
        grams = [terms_of(t)[order] for _, t in docs]
        distinct = sorted(set().union(*grams))
        alone = pa.array(distinct if order == 0 else [" ".join(g) for g in distinct])
        h = likelihood.ngrams(alone)[order][1]
        assert len(h) == len(distinct)
        ratio = {}
        for table in likelihood.TABLES[order]:
            at = dict(zip(distinct, likelihood.counters(table, h, size, part).tolist()))
            raw, good = Counter(), Counter()
            for (i, _), c in zip(docs, grams):
                for g, n in c.items():
                    raw[at[g]] += n
                    good[at[g]] += n * (i in target)
            share = sum(good.values()) / sum(raw.values())
            for g in distinct:
                r = math.log((good[at[g]] + smoothing) / (raw[at[g]] * share + smoothing))
                ratio[g] = min(ratio.get(g, r), r, key=abs)
        out.append([sum(ratio[g] * n for g, n in c.items()) / max(1, sum(c.values())) for c in grams])
    return list(zip(*out))


@pytest.mark.parametrize("parts", [1, 4])
def test_scores_are_those_of_plain_multinomials(spark, monkeypatch, parts):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = likelihood._labelled(labels, 10_000).collect()
    target = {r["id"] for r in sample if r["good"] and not r["held"]}
    assert target and any(r["held"] for r in sample)
    size = likelihood.table_size(table, 16)
    monkeypatch.setattr(likelihood, "PART", size // parts)
    judged, name = judge(table, labels)
    got = {r["doc_id"]: r[name] for r in judged.collect()}
    for (i, text), want in zip(docs, plain_scores(docs, target, 3.0, size, size // parts)):
        assert tuple(got[i][f] for f in FIELDS) == plain_counts(text)
        assert math.isclose(got[i]["term_score"], want[0], abs_tol=1e-5) and math.isclose(got[i]["pair_score"], want[1], abs_tol=1e-5)
        n, again = got[i]["n_words"], got[i]["n_repeat_words"]
        assert got[i]["base_failed"] == (n < 50 or 100 * again > 50 * n)


def corpus():
    """Prose of a small vocabulary; bad documents hold words that no good one has."""
    import random
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(90)]
        if bad:
            for at in rng.sample(range(90), 5):
                words[at] = rng.choice(["vile", "nasty"])
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_bad_documents_go_and_clean_ones_stay(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"] for r in kept(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == {i for i, _ in docs if i % 8}
    again = {r["doc_id"] for r in kept(df.repartition(7), spark.createDataFrame(labels[::-1], LABELS)).collect()}
    assert again == got


def test_cut_is_the_best_of_all(spark):
    docs, labels = corpus()
    judged, name = judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS))
    rows = {r["doc_id"]: r[name] for r in judged.collect()}
    sample = likelihood._labelled(spark.createDataFrame(labels, LABELS), 10_000).collect()
    asked = [(r["good"], rows[r["id"]]["term_score"]) for r in sample if r["held"] or not r["good"]]
    cut = likelihood._cut(spark.createDataFrame(asked, "good boolean, s double"), "s", 5.0)

    def gain(at):
        good, bad = [s for g, s in asked if g], [s for g, s in asked if not g]
        n, p, z = len(good), sum(s < at for s in good) / len(good), 2
        upper = (p + z * z / 2 / n + z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
        return sum(s < at for s in bad) / len(bad) - 5 * upper

    best = max(gain(k / 512) for k in range(-2000, 2000))
    assert best > 0 and math.isclose(gain(cut), best)
    bad = [(not g, s) for g, s in asked]
    assert likelihood._cut(spark.createDataFrame(bad, "good boolean, s double"), "s", 5.0) == -math.inf


def test_odd_rows_labels_and_tables(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(None, 1, 0), (1, None, None)], LABELS), spark.createDataFrame([(7, 1, 0)], LABELS),
                   spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, None, 1), (2, 1, None)], LABELS)):
        judged, name = judge(docs, labels)
        rows = judged.collect()
        assert judged.columns == docs.columns + [name] and set(CLASH) <= set(judged.columns)
        assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, ((i, t) for i, t, *_ in ROWS)))
        for r in rows:
            n, _, _, _, again = plain_counts(r["text"])
            assert r[name]["base_failed"] == (n < 50 or 2 * again > n) and not (r[name]["base_failed"] and r[name]["kept"])
        assert judge(docs.limit(0), labels)[0].count() == 0
    taken = docs.withColumn("rules", F.lit(1))
    assert judge(taken, none)[1] == "rules_" and kept(taken, none).columns == taken.columns


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"v{i % 5003}" for i in range(400_000))
    rows = [(1, long), (1, long), (2, long + " x"), (3, "short")]
    judged, name = judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(3, 0, 0)], LABELS))
    got = {(r["doc_id"], len(r["text"])): tuple(r[name][f] for f in FIELDS) for r in judged.collect()}
    assert got == {(i, len(t)): plain_counts(t) for i, t in rows} and judged.count() == 4


def test_registered_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_likelihood_rules"](spark, SF)
    rows = got.collect()
    assert {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in rows} == {i: plain_counts(t) for i, t in texts.items()}
    assert dict(got.dtypes)["kept"] == "boolean" and all(not (r["kept"] and r["base_failed"]) for r in rows)
