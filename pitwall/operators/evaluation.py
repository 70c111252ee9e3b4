"""Splits, folds, class weights and classification metrics.

Scored rows have a 0/1 label and a probability. Curves are built on distinct
probabilities, so ties are handled exactly and a heavily repeated score becomes
one row before anything is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitwall.operators.ordering import rank, running, top_k
from pitwall.plans.lake import cut, small

EPS = 2.220446049250313e-16  # smallest clip a log loss uses


# -- scaling --------------------------------------------------------------
def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zero mean and unit (population) deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(float(stats[f"__m_{c}"]))) / F.lit(float(stats[f"__s_{c}"]) or 1.0)
                           for c in cols})


def softmax(df: DataFrame, by: str, score: str, name: str) -> DataFrame:
    """Shares per date, shifted by the date's maximum to stay finite."""
    df = cut(df)  # read three times below
    top = small(df.groupBy(by).agg(F.max(score).alias("__top")))
    raised = df.join(top, by).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = small(raised.groupBy(by).agg(F.sum("__e").alias("__total")))
    return raised.join(total, by).withColumn(name, F.col("__e") / F.col("__total")).drop("__e", "__top", "__total")


# -- splits ---------------------------------------------------------------
def _year(at: str = "dt_ref") -> Column:
    return F.year(at)


def two_class_year(df: DataFrame, target: str, at: str = "dt_ref") -> int | None:
    """Newest year with both classes, else the newest year."""
    per = df.groupBy(_year(at).alias("y")).agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    row = per.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("y"))), F.max("y")).first()
    return row[0] if row[0] is not None else row[1]


def late_dates(df: DataFrame, drop_last: int = 5, at: str = "dt_ref", longer_than: int = 5) -> DataFrame:
    """The last ``drop_last`` dates of each year; none unless some year has more than ``longer_than`` dates."""
    days = df.select(_year(at).alias("year"), at).distinct()
    longest = days.groupBy("year").count().agg(F.max("count")).first()[0] or 0
    return top_k(days, ["year"], [F.col(at).desc()], drop_last if longest > longer_than else 0)


def recency(df: DataFrame, at: str = "dt_ref") -> DataFrame:
    """0-based recency of each date within its year."""
    from pyspark.sql import Window as W
    days = df.select(_year(at).alias("year"), at).distinct()
    w = W.partitionBy("year").orderBy(F.col(at).desc())
    return days.withColumn("recency", F.row_number().over(w) - 1)


def split(df: DataFrame, target: str, oot_years: list[int] | int | None = None,
          drop_last: int = 5, at: str = "dt_ref", longer_than: int = 5) -> DataFrame:
    """Add ``split``: out-of-time years, the test year before them, earlier training.

    Training leaves out the last ``drop_last`` dates of each year (0 keeps all), if
    some training year has more than ``longer_than`` dates.
    Rows after the first out-of-time year that are not in it are dropped.
    """
    if oot_years is None:
        oot_years = [two_class_year(df, target, at)]
    elif isinstance(oot_years, int):
        oot_years = [oot_years]
    year = _year(at)
    rest = df.where(year < min(oot_years))
    test_year = two_class_year(rest, target, at)
    name = (F.when(year.isin(oot_years), "oot").when(year >= min(oot_years), None)
            .when(year == test_year, "test").when(year < test_year, "train"))
    out = df.withColumn("split", name).where(F.col("split").isNotNull())
    if drop_last:
        late = late_dates(out.where("split = 'train'"), drop_last, at, longer_than).select(at, F.lit("train").alias("split"))
        out = out.join(small(late), [at, "split"], "left_anti")
    return out


def fold_years(years: list[int], n_splits: int = 5) -> list[int]:
    """Validation years of an expanding window: each fold trains on all earlier years."""
    years = sorted(set(years))
    n = min(n_splits, max(2, len(years) - 1))
    return years[-n:]


def folds(df: DataFrame, n_splits: int = 5, at: str = "dt_ref") -> DataFrame:
    """One row per (row, fold, role)."""
    years = [r[0] for r in df.select(_year(at)).distinct().collect()]
    val = fold_years(years, n_splits)
    spec = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(y).alias("val_year")) for i, y in enumerate(val)])
    out = df.withColumn("__f", F.explode(spec)).where(_year(at) <= F.col("__f.val_year"))
    role = F.when(_year(at) < F.col("__f.val_year"), "train").otherwise("validation")
    return out.withColumns({"fold": F.col("__f.fold"), "role": role}).drop("__f")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    pos = F.sum(F.col(target).cast("bigint"))
    n = F.count(target)
    return df.agg(pos.alias("n_pos"), (n - pos).alias("n_neg"),
                  F.coalesce((n - pos).cast("double") / F.nullif(pos, F.lit(0)), F.lit(1.0)).alias("ratio"),
                  (pos.cast("double") / F.nullif(n, F.lit(0))).alias("rate"))


def with_class_weight(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """n / (2 * n_class): both classes weigh the same in total."""
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n"))
    per = small(per.where(F.col(target).isNotNull()))
    n = df.where(F.col(target).isNotNull()).count()
    return df.join(per, target).withColumn(name, F.lit(float(n)) / (2 * F.col("__n"))).drop("__n")


def balanced_copies(df: DataFrame, target: str, counts: dict) -> tuple[DataFrame, float]:
    """Rows for a forest whose every tree draws as many rows of one class as of the other, and the factor of its draw.

    A tree takes a row a Poisson number of times. Copies of a row add up to a Poisson
    number with as many times the mean, so with the rarer class copied n_more / n_fewer
    times and all means lowered to n_fewer / n_more of what was asked, a row of the rarer
    class is drawn as often as asked and the commoner class gives as many draws in all.
    Every tree has its own draw and all trees share one pass. A broken number of copies is
    spread by a hash of the row, so there are at most twice as many rows as before.
    """
    if len(counts) < 2:
        return df, 1.0
    rare, fewer = min(counts.items(), key=lambda kv: (kv[1], kv[0]))
    times = max(counts.values()) / fewer
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.lit(times) + spread).cast("int")
    several = F.when(F.col(target) == rare, F.sequence(F.lit(1), copies)).otherwise(F.array(F.lit(1)))
    return df.withColumn("__copy", F.explode(several)).drop("__copy"), 1.0 / times


def grouped_holdout(df: DataFrame, target: str, keys: list[str], share: float = 0.2) -> DataFrame:
    """Hold out a share of whole groups per class, by a stable hash of the key."""
    label = df.groupBy(*keys).agg(F.max(target).alias("__class"))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("__class").cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1000
    chosen = label.select(*keys, F.when(bucket < share * 1000, "test").otherwise("train").alias("split"))
    return df.join(chosen, keys)


# -- metrics --------------------------------------------------------------
def _by_score(scored: DataFrame, label: str, prob: str, by: list[str]) -> DataFrame:
    return scored.groupBy(*by, F.col(prob).alias("p")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def curve_points(scored: DataFrame, label: str, prob: str, by: list[str] = [],
                 limit: int | None = None) -> DataFrame:
    """True and false positives at each distinct threshold, highest first."""
    per = cut(_by_score(scored.where(F.col(label).isNotNull()), label, prob, by))
    cum = running(per, by, [F.col("p").desc_nulls_last()], {"tp": F.col("pos"), "fp": F.col("neg")}, limit)
    ends = per.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        cum = cum.join(small(ends), by)
    else:
        cum = cum.withColumns({c: F.lit(v).cast("bigint") for c, v in ends.first().asDict().items()})
    return cum.withColumns({
        "fpr": F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0)).cast("double"),
        "tpr": F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0)).cast("double"),
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"),
    })


def ranking_metrics(scored: DataFrame, label: str, prob: str, by: list[str] = [],
                    limit: int | None = None) -> DataFrame:
    """ROC-AUC with ties averaged and PR-AUC as average precision; NULL for one class."""
    pts = curve_points(scored, label, prob, by, limit)
    wins = F.sum((F.col("tp") - F.col("pos") / 2.0) * F.col("neg"))
    both = F.col("n_pos").cast("double") * F.col("n_neg")  # no whole number holds it
    steps = F.sum(F.col("precision") * F.col("pos"))
    out = pts.groupBy(*by, "n_pos", "n_neg").agg(wins.alias("wins"), steps.alias("steps"))
    ok = both > 0
    return out.select(*by, F.when(ok, F.col("wins") / both).alias("roc_auc"),
                      F.when(ok, F.col("steps") / F.col("n_pos")).alias("pr_auc"))


def threshold_metrics(scored: DataFrame, label: str, prob: str, by: list[str] = []) -> DataFrame:
    """F1 at 0.5, log loss and Brier score in one pass."""
    y, p = F.col(label), F.col(prob)
    hit = (p >= 0.5).cast("int")
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    tp2 = 2.0 * F.sum(hit * y)
    return scored.where(y.isNotNull()).groupBy(*by).agg(
        F.coalesce(tp2 / F.nullif(F.sum(hit) + F.sum(y), F.lit(0)), F.lit(0.0)).alias("f1"),
        (-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.count(F.lit(1)).alias("n_samples"))


def confusion(scored: DataFrame, label: str, prob: str) -> DataFrame:
    """All four cells, also the empty ones."""
    y, hit = F.col(label), F.col(prob) >= 0.5
    one = scored.agg(*[F.count(F.when((y == a) & (hit.cast("int") == b), 1)).alias(f"c{a}{b}")
                       for a in (0, 1) for b in (0, 1)])
    cells = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("n"))
             for a in (0, 1) for b in (0, 1)]
    return one.select(F.inline(F.array(*cells)))


def top1_accuracy(scored: DataFrame, winners: DataFrame, key: str, prob: str, by: list[str] = [],
                  at: str = "dt_ref") -> DataFrame:
    """Share of events whose top pick won the season; seasons without a winner are left out."""
    picks = top_k(scored, [*by, at], [F.col(prob).desc_nulls_last(), F.col(key)], 1)
    known = small(winners.select("year", F.col(key).alias("__winner")))
    hit = (F.col(key) == F.col("__winner")).cast("double")
    return picks.withColumn("year", _year(at)).join(known, "year").groupBy(*by).agg(
        F.avg(hit).alias("top1_acc"), F.count(F.lit(1)).alias("n_events"))


def evaluate(scored: DataFrame, label: str, prob: str, by: list[str],
             winners: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """All metrics per group, one row each."""
    out = ranking_metrics(scored, label, prob, by).join(threshold_metrics(scored, label, prob, by), by)
    if winners is not None:
        out = out.join(top1_accuracy(scored, winners, key, prob, by).drop("n_events"), by, "left")
    return out


# -- model tables (one row per model and split) -------------------------------
HIGHER = ("roc_auc", "pr_auc", "f1", "top1_acc")
LOWER = ("log_loss", "brier")


def comparison(metrics: DataFrame, cols=HIGHER + LOWER) -> DataFrame:
    """One row per model with training, test and out-of-time columns."""
    return metrics.groupBy("model").agg(*[
        F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{c}_{s}") for s in ("train", "test", "oot") for c in cols])


def shading(metrics: DataFrame, cols: dict[str, bool]) -> DataFrame:
    """Opacity 0.1 to 0.5 by rank in the column's range, and the best flag."""
    ends = metrics.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = metrics
    for c, higher in cols.items():
        lo, hi = (F.lit(ends[f"{n}_{c}"]).cast("double") for n in ("lo", "hi"))
        at = (F.col(c) - lo) / F.nullif(hi - lo, F.lit(0))
        at = at if higher else 1 - at
        shade = F.when(F.col(c).isNull(), None).when(lo == hi, 0.25).otherwise(0.1 + 0.4 * at)
        best = F.coalesce((F.col(c) == (hi if higher else lo)).cast("int"), F.lit(0))
        out = out.withColumns({f"{c}_shade": shade, f"{c}_best": best})
    return out


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Descending rank, ties sharing their mean; NULL ranks as 0."""
    df = df.withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    ranked = rank(df, [], "__x", "__r")
    ties = small(df.groupBy("__x").agg(F.count(F.lit(1)).alias("__n")))
    return ranked.join(ties, "__x").withColumn(name, F.col("__r") + (F.col("__n") - 1) / 2.0).drop("__x", "__r", "__n")


def best_model(table: DataFrame, scoring: str = "average_precision") -> DataFrame:
    """The winning row: by one out-of-time score, or by the mean rank of two."""
    if scoring == "combined":
        table = average_rank(table, "pr_auc_oot", "__a")
        table = average_rank(table, "top1_acc_test", "__b")
        return table.withColumn("score", (F.col("__a") + F.col("__b")) / 2).drop("__a", "__b").orderBy(
            "score", "model").limit(1)
    col = {"average_precision": "pr_auc_oot", "roc_auc": "roc_auc_oot", "f1": "f1_oot"}[scoring]
    has = table.agg(F.count(col)).first()[0]
    chosen = F.col(col) if has else F.col("tuned_cv_score")
    return table.withColumn("score", F.coalesce(chosen, F.lit(0.0))).orderBy(F.desc("score"), "model").limit(1)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest non-final batch run of each model type."""
    own = runs.where((F.col("learning_mode") != "zero_shot") & (F.col("is_final") == 0))
    return top_k(own, ["model_type"], [F.col("started").desc(), F.col("run_id")], 1)


def default_run(runs: DataFrame) -> DataFrame:
    """The newest final run, else the newest run."""
    return runs.orderBy(F.desc("is_final"), F.desc("started"), "run_id").limit(1)
