"""Classification metrics by group: aggregates, and running sums over the distinct scores that no task has to hold for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.operators import ranks


def ratio(a, b) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, by: list[str], label: str = "label", guess: str = "guess") -> DataFrame:
    y, p = F.col(label) == 1, F.col(guess) == 1
    return rows.groupBy(*by).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def rates(counts: DataFrame, digits: int = 6) -> DataFrame:
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    named = {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": precision, "recall": recall, "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": specificity, "npv": ratio(tn, tn + fn), "fpr": ratio(fp, fp + tn), "balanced_accuracy": (recall + specificity) / 2,
    }
    return counts.withColumns({k: F.round(v, digits) for k, v in named.items()})


def roc_auc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score", null_as_half: bool = False, digits: int | None = 6) -> DataFrame:
    """By mid-ranks over the distinct scores; null where a group has one class only."""
    s = F.coalesce(score, F.lit(0.5)) if null_as_half else F.col(score)
    bins = rows.select(*by, s.alias("s"), F.col(label).alias("y")).where("s is not null").groupBy(*by, "s").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    ranked = ranks.running(bins, by, ["s"], {"n": F.col("n")}).withColumn("mid", F.col("before_n") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"), F.sum(F.col("mid") * F.col("p")).alias("ranks"))
    area = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg"))
    return sums.select(*by, (area if digits is None else F.round(area, digits)).alias("roc_auc"))


def _thresholds(rows: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """by, threshold, p and n of each distinct score, with their sums over the higher ones and over the group."""
    bins = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    return ranks.running(bins, by, [F.desc("threshold")], {"p": F.col("p"), "n": F.col("n")})


def roc_points(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    p, n = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    return _thresholds(rows, by, label, score).select(*by, "threshold", F.round(ratio(p, F.col("all_p")), 6).alias("tpr"), F.round(ratio(n - p, F.col("all_n") - F.col("all_p")), 6).alias("fpr"))


def pr_auc(rows: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Average precision over distinct scores."""
    p, n = F.col("before_p") + F.col("p"), F.col("before_n") + F.col("n")
    steps = _thresholds(rows, by, label, score).select(*by, "p", ratio(p, n).alias("precision"))
    return steps.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p").cast("double")), 6).alias("pr_auc"))


def composite(metrics: DataFrame) -> DataFrame:
    """The weighted score of a combination (fixed weights)."""
    value = 0.35 * F.col("roc_auc") + 0.30 * F.col("specificity") + 0.20 * F.col("balanced_accuracy") + 0.15 * F.col("f1")
    return metrics.withColumn("composite", F.round(value, 6))
