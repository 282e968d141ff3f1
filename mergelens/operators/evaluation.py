"""Answers of models held against outcomes and real reviews: figures by combination, comments, examples, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import signals, text
from mergelens.operators import metrics, ranks

# Words of advice and of detail.
ACTION = [
    "add test", "add unit test", "write test", "clarify", "document", "split pr", "separate", "refactor", "explain", "justify",
    "benchmark", "measure", "check", "validate", "verify", "consider", "should", "must", "need to", "please",
]
DETAIL = ["file", "function", "method", "class", "line", "variable", "api", "interface", "module", "import", "return", "param"]
SEVERITIES = ["blocker", "major", "minor", "nit"]


def combos(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: label, guess, probability, parsed, duration. Figures of each combination over what parsed, and the share that did not."""
    fine = rows.where("parsed")
    counts = rows.groupBy(*by).agg(
        F.count_if("parsed").alias("n_valid"), F.count("*").alias("n_total"), F.round(F.avg((~F.col("parsed")).cast("int")), 4).alias("parse_fail_rate"),
        F.round(F.avg(F.when(F.col("parsed"), F.nanvl("probability", F.lit(None)))), 4).alias("avg_probability"), F.round(F.avg(F.when(F.col("parsed"), F.col("duration")))).alias("avg_duration"),
    )
    scored = metrics.rates(metrics.confusion(fine, by), 4).join(metrics.roc_auc(fine, by, score="probability"), by, "left")
    return counts.join(scored, by, "left").where("n_valid > 0")


def precision_words(candidate, reference) -> Column:
    """BLEU-1 without clipping or penalty: the share of words that the reference has."""
    known = F.array_distinct(reference)
    return F.when(F.size(candidate) > 0, F.size(F.filter(candidate, lambda w: F.array_contains(known, w))) / F.size(candidate))


def bigrams(tokens) -> Column:
    return F.array_distinct(F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))


def precision_rouge1(candidate, reference) -> Column:
    """Distinct common words by words of the candidate."""
    return F.when(F.size(candidate) > 0, F.size(F.array_intersect(candidate, reference)) / F.size(candidate))


def precision_rouge2(candidate, reference, empty: float | None = None) -> Column:
    """Distinct common pairs by distinct pairs of the candidate; `empty` without any."""
    own = bigrams(candidate)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, bigrams(reference))) / F.size(own)).otherwise(F.lit(empty).cast("double"))


def title_overlap(a, b) -> Column:
    """The share of a's distinct words that b has; 0 without words."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.lit(0.0))


def risk_coverage(factors, comments) -> Column:
    """The share of risk factors of which any word is in the comments; null without factors."""
    said = F.lower(F.array_join(comments, " "))
    covered = F.filter(factors, lambda f: F.exists(text.words(F.lower(f)), lambda w: said.contains(w)))
    return F.when(F.size(factors) > 0, F.size(covered) / F.size(factors))


def keyword_share(comments, some: list[str]) -> Column:
    """Words found in the comments, by comments, at most 1; null without comments."""
    said = F.lower(F.array_join(comments, " "))
    return F.when(F.size(comments) > 0, F.least(F.lit(1.0), F.size(F.filter(signals.words(some), lambda w: said.contains(w))) / F.size(comments)))


def comment_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: comments array<struct<severity, comment>>, factors, reference (the real review's text, null without). One row per method."""
    said = F.transform("comments", lambda c: F.coalesce(c["comment"], F.lit("")))
    own, real = text.lower_tokens(F.array_join(said, " ")), text.lower_tokens(F.coalesce("reference", F.lit("")))
    both = (F.size(real) > 0) & (F.size(own) > 0)
    level = lambda s: F.size(F.filter("comments", lambda c: (c["severity"] == s) if s != "nit" else ~F.coalesce(c["severity"], F.lit("minor")).isin("blocker", "major", "minor")))
    figures = rows.select(
        *by, F.size("comments").alias("n"), *[level(s).alias(s) for s in SEVERITIES], risk_coverage(F.col("factors"), said).alias("risk"), keyword_share(said, ACTION).alias("action"), keyword_share(said, DETAIL).alias("detail"),
        F.when(both, precision_words(own, real)).alias("bleu"), F.when(both, precision_rouge1(own, real)).alias("rouge1"), F.when(both, precision_rouge2(own, real)).alias("rouge2"), (F.size(real) > 0).alias("has_real"), both.alias("both"),
    )
    mean = lambda c: F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))
    total = F.sum("n")
    return figures.groupBy(*by).agg(
        *[mean(c).alias(f"avg_{name}") for c, name in (("bleu", "bleu"), ("rouge1", "rouge1"), ("rouge2", "rouge2"), ("risk", "risk_coverage"), ("action", "actionability"), ("detail", "specificity"))],
        F.count_if("has_real").alias("n_with_real"), F.count_if("both").alias("n_generated"), total.alias("total_comments"), *[F.sum(s).alias(f"{s}_count") for s in SEVERITIES],
        F.round((F.sum("blocker") + F.sum("major")) / F.greatest(total, F.lit(1)), 4).alias("blocker_major_ratio"), F.round(total / F.greatest(F.count_if("both"), F.lit(1)), 1).alias("avg_comments_per_pr"),
    )


def best_examples(rows: DataFrame, n: int, score: str = "bleu", key: str = "pr_id") -> DataFrame:
    """The n rows of the best score, long texts cut to 500 characters."""
    kinds = dict(rows.dtypes)
    return rows.orderBy(F.desc(score), key).limit(n).select(*[F.substring(c, 1, 500).alias(c) if kinds[c] == "string" and c != key else F.col(c) for c in rows.columns])


def compared(baseline: DataFrame, improved: DataFrame, fixed: str, columns: list[str]) -> DataFrame:
    """All combinations of two groups with differences to one fixed baseline, and whether they meet what is asked of them against it."""
    both = baseline.withColumn("group", F.lit("baseline")).unionByName(improved.withColumn("group", F.lit("improved")))
    base = baseline.where(F.col("combo") == fixed).select(*[F.col(c).alias(f"_{c}") for c in columns])  # one row
    out = both.join(F.broadcast(base)).withColumns({f"{c}_delta": F.round(F.col(c) - F.col(f"_{c}"), 4) for c in columns})
    meets = {"specificity": F.col("specificity") >= F.col("_specificity") + 0.20, "fpr": F.col("fpr") <= F.col("_fpr") - 0.20, "f1": F.col("f1") >= F.col("_f1") * 0.85}
    return out.withColumns({f"{k}_passed": v for k, v in meets.items() if k in columns}).drop(*[f"_{c}" for c in columns])


def warm_times(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Median and 95th percentile of a group's timings without its first run, selected by running counts; null timings do not count."""
    late = ranks.running(rows.select(group, order, value), [group], [order], {"one": F.lit(1)}).where("before_one > 0")
    found, n = ranks.counted(late, [group], value), F.col("all_n")
    at = F.least(F.floor(n * 0.95), n - 1)
    return found.groupBy(group).agg(F.max(n).alias("runs"), ranks.standing(F.floor(n / 2)).alias("median"), ranks.standing(at).alias("p95"))
