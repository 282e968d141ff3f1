"""Rule-based risk of a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths, text

# Weights of the rules and what they look for.
WEIGHTS = {"missing-test": 0.25, "large-change": 0.20, "config-or-dependency-change": 0.15, "public-api-change": 0.20, "todo-or-placeholder": 0.10, "debug-print": 0.10}
API = r"(?m)^[+-]\s*(def |class |async def |export |pub fn |pub struct |public )"
TODO = r"(?i)\b(TODO|FIXME|HACK|XXX|WORKAROUND)\b"
DEBUG = r"\b(print|console\.log|console\.warn|console\.error|console\.debug|System\.out\.println|fmt\.Println|log\.Println|println!|dbg!|dump\()"


def score(changes: DataFrame, files: str = "files", diff: str = "diff") -> DataFrame:
    """changes: files array<struct<path, content>>, diff. Adds hits by rule, risk, probability, level, prediction, confidence."""
    f, d = F.coalesce(files, F.array().cast("array<struct<path:string,content:string>>")), F.coalesce(diff, F.lit(""))
    names = F.transform(f, lambda x: x["path"])
    count = lambda test: F.size(F.filter(names, test))
    tests, configs, n = count(paths.is_test_pattern), count(paths.is_config_pattern), F.size(names)
    hits = {
        "missing-test": ((n - tests > 0) & (tests == 0)).cast("int"),
        "large-change": ((n > 5) | (diffs.additions(d) + diffs.deletions(d) > 200)).cast("int"),
        "config-or-dependency-change": ((configs > 0) & (configs <= n * 0.7)).cast("int"),
        "public-api-change": d.rlike(API).cast("int"),
        "todo-or-placeholder": F.size(F.filter(f, lambda x: F.coalesce(x["content"].rlike(TODO), F.lit(False)))),
        "debug-print": F.size(F.filter(f, lambda x: F.coalesce(x["content"].rlike(DEBUG), F.lit(False)))),
    }
    risk = F.lit(0.0)
    for k, w in WEIGHTS.items():
        risk = risk + hits[k] * F.lit(w)
    found = changes.withColumns({k.replace("-", "_"): v for k, v in hits.items()}).withColumn("risk", F.round(F.least(risk, F.lit(1.0)), 6))
    return found.withColumns({
        "probability": F.greatest(F.round(1 - F.col("risk"), 4), F.lit(0.05)), "level": text.rule_band(F.col("risk")),
        "prediction": F.when(F.col("risk") >= 0.4, "not_merged").otherwise("merged"), "confidence": F.when(F.col("risk") >= 0.5, "high").when(F.col("risk") >= 0.25, "medium").otherwise("low"),
    })


def findings(scored: DataFrame, key: str) -> DataFrame:
    """One row per rule that fired."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k.replace("-", "_")).alias("hits")) for k in WEIGHTS])
    return scored.select(key, F.explode(F.filter(pairs, lambda x: x["hits"] > 0)).alias("x")).select(key, "x.rule", "x.hits")
