"""Reviews as a service does them: requests checked, a ready model chosen, findings and records of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.operators import rules

# Severities of the rules.
SEVERITY = {"missing-test": "major", "large-change": "major", "config-or-dependency-change": "major", "public-api-change": "blocker", "todo-or-placeholder": "minor", "debug-print": "minor"}


def invalid(kind, contents, diff, line=None, probability=None, most=None) -> Column:
    """Why a request cannot be served, or null. contents: array of the files' texts."""
    empty = F.coalesce(F.forall(contents, lambda c: c.isNull()), F.lit(True))
    found = F.when((kind == "file") & empty, "kind=file requires at least one file with content").when((kind == "git_diff") & (F.coalesce(diff, F.lit("")) == ""), "kind=git_diff requires non-empty diff")
    if line is not None:
        found = found.when(line < 1, "line must be positive or null")
    if probability is not None:
        found = found.when((probability < 0) | (probability > 1), "probability must be between 0 and 1")
    if most is not None:
        found = found.when((most < 1) | (most > 100_000), "max_chars must be between 1 and 100000")
    return found


def first_hits(files: DataFrame, pattern: str, path: str = "path", content: str = "content") -> DataFrame:
    """Of each file with a hit the number of its first line that has one."""
    lines = F.split(F.col(content), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), F.lit(True))
    return files.withColumn("line", at.cast("int")).where("line > 0")


def comments(scored: DataFrame, key: str = "pr_id", files: str = "files") -> DataFrame:
    """One row per rule that fired, and for marks and debug output per file with a hit: severity, file, line. As file every comment has the
    change's first path; hit_file is where the hit is."""
    f = F.col(files)

    def by_file(name, severity, pattern):
        line = lambda x: F.array_position(F.transform(F.split(F.coalesce(x["content"], F.lit("")), "\n"), lambda y: y.rlike(pattern)), F.lit(True)).cast("int")
        return F.transform(F.filter(f, lambda x: F.coalesce(x["content"].rlike(pattern), F.lit(False))), lambda x: F.struct(name, severity, x["path"].alias("hit_file"), line(x).alias("line")))

    found = []
    for rule in rules.WEIGHTS:
        severity, name = F.lit(SEVERITY[rule]).alias("severity"), F.lit(rule).alias("rule")
        if rule in ("todo-or-placeholder", "debug-print"):
            found.append(by_file(name, severity, rules.TODO if rule == "todo-or-placeholder" else rules.DEBUG))
        else:
            found.append(F.when(F.col(rule.replace("-", "_")) > 0, F.array(F.struct(name, severity, F.lit(None).cast("string").alias("hit_file"), F.lit(None).cast("int").alias("line")))).otherwise(F.array().cast("array<struct<rule:string,severity:string,hit_file:string,line:int>>")))
    first = F.coalesce(F.element_at(f, 1)["path"], F.lit("general"))
    return scored.select(key, first.alias("file"), F.explode(F.concat(*found)).alias("x")).select(key, "file", "x.*")


def choose(models: DataFrame, wanted: str = "auto") -> DataFrame:
    """models: id, kind, ready. The wanted one, or for auto the first that is ready by kind: language model, forest, SVM, rules."""
    if wanted != "auto":
        return models.where(F.col("id") == wanted)
    order = F.array_position(F.array(*map(F.lit, ("llm", "rf", "svm", "rules"))), F.col("kind"))
    return models.where(F.col("ready") & (order > 0)).orderBy(order, "id").limit(1)


def history_id(request_id, time) -> Column:
    """Time to the second and six digits of a hash of the request: the same request at the same second has one id, so a retry adds none."""
    return F.concat(F.date_format(time, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.sha2(request_id.cast("string"), 256), 1, 6))


def records(reviews: DataFrame, store_source: bool = False) -> DataFrame:
    """History rows of reviews (request_id, time, model_id, kind, error, files, diff and figures): a failed one keeps 500 characters of its error;
    sources only if asked for, 4000 characters of the diff and 2000 of each of the first five files, by path; of two with one path the last."""
    failed = F.col("error").isNotNull()
    own = history_id(F.col("request_id"), F.col("time"))
    status = F.when(failed, "failed").otherwise("completed")
    kept = [c for c in reviews.columns if c not in ("error", "files", "diff", "time")]
    out = reviews.select(own.alias("history_id"), F.substring(own, 1, 15).alias("timestamp"), *kept, status.alias("status"), F.substring("error", 1, 500).alias("error"), *(["files", "diff"] if store_source else []))
    if not store_source:
        return out
    some = F.filter(F.slice("files", 1, 5), lambda x: x["content"].isNotNull())
    last = F.filter(some, lambda x, i: ~F.exists(F.slice(some, i + 2, F.lit(5)), lambda y: y["path"] == x["path"]))
    return out.withColumns({"source_diff": F.when(~failed, F.substring("diff", 1, 4000)), "source_files": F.when(~failed, F.map_from_entries(F.transform(last, lambda x: F.struct(x["path"], F.substring(x["content"], 1, 2000)))))}).drop("files", "diff")


def review(requests: DataFrame, store_source: bool = False) -> DataFrame:
    """Requests (request_id, time, kind, files, diff) checked and scored by the rules; history rows of those that can be served and of those that can't."""
    checked = requests.withColumn("error", invalid(F.col("kind"), F.transform("files", lambda f: f["content"]), F.col("diff")))
    scored = rules.score(checked, F.col("files"), F.col("diff"))
    figures = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("prediction", "probability", "confidence", "level")}
    wanted = scored.select("request_id", "time", F.lit("rules").alias("model_id"), "kind", F.size("files").alias("changed_files"), F.sha2(F.coalesce("diff", F.lit("")), 256).alias("content_sha256"), *[v.alias(k) for k, v in figures.items()], "error", "files", "diff")
    return records(wanted, store_source)
