"""Change requests: five child tables joined to one bundle, bundles to flat rows, filters, keys, unions of seeds and new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelens.functions import diffs, signals, text

DETAIL = ["pr_id", "pr_number", "repo", "title", "body", "author", "created_at", "merged", "state"]


def bundle(detail: DataFrame, reviews: DataFrame, comments: DataFrame, files: DataFrame, commits: DataFrame, labels: DataFrame, key: str = "pr_id", order: str = "pos") -> DataFrame:
    """One row per request with its children as arrays in order; a request without some has an empty array. Each child is grouped before
    its join, so no join multiplies rows."""
    out = detail
    for name, child in (("reviews", reviews), ("review_comments", comments), ("files", files), ("commits", commits), ("labels", labels)):
        rest = [c for c in child.columns if c != key]
        rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias(name))
        out = out.join(rows, key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    return out


def majority(states) -> Column:
    n = lambda s: F.size(F.filter(states, lambda x: x == s))
    return F.when(F.size(states) == 0, "NONE").when((n("APPROVED") >= n("CHANGES_REQUESTED")) & (n("APPROVED") > 0), "APPROVED").when(n("CHANGES_REQUESTED") > n("APPROVED"), "CHANGES_REQUESTED").otherwise("COMMENTED")


def first_decisive(states) -> Column:
    """The first approval or request for changes; else COMMENTED, or NONE without any state."""
    decisive = F.filter(states, lambda x: x.isin("APPROVED", "CHANGES_REQUESTED"))
    return F.when(F.size(decisive) > 0, F.element_at(decisive, 1)).when(F.size(states) > 0, "COMMENTED").otherwise("NONE")


def headline(message) -> Column:
    return F.element_at(F.split(F.trim(F.coalesce(message, F.lit(""))), "\n"), 1)


def project(bundles: DataFrame, variant: str = "v1") -> DataFrame:
    """A flat row per bundle. v1: decision by majority, reviews counted alone, lists joined by commas; v2: the first decisive review,
    reviews and inline comments counted together, lists joined by comma and blank, numbers of both, and the reason of detection."""
    sep = "," if variant == "v1" else ", "
    c = F.col
    states = F.filter(F.transform("reviews", lambda r: r["state"]), lambda s: s.isNotNull() & (s != ""))
    logins = F.array_distinct(F.filter(F.transform("reviews", lambda r: r["login"]), lambda s: s.isNotNull() & (s != "")))
    said = F.transform(F.filter("reviews", lambda r: F.trim(F.coalesce(r["body"], F.lit(""))) != ""), lambda r: F.concat(F.lit("[Review by "), F.coalesce(r["login"], F.lit("")), F.lit("]: "), F.trim(r["body"])))
    inline = F.transform(F.filter("review_comments", lambda r: F.trim(F.coalesce(r["body"], F.lit(""))) != ""), lambda r: F.concat(F.lit("[Inline on "), F.coalesce(r["path"], F.lit("")), F.lit(" L"), F.coalesce(r["line"].cast("string"), F.lit("None")), F.lit("]: "), F.trim(r["body"])))
    names, labels = F.transform("files", lambda f: f["path"]), F.transform("labels", lambda x: x["name"])
    total = lambda k: F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f[k].cast("long"), F.lit(0)))
    bodies = F.concat(F.transform("reviews", lambda r: r["body"]), F.transform("review_comments", lambda r: r["body"]))
    functions = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("files", lambda f: diffs.modified_functions(F.coalesce(f["patch"], F.lit(""))))))), sep)
    messages = F.array_join(F.transform("commits", lambda m: headline(m["message"])), " | ")
    title, body = text.safe(c("title")), text.safe(c("body"))
    merged = F.coalesce(c("merged"), F.lit(False))
    reviews, comments = F.size("reviews"), F.size("review_comments")
    base = {
        "pr_id": c("pr_id"), "pr_number": c("pr_number"), "repo": text.safe(c("repo")), "title": text.escape_newlines(title, 500), "body": text.escape_newlines(body, 3000),
        "pr_length": (F.length(title) + F.length(body)).cast("long"), "author": text.safe(c("author")), "created_at": c("created_at"), "is_merged": merged,
        "merge_status": F.when(merged, "merged").when(c("state") == "closed", "closed_not_merged").otherwise(F.coalesce("state", F.lit("unknown"))),
        "num_reviewers": F.size(logins).cast("long"), "review_decision": majority(states) if variant == "v1" else first_decisive(states),
        "num_review_comments": (reviews if variant == "v1" else reviews + comments).cast("long"), "num_inline_comments": comments.cast("long"),
        "review_comments_text": text.escape_newlines(F.array_join(F.concat(said, inline), " | "), 3000), "num_changed_files": F.size("files").cast("long"),
        "total_additions": total("additions"), "total_deletions": total("deletions"), "modified_functions": F.substring(functions, 1, 2000), "num_commits": F.size("commits").cast("long"),
        "commit_messages": text.escape_newlines(messages, 2000), "changed_files_list": F.substring(F.array_join(names, sep), 1, 2000), "num_labels": F.size("labels").cast("long"),
        "label_names": F.array_join(labels, sep), "has_ai_reviewer": signals.reviewer(bodies, labels), "has_ai_generated_code": signals.generated(c("body"), labels),
    }
    flat = bundles.select(*[v.alias(k) for k, v in base.items()])
    if variant == "v1":
        return flat
    found = signals.detection({k: F.col(k) for k in signals.FIELDS})
    return flat.withColumns({"n_reviews": F.col("num_review_comments") - F.col("num_inline_comments"), "detection": found}).withColumns({
        "has_ai_generated_code": F.col("detection.found"), "ai_detection_reason": F.col("detection.reason"), "churn": F.col("total_additions") + F.col("total_deletions"),
    }).drop("detection")


def written_by_people(rows: DataFrame) -> DataFrame:
    """Requests of known outcome without signs of generated code, with keys, files and sane numbers."""
    return rows.where(
        ~F.col("has_ai_generated_code") & F.col("merge_status").isin("merged", "closed_not_merged") & F.col("pr_id").isNotNull() & F.col("repo").isNotNull()
        & F.col("is_merged").isNotNull() & (F.col("num_changed_files") > 0) & (F.col("total_additions") >= 0) & (F.col("total_deletions") >= 0)
    )


def has_review(c) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none")


def composite_key(repo, number) -> Column:
    return F.struct(F.trim(F.coalesce(repo, F.lit(""))).alias("repo"), F.coalesce(number.cast("string").try_cast("double").cast("long"), F.lit(0)).alias("number"))


def lenient_float(c) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(float("nan")))


def as_text(c, kind: str) -> Column:
    """A value as a table of text has it: True and False, nothing for null or nested values."""
    if kind.startswith(("array", "map", "struct")):
        return F.lit("")
    return F.coalesce(F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string"), F.lit(""))


def derived(rows: DataFrame) -> DataFrame:
    """Churn, net lines and figures by file; a request without files counts as one file."""
    a, d, n = (F.coalesce(F.col(x), F.lit(0)) for x in ("total_additions", "total_deletions", "num_changed_files"))
    files = F.greatest(n, F.lit(1))
    more = {"code_churn": a + d, "net_lines": a - d, "additions_per_file": F.round(a / files, 6), "deletions_per_file": F.round(d / files, 6)}
    if "num_review_comments" in rows.columns:
        more["review_intensity"] = F.round((F.col("num_review_comments") + F.col("num_inline_comments")) / files, 6)
    return rows.withColumns(more)


def file_counts(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Files of each kind by request, with their shares and languages."""
    from mergelens.functions import paths

    p = F.col(path)
    kind, s, n = paths.kind(p), paths.suffix(p), F.count("*")
    of = {f"num_{k}_files": F.count_if(kind == k) for k in ("code", "doc", "config", "other")} | {"num_test_files": F.count_if(paths.is_test(p))}
    has = {"has_py": [".py"], "has_go": [".go"], "has_js": [".js", ".jsx"], "has_ts": [".ts", ".tsx"], "has_rs": [".rs"]}
    shares = {f"{k}_file_ratio": F.round(of[f"num_{k}_files"] / n, 6) for k in ("test", "code", "doc")}
    return files.groupBy(key).agg(n.alias("files"), *[v.alias(k) for k, v in (of | shares).items()], *[F.max(s.isin(e).cast("int")).alias(k) for k, e in has.items()])


def unseen(rows: DataFrame, seed: DataFrame, keys: list[str], other: str) -> DataFrame:
    """rows that share neither the composite key nor the other key with the seed."""
    return rows.join(seed.select(*keys), keys, "left_anti").join(seed.select(other).where(F.col(other).isNotNull()), other, "left_anti").select(rows.columns)


def enhanced(seed: DataFrame, new: DataFrame, keys: list[str], other: str, least: int = 150) -> DataFrame:
    """All seed rows and then new ones with unseen keys, tagged; the seed alone where the whole has fewer than `least` rows."""
    both = seed.withColumn("origin", F.lit("seed")).unionByName(unseen(new, seed, keys, other).withColumn("origin", F.lit("new")))
    total = both.agg((F.count("*") < least).alias("_few"))  # one row
    return both.join(F.broadcast(total)).where((F.col("origin") == "seed") | ~F.col("_few")).drop("_few")


def key_union(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (t.select(*keys) for t in tables)).distinct()


def merge_indexes(known: DataFrame, more: DataFrame, key: str, files: str = "files") -> DataFrame:
    """One entry per key: the known one if there is one; entries without files are left out."""
    tagged = known.withColumn("_turn", F.lit(0)).unionByName(more.withColumn("_turn", F.lit(1))).where(F.size(files) > 0)
    return tagged.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_turn"))).where("_r = 1").drop("_turn", "_r")


def rebuilt(rows: DataFrame, extra: DataFrame, group: str, large: str, cap: int, keys: list[str], order: list) -> DataFrame:
    """rows with one group cut to its cap in drawn order, extra rows after them, and of equal keys the first."""
    w = Window.partitionBy(group).orderBy(*order)
    kept = rows.withColumn("_r", F.row_number().over(w)).where((F.col(group) != large) | (F.col("_r") <= cap)).drop("_r")
    both = kept.withColumn("_turn", F.lit(0)).unionByName(extra.withColumn("_turn", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_turn", *order))).where("_r = 1").drop("_turn", "_r")


def attach(rows: DataFrame, more: DataFrame, key: str, columns: list[str], order: list) -> DataFrame:
    """Columns of the first match by key; what rows have themselves stays."""
    first = more.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(first, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def harvest(listed: DataFrame, known: DataFrame, groups: list[list[str]], cap: int, key: str = "number", group: str = "repo", draw=None) -> DataFrame:
    """Listed requests whose text has any word of any group of key words, once each, without known ones, at most cap of a repository in drawn order."""
    hit = reduce(lambda a, b: a | b, (signals.holds_any(F.col("text"), g) for g in groups))
    fresh = listed.where(hit).dropDuplicates([group, key]).join(known.select(group, key), [group, key], "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*(draw or [F.desc(key)])))).where(F.col("_r") <= cap).drop("_r")
