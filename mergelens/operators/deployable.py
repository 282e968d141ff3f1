"""Unified diffs to the 45 figures that a stored model takes, and the checks of a model against their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths
from mergelens.operators import requests, structure

# The figures in a model's order.
NAMES = [
    "num_changed_files", "total_additions", "total_deletions",
    "code_churn", "net_lines", "additions_per_file", "deletions_per_file",
    "large_pr_flag",
    "num_code_files", "num_doc_files", "num_config_files", "num_test_files",
    "test_file_ratio", "code_file_ratio", "doc_file_ratio",
    "has_py", "has_go", "has_js", "has_ts", "has_rs",
    "ast_total_nodes", "ast_max_depth", "ast_files_parsed",
    "ast_files_attempted", "ast_parse_success_rate", "ast_error_node_count",
    "ast_func_def_count", "ast_class_def_count", "ast_if_count",
    "ast_loop_count", "ast_try_count", "ast_return_count",
    "ast_assignment_count",
    "cfg_total_nodes", "cfg_total_edges", "cfg_branch_nodes",
    "cfg_loop_nodes", "cfg_exit_nodes", "cfg_cyclomatic_complexity",
    "cfg_max_branch_depth", "cfg_avg_out_degree", "cfg_files_processed",
    "cfg_files_with_cfg", "ast_missing", "cfg_missing",
]


def _let(value: Column, then) -> Column:
    """then(value) with the value made once, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def changed_files(diff) -> Column:
    """array<struct<path, added array<string>>> in order of first mention: both a "diff --git" line and a "+++ b/" line set the file that the added
    lines after it belong to. The lines between two such headers are one slice, so time is linear in the diff's lines; only where a path comes back
    after another, slices are gathered by path."""
    header = lambda x: F.regexp_extract(x, r"^diff --git a/(.+) b/(.+)$", 2)
    path = lambda x: F.when(x.startswith("+++ b/"), F.substring(x, 7, 1 << 30)).when(x.startswith("diff --git "), F.nullif(header(x), F.lit("")))
    telling = F.filter(diffs.lines(diff), lambda x: x.startswith("+++ b/") | x.rlike("^diff --git a/.+ b/.+$") | (x.startswith("+") & ~x.startswith("+++")))

    def cut(lines, paths, heads):
        def block(at, k):
            end = F.coalesce(F.get(heads, k + 1), F.size(lines))
            added = F.transform(F.slice(lines, at + 2, end - at - 1), lambda x: F.substring(x, 2, 1 << 30))
            return F.struct(F.get(paths, at).alias("path"), added.alias("added"))

        return F.transform(heads, block)

    def gathered(blocks):
        names = F.array_distinct(F.transform(blocks, lambda b: b["path"]))
        each = F.transform(names, lambda n: F.struct(n.alias("path"), F.flatten(F.transform(F.filter(blocks, lambda b: b["path"] == n), lambda b: b["added"])).alias("added")))
        return F.when(F.size(names) == F.size(blocks), blocks).otherwise(each)

    def without_doubles(blocks):
        """A header without lines before one of the same file says nothing."""
        return F.filter(blocks, lambda b, k: (F.size(b["added"]) > 0) | ~F.coalesce(F.get(blocks, k + 1)["path"] == b["path"], F.lit(False)))

    places = lambda paths: F.filter(F.transform(paths, lambda p, i: F.when(p.isNotNull(), i)), lambda i: i.isNotNull())
    blocks = _let(telling, lambda lines: _let(F.transform(lines, path), lambda paths: _let(places(paths), lambda heads: cut(lines, paths, heads))))
    return _let(_let(blocks, without_doubles), gathered)


def features(changes: DataFrame, threshold: float, key: str = "pr_id", diff: str = "diff") -> DataFrame:
    """key and the figures of NAMES; a diff without files has none of its own and is left out."""
    own = changes.select(key, diffs.additions(F.col(diff)).alias("total_additions"), diffs.deletions(F.col(diff)).alias("total_deletions"), changed_files(F.col(diff)).alias("files")).where(F.size("files") > 0)
    files = own.select(key, F.explode("files").alias("f")).select(key, F.col("f.path").alias("path"), F.array_join("f.added", "\n").alias("code"), (F.size("f.added") > 0).alias("has_patch"), paths.suffix(F.col("f.path")).alias("ext"))
    parsed = structure.census(files).withColumn("x", F.when((paths.kind(F.col("path")) == "code") & F.col("has_patch"), structure.flow(F.col("code"), F.col("ext"))))
    some, p = F.col("x").isNotNull(), F.col("path")
    add = lambda c: F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0)).cast("double")
    kind, s = paths.kind(p), F.col("ext")
    of = {f"num_{k}_files": F.count_if(kind == k).cast("double") for k in ("code", "doc", "config")} | {"num_test_files": F.count_if(paths.is_test(p)).cast("double")}
    has = {"has_py": [".py"], "has_go": [".go"], "has_js": [".js", ".jsx"], "has_ts": [".ts", ".tsx"], "has_rs": [".rs"]}
    tried, ok, drawn = F.count_if(some), F.count_if(some & F.col("success")), F.count_if(some & (F.col("x.nodes") > 0))
    names = {"func_def": "func_def", "class_def": "class_def", "if": "if_nodes", "loop": "loop_nodes", "try": "try_nodes", "return": "return_nodes", "assignment": "assignment_nodes"}
    sums = of | {f"{k}_file_ratio": of[f"num_{k}_files"] / F.count("*") for k in ("test", "code", "doc")} | {k: F.max(s.isin(e).cast("double")) for k, e in has.items()}
    sums |= {"ast_total_nodes": add("total_nodes"), "ast_max_depth": add("max_depth"), "ast_files_parsed": ok.cast("double"), "ast_files_attempted": tried.cast("double"), "ast_parse_success_rate": F.round(ok / F.greatest(tried, F.lit(1)), 4), "ast_error_node_count": F.lit(0.0)}
    sums |= {f"ast_{k}_count": add(c) for k, c in names.items()}
    sums |= {"cfg_total_nodes": add("x.nodes"), "cfg_total_edges": add("x.edges"), "cfg_branch_nodes": add("x.branches"), "cfg_loop_nodes": add("x.loops"), "cfg_exit_nodes": add("x.exits"), "cfg_cyclomatic_complexity": add("x.cyclomatic"), "cfg_max_branch_depth": F.coalesce(F.max("x.max_depth"), F.lit(0)).cast("double")}
    sums |= {"cfg_avg_out_degree": F.round(add("x.edges") / F.greatest(add("x.nodes"), F.lit(1.0)), 4), "cfg_files_processed": tried.cast("double"), "cfg_files_with_cfg": drawn.cast("double"), "ast_missing": (ok == 0).cast("double"), "cfg_missing": (drawn == 0).cast("double"), "num_changed_files": F.count("*").cast("double")}
    rolled = parsed.groupBy(key).agg(*[v.alias(k) for k, v in sums.items()])
    whole = requests.derived(rolled.join(own.drop("files"), key))
    return whole.withColumn("large_pr_flag", (F.col("code_churn") > threshold).cast("double")).select(key, *[F.col(c).cast("double").alias(c) for c in NAMES])


def compatible(names: list[str], contract: list[str] = NAMES) -> dict:
    """How a model's names stand to those that can be given: it fits only if they are the same in the same order."""
    return {"fits": names == contract, "missing": [c for c in names if c not in contract], "unused": [c for c in contract if c not in names], "same_order": [c for c in names if c in contract] == [c for c in contract if c in names]}


def availability(names: DataFrame, known: dict[str, str], name: str = "name") -> DataFrame:
    """Names by what can be had of them: supported, derived, unavailable, or unknown."""
    table = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    return names.groupBy(F.coalesce(table[F.col(name)], F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
