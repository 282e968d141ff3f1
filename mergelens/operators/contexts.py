"""Texts that tell a model of a change: base sections, checklist, policy of the repository, similar history, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.functions import paths, signals, text
from mergelens.operators.neighbours import similar

# Budgets in characters and tokens, key words.
DIFF, BODY, COMMITS, ADDED = 8000, 3000, 1500, 6000
TOKENS, RESERVED = 14_000, 2_000
TEMPLATES = 1000
CORE = ["public", "api", "export", "interface", "abstract", "core", "main", "init", "index"]
TRACES = ["copilot", "chatgpt", "gpt", "claude", "cursor", "codex", "generated by", "ai-generated", "code agent", "deepseek", "qwen", "generated with", "co-authored-by: copilot"]
DOCUMENTS = ["doc", "readme", "changelog", ".md", ".rst"]
CLOSED_FOR = ["test", "documentation", "breaking", "wip", "refactor", "draft", "dependency", "bump", "fail", "bug", "fix", "feature"]
POLICY = ["ai-generated", "ai policy", "no ai", "ban ai", "ai contribution", "generated code", "llm", "chatgpt", "copilot policy"]
FORBIDDEN = ["is_merged", "merge_status", "review_decision", "num_reviewers", "num_review_comments", "num_inline_comments", "review_comments_text"]
SUSPICIOUS = ["review_decision:", "review_decision=", "num_reviewers:", "num_reviewers=", "num_review_comments:", "num_review_comments=", "merge_status:", "merge_status="]


def lines_of(*parts) -> Column:
    """Parts on lines of their own; null parts are left out, empty ones are blank lines."""
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n")


def said(form: str, *args) -> Column:
    return F.format_string(form, *args)


def diff_section(files) -> Column:
    """files: array<struct<path, status, additions, deletions, added>>."""
    listed = F.transform(files, lambda f: F.concat(said("- [%s] %s (+%d -%d) [", F.coalesce(f["status"], F.lit("modified")), f["path"], f["additions"], f["deletions"]), paths.kind(f["path"]), F.lit("]"), F.when(paths.is_test(f["path"]), " [TEST]").otherwise("")))
    each = F.floor(F.lit(ADDED) / F.greatest(F.size(files), F.lit(1))).cast("int")
    cut = lambda c: F.when(F.length(c) > each, F.concat(F.substring(c, F.lit(1), each), F.lit("\n... [truncated]"))).otherwise(c)
    added = F.array_join(F.transform(F.filter(files, lambda f: F.coalesce(f["added"], F.lit("")) != ""), lambda f: F.concat(F.lit("\n### "), f["path"], F.lit("\n```\n"), cut(f["added"]), F.lit("\n```\n"))), "")
    return lines_of("## Changed Files", F.nullif(F.array_join(listed, "\n"), F.lit("")), "", "## Added Code Lines (from diff)", F.when(F.trim(added) != "", text.truncate(added, DIFF)).otherwise("(No code additions available)"))


def description_section(title, body) -> Column:
    return lines_of(F.concat(F.lit("## PR Title\n"), text.strip_controls(title, 10_000)), "", F.concat(F.lit("## PR Body\n"), text.truncate(text.strip_controls(body, 1 << 20), BODY)))


def commit_section(messages, commits, files) -> Column:
    return lines_of(F.concat(F.lit("## Commit Messages\n"), text.truncate(text.strip_controls(messages, 1 << 20), COMMITS)), "", "## Commit Summary", said("- Number of commits: %d", commits), said("- Number of changed files: %d", files))


def structure_section(additions, deletions, files) -> Column:
    kinds = F.array_sort(F.array_distinct(F.transform(files, lambda f: paths.kind(f["path"]))))
    counted = F.transform(kinds, lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.size(F.filter(files, lambda f: paths.kind(f["path"]) == k)).cast("string"), F.lit(" files")))
    tests = F.size(F.filter(files, lambda f: paths.is_test(f["path"])))
    return lines_of("## Code Structure Summary", "### Change Scale", said("- Files changed: %d", F.size(files)), said("- Lines added: %d", additions), said("- Lines deleted: %d", deletions), said("- Code churn: %d", additions + deletions), "### File Type Distribution", F.nullif(F.array_join(counted, "\n"), F.lit("")), said("- Test files: %d", tests))


def base(kind: str = "C4") -> Column:
    """C1: the diff; C2: and the description; C3: and the commits; C4: and the structure; over the columns repo, pr_id, files, title, body,
    commit_messages, num_commits, total_additions, total_deletions."""
    c, n = F.col, int(kind[1])
    parts = ["# PR Context", F.concat(F.lit("Repository: "), c("repo")), F.concat(F.lit("PR ID: "), c("pr_id").cast("string")), "", diff_section(c("files")), ""]
    parts += [description_section(c("title"), c("body")), ""] if n > 1 else []
    parts += [commit_section(c("commit_messages"), c("num_commits"), F.size("files")), ""] if n > 2 else []
    parts += [structure_section(c("total_additions"), c("total_deletions"), c("files")), ""] if n > 3 else []
    return lines_of(*parts)


def checklist(files, title, body, additions, commits, flagged=None, patches=None) -> Column:
    """Observed risks and neutral facts; the outcome is not among them. In words of its own, so prompts are not comparable with published runs.

    patches: array of whole patches, in which changes of the interface are looked for; without them the added lines. flagged: whether
    the change counts as generated code."""
    names = F.transform(files, lambda f: f["path"])
    n, tests = F.size(files), F.size(F.filter(names, paths.is_test_part))
    first = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    config = F.filter(names, paths.is_config_part)
    core = F.filter(names, lambda x: F.lower(x).rlike("|".join(CORE)))
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    traces = F.filter(signals.words(TRACES), lambda w: whole.contains(w))
    documents = F.filter(names, lambda x: F.lower(x).rlike(r"doc|readme|changelog|\.md|\.rst"))
    api = F.exists(F.transform(files, lambda f: f["added"]) if patches is None else patches, lambda p: F.coalesce(p, F.lit("")).rlike("public|export"))
    length = F.length(F.coalesce(body, F.lit("")))
    risks = F.array_compact(F.array(
        F.when(tests == 0, "MISSING_TESTS: no test files"),
        F.when(n > 10, said("LARGE_SCOPE: %d files", n)),
        F.when(additions > 500, said("LARGE_ADDITIONS: +%d lines", additions)),
        F.when(F.size(config) > 0, F.concat(F.lit("CONFIG_DEP_CHANGE: "), first(config))),
        F.when(F.size(core) > 0, F.concat(F.lit("CORE_MODULE: "), first(core))),
        F.when(length < 100, "SHORT_DESCRIPTION: under 100 characters"),
        F.when(F.size(traces) > 0, F.concat(F.lit("AI_TOOL_TRACES: "), F.array_join(traces, ", "))),
        F.when(api & (F.size(documents) == 0), "API_CHANGE_NO_DOCS: no documents changed"),
    ))
    facts = F.array_compact(F.array(
        F.when(tests > 0, said("%d test files", tests)),
        F.when(n <= 5, said("Small scope: %d files", n)).when(n <= 10, said("Moderate scope: %d files", n)),
        F.when(additions <= 200, said("Small additions: +%d lines", additions)).when(additions <= 500, said("Moderate additions: +%d lines", additions)),
        F.when((length >= 100) & (length < 300), "Short description: under 300 characters"),
        F.when(F.lower(F.coalesce(commits, F.lit(""))).rlike("generated|copilot|ai"), "Commit messages hold signs of generated code"),
        F.when(F.lit(False) if flagged is None else flagged, "Flagged as generated code"),
    ))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return lines_of("## Risk Checklist", "### Risk Signals", F.when(F.size(risks) > 0, listed(risks)).otherwise("- No obvious risk signals."), F.when(F.size(facts) > 0, F.concat(F.lit("### Neutral Observations\n"), listed(facts))))


def policy_figures(rows: DataFrame, group: str = "repo", key: str = "pr_id") -> DataFrame:
    """Of each row the figures of its repository without itself: sums of the whole less its own, so no join of rows with rows.
    rows: merged (boolean), title, review."""
    reviewed = (F.trim(F.coalesce("review", F.lit(""))) != "").cast("int")
    own = {"n": F.lit(1), "merged_n": F.col("merged").cast("int"), "reviewed": reviewed, "review_chars": F.when(reviewed == 1, F.length("review")).otherwise(0), "signs": signals.holds_any(F.col("review"), POLICY).cast("int")}
    own |= {f"k{i}": F.when(~F.col("merged"), F.regexp_count(F.lower(F.coalesce("title", F.lit(""))), F.lit(w))).otherwise(0) for i, w in enumerate(CLOSED_FOR)}
    mine = rows.select(group, key, *[v.cast("long").alias(k) for k, v in own.items()])
    sums = mine.groupBy(group).agg(*[F.sum(k).alias(f"s_{k}") for k in own])
    rest = mine.join(sums, group).select(group, key, *[(F.col(f"s_{k}") - F.col(k)).alias(k) for k in own])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4))
    kept = F.array_compact(F.array(*[F.when(F.col(f"k{i}") >= 2, F.concat(F.lit(f"{w}(x"), F.col(f"k{i}").cast("string"), F.lit(")"))) for i, w in enumerate(CLOSED_FOR)]))
    return rest.select(group, key, F.col("n").alias("others"), ratio("merged_n", "n").alias("merge_rate"), ratio("reviewed", "n").alias("review_ratio"), F.coalesce(ratio("review_chars", "reviewed"), F.lit(0.0)).alias("review_length"), F.array_join(F.slice(kept, 1, 8), ", ").alias("closed_for"), (F.col("signs") > 0).alias("policy_signs"))


def policy_text(repo, others, merge_rate, review_ratio, review_length, closed_for, policy_signs) -> Column:
    """The repository's habits in words of its own; shares are rounded half up."""
    percent = lambda c: F.format_string("%.1f%%", F.round(100 * c, 1))
    found = lines_of(
        "## Repository Policy", F.concat(F.lit("Repository: "), repo), said("Earlier requests here, without this one: %d", others), F.concat(F.lit("Merge rate: "), percent(merge_rate)), F.concat(F.lit("With review comments: "), percent(review_ratio)),
        F.when(closed_for != "", F.concat(F.lit("Common in unmerged requests: "), closed_for)), F.when(policy_signs, "Generated code has been a matter of discussion here."), said("Average review length: %.0f characters", review_length),
        F.when(merge_rate < 0.5, "Few requests are merged here."),
    )
    return F.when(others > 0, found).otherwise("## Repository Policy\nNo history of this repository.")


def histories(rows: DataFrame, queries: DataFrame, key: str = "pr_id", k: int = 3) -> DataFrame:
    """key of each query and `neighbours`, the k most similar of all other rows by rank, as `history_text` takes them; an empty array without any.

    rows and queries: key (unique), repo, num_files, total_additions, total_deletions, title, merged (boolean), review. The texts are joined to the k
    neighbours found, so none takes part in the search."""
    sized = lambda df: df.withColumn("_words", text.lower_tokens(F.col("title")))
    found = similar(sized(rows), sized(queries), key, "repo", "num_files", "total_additions", "_words", k)
    told = rows.select(F.col(key).alias("similar"), "title", "repo", F.col("num_files").alias("files"), F.col("total_additions").alias("additions"), F.col("total_deletions").alias("deletions"), "merged", "review")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "similar", "score", "title", "repo", "files", "additions", "deletions", "merged", "review")))
    whole = found.join(told, "similar").groupBy(key).agg(ordered.alias("x"))
    named = F.transform("x", lambda x, i: F.struct((i + 1).alias("rank"), *[x[c].alias(c) for c in ("score", "title", "repo", "files", "additions", "deletions", "merged", "review")]))
    each = queries.select(key).join(whole.select(key, named.alias("neighbours")), key, "left")
    return each.withColumn("neighbours", F.coalesce("neighbours", F.array().cast(whole.select(named.alias("n")).schema["n"].dataType)))


def history_text(neighbours) -> Column:
    """neighbours: array<struct<rank, score, title, repo, files, additions, deletions, merged, review>> by rank. Titles are cut to 150 characters,
    reviews to 200; scores are rounded half up to one digit. In words of its own."""
    each = F.transform(neighbours, lambda x: lines_of(
        said("### Similar request %d (score %.1f)", x["rank"], F.round(x["score"], 1)), F.concat(F.lit("- Title: "), F.substring(x["title"], 1, 150)), F.concat(F.lit("- Repository: "), x["repo"]),
        said("- Files: %d, lines: +%d -%d", x["files"], x["additions"], x["deletions"]), F.concat(F.lit("- Outcome: "), F.when(x["merged"], "merged").otherwise("not_merged")),
        F.when(F.trim(F.coalesce(x["review"], F.lit(""))) != "", F.concat(F.lit("- Review: "), F.substring(x["review"], 1, 200))),
    ))
    return F.when(F.size(neighbours) > 0, F.concat(F.lit("## Similar History\n"), F.array_join(each, "\n\n"))).otherwise("## Similar History\nNo other requests.")


def combined(base_text, risks, policy, history, kind: str) -> Column:
    """C5: base and checklist; C6: and policy; C7: and history; C8: all, cut to the budget of tokens by dropping the history and
    the base's end, and then by characters."""
    parts = {"C5": [base_text, risks], "C6": [base_text, risks, policy], "C7": [base_text, risks, history]}
    if kind in parts:
        return F.concat_ws("\n\n---\n\n", *parts[kind])
    most = TOKENS - RESERVED
    whole = F.concat_ws("\n\n", base_text, F.lit("---"), risks, F.lit("---"), policy, F.lit("---"), history)
    less = F.concat_ws("\n\n", F.substring(base_text, 1, DIFF), risks, policy)
    return F.when(text.tokens_estimate(whole) <= most, whole).when(text.tokens_estimate(less) <= most, less).otherwise(F.substring(less, 1, TOKENS * 4))


def leaks(context) -> Column:
    """Forbidden names in a context and patterns of fields with them, in any case of letters."""
    low = F.lower(F.coalesce(context, F.lit("")))
    return F.filter(signals.words(FORBIDDEN + SUSPICIOUS), lambda w: low.contains(w))


def messages(rows: DataFrame, templates: DataFrame, context: str = "context", shots: str | None = None) -> DataFrame:
    """One row per request and template (prompt, system, user with a place {context}, few_shot boolean): messages of role and content.
    More than `TEMPLATES` templates are an error, none is left out; examples go only into prompts that take them."""
    found = templates.limit(TEMPLATES + 1).collect()
    if len(found) > TEMPLATES:
        raise ValueError(f"more than {TEMPLATES} templates")
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(found, templates.schema)))
    examples = F.when(F.col("few_shot"), F.concat(F.col(shots), F.lit("\n\n"))).otherwise("") if shots else F.lit("")
    user = F.concat(examples, F.replace("user", F.lit("{context}"), F.col(context)))
    return joined.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))
