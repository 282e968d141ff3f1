"""Queries over whole prompt contexts: every text is compared with its DuckDB twin by its sha256.

A labelled document stands in as a change request: the first line is its title, each word a changed file, the source its repository, quality its
outcome. Contexts are built for the requests whose id is divisible by 50, with their neighbours among all others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mergelens.functions import text
from mergelens.operators import contexts
from mergelens.plans.catalog import LABELLED, labelled, query
from mergelens.plans.reviews import POLICY, _words, policy_figures

PATHS = [("src/core/m", ".py"), ("tests/test_", ".go"), ("conf/", ".json"), ("docs/", ".md"), ("web/", ".css")]


def requests(spark, d):
    """doc_id, repo, title, body, review, merged, commits, flagged, files, and their number and lines."""
    pick = lambda i, j: F.element_at(F.array(*[F.lit(p[j]) for p in PATHS]), (i % 5 + 1).cast("int"))

    def file(w, i):
        return F.struct(
            F.concat(pick(i, 0), (i + 1).cast("string"), pick(i, 1)).alias("path"), F.when(i % 7 > 0, F.when(i % 3 == 0, "added").otherwise("removed")).alias("status"),
            F.length(w).alias("additions"), (F.length(w) % 5).alias("deletions"), F.when(i % 4 > 0, F.when(i % 50 == 1, F.concat(F.lit("export "), w)).otherwise(w)).alias("added"),
        )

    k, whole = F.col("doc_id"), F.col("text")
    rows = labelled(spark, d).select("doc_id", F.col("source").alias("repo"), F.split(whole, "\n")[0].alias("title"), F.when(k % 3 > 0, whole).alias("body"), whole.alias("review"), (F.col("quality") == 1).alias("merged"), F.when(k % 4 == 0, "Generated fix").otherwise("Fix it").alias("commits"), (k % 5 == 0).alias("flagged"), F.transform(F.split(text.safe(whole), " "), file).alias("files"))
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f[c])
    return rows.withColumns({"num_files": F.size("files"), "total_additions": total("additions"), "total_deletions": total("deletions")})


def _pick(j: int) -> str:
    return "[" + ", ".join(f"'{p[j]}'" for p in PATHS) + "][((i - 1) % 5 + 1)::INTEGER]"


REQUESTS = f"""(SELECT *, len(files) AS num_files, coalesce(list_sum(list_transform(files, lambda f: f.additions)), 0)::BIGINT AS total_additions, coalesce(list_sum(list_transform(files, lambda f: f.deletions)), 0)::BIGINT AS total_deletions FROM
 (SELECT doc_id, source AS repo, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 3 > 0 THEN text END AS body, text AS review, quality = 1 AS merged, CASE WHEN doc_id % 4 = 0 THEN 'Generated fix' ELSE 'Fix it' END AS commits, doc_id % 5 = 0 AS flagged,
 list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: {{'path': {_pick(0)} || i || {_pick(1)}, 'status': CASE WHEN (i - 1) % 7 > 0 THEN CASE WHEN (i - 1) % 3 = 0 THEN 'added' ELSE 'removed' END END,
  'additions': length(w), 'deletions': length(w) % 5, 'added': CASE WHEN (i - 1) % 4 > 0 THEN CASE WHEN (i - 1) % 50 = 1 THEN 'export ' || w ELSE w END END, 'at': (i - 1) % 5}}) AS files FROM ({LABELLED})))"""
_TITLE = "list_distinct(list_filter(string_split_regex(lower(coalesce(title, '')), '\\s+'), lambda x: x <> ''))"
NEIGHBOURS = f"""(SELECT q.doc_id, c.doc_id AS similar, c.title, c.repo, c.num_files, c.total_additions, c.total_deletions, c.merged, c.review,
 round(3 * (q.repo = c.repo)::INTEGER + 2 * exp(-abs(q.num_files - c.num_files) / 10.0::DOUBLE) + 2 * exp(-abs(q.total_additions - c.total_additions) / 500.0::DOUBLE) + 2 * (CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_intersect(q.t, c.t)) / len(q.t)::DOUBLE END), 4) AS score,
 row_number() OVER (PARTITION BY q.doc_id ORDER BY score DESC, c.doc_id) AS rank
 FROM (SELECT *, {_TITLE} AS t FROM {REQUESTS}) q JOIN (SELECT *, {_TITLE} AS t FROM {REQUESTS}) c ON q.doc_id <> c.doc_id WHERE q.doc_id % 50 = 0 QUALIFY rank <= 3)"""
_LINE = "concat_ws(chr(10), {})".format
HISTORY = f"""(SELECT doc_id, '## Similar History' || chr(10) || string_agg({_LINE("'### Similar request ' || rank || ' (score ' || printf('%.1f', round(score, 1)) || ')', '- Title: ' || substr(title, 1, 150), '- Repository: ' || repo, '- Files: ' || num_files || ', lines: +' || total_additions || ' -' || total_deletions, '- Outcome: ' || CASE WHEN merged THEN 'merged' ELSE 'not_merged' END, CASE WHEN trim(coalesce(review, '')) <> '' THEN '- Review: ' || substr(review, 1, 200) END")}, chr(10) || chr(10) ORDER BY rank) AS history FROM {NEIGHBOURS} GROUP BY doc_id)"""


def _histories(spark, d):
    rows = requests(spark, d)
    return rows, contexts.histories(rows, rows.where("doc_id % 50 = 0"), "doc_id")


@query(f"SELECT doc_id, sha256(history) AS digest, length(history) AS chars FROM {HISTORY}")
def similar_history(spark, d):
    """The context of similar requests: whole texts."""
    _, found = _histories(spark, d)
    told = found.select("doc_id", contexts.history_text(F.col("neighbours")).alias("history"))
    return told.select("doc_id", F.sha2("history", 256).alias("digest"), F.length("history").cast("long").alias("chars"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')".format
_CUT = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || chr(10) || '... [truncated]' ELSE {0} END".format
_KIND = "['code', 'code', 'config', 'doc', 'other'][f.at + 1]"
_EACH = f"""SELECT *, array_to_string(list_transform(files, lambda f: '- [' || coalesce(f.status, 'modified') || '] ' || f.path || ' (+' || f.additions || ' -' || f.deletions || ') [' || {_KIND} || ']' || CASE WHEN f.at = 1 THEN ' [TEST]' ELSE '' END), chr(10)) AS listed,
 array_to_string(list_transform(list_filter(files, lambda f: coalesce(f.added, '') <> ''), lambda f: chr(10) || '### ' || f.path || chr(10) || '```' || chr(10) || {_CUT('f.added', '(6000 // num_files)')} || chr(10) || '```' || chr(10)), '') AS code, {_CLEAN('body')} AS clean_body, {_CLEAN('commits')} AS clean_commits, {_CLEAN('title')} AS clean_title,
 len(list_filter(files, lambda f: f.at = 1)) AS tests, list_transform(list_filter(files, lambda f: f.at = 2), lambda f: f.path) AS config, list_transform(list_filter(files, lambda f: f.at = 0), lambda f: f.path) AS core, len(list_filter(files, lambda f: f.at = 3)) AS documents,
 list_filter({_words(contexts.TRACES)}, lambda w: contains(lower(coalesce(title, '') || ' ' || coalesce(body, '')), w)) AS traces, len(list_filter(files, lambda f: regexp_matches(coalesce(f.added, ''), 'public|export'))) > 0 AS api, coalesce(length(body), 0) AS size FROM {REQUESTS} WHERE doc_id % 50 = 0"""
_DIFF = _LINE(f"'## Changed Files', listed, '', '## Added Code Lines (from diff)', CASE WHEN trim(code) <> '' THEN {_CUT('code', 8000)} ELSE '(No code additions available)' END")
_DESCRIBED = _LINE(f"'## PR Title' || chr(10) || substr(clean_title, 1, 10000), '', '## PR Body' || chr(10) || {_CUT('clean_body', 3000)}")
_COMMITS = _LINE(f"'## Commit Messages' || chr(10) || {_CUT('clean_commits', 1500)}, '', '## Commit Summary', '- Number of commits: ' || num_files, '- Number of changed files: ' || num_files")
_KINDS = "array_to_string(list_transform(list_sort(list_distinct(list_transform(files, lambda f: " + _KIND + "))), lambda k: '- ' || k || ': ' || len(list_filter(files, lambda f: " + _KIND + " = k)) || ' files'), chr(10))"
_SCALE = _LINE(f"'## Code Structure Summary', '### Change Scale', '- Files changed: ' || num_files, '- Lines added: ' || total_additions, '- Lines deleted: ' || total_deletions, '- Code churn: ' || (total_additions + total_deletions), '### File Type Distribution', {_KINDS}, '- Test files: ' || tests")
_HEAD = ["'# PR Context'", "'Repository: ' || repo", "'PR ID: ' || doc_id", "''"]
_BASE = {n: _LINE(", ".join([*_HEAD, *[x for p in (_DIFF, _DESCRIBED, _COMMITS, _SCALE)[:n] for x in (p, "''")]])) for n in range(1, 5)}
_RISKS = """list_filter([CASE WHEN tests = 0 THEN 'MISSING_TESTS: no test files' END, CASE WHEN num_files > 10 THEN 'LARGE_SCOPE: ' || num_files || ' files' END, CASE WHEN total_additions > 500 THEN 'LARGE_ADDITIONS: +' || total_additions || ' lines' END,
 CASE WHEN len(config) > 0 THEN 'CONFIG_DEP_CHANGE: ' || array_to_string(config[:3], ', ') END, CASE WHEN len(core) > 0 THEN 'CORE_MODULE: ' || array_to_string(core[:3], ', ') END, CASE WHEN size < 100 THEN 'SHORT_DESCRIPTION: under 100 characters' END,
 CASE WHEN len(traces) > 0 THEN 'AI_TOOL_TRACES: ' || array_to_string(traces, ', ') END, CASE WHEN api AND documents = 0 THEN 'API_CHANGE_NO_DOCS: no documents changed' END], lambda x: x IS NOT NULL)"""
_FACTS = """list_filter([CASE WHEN tests > 0 THEN tests || ' test files' END, CASE WHEN num_files <= 5 THEN 'Small scope: ' || num_files || ' files' WHEN num_files <= 10 THEN 'Moderate scope: ' || num_files || ' files' END,
 CASE WHEN total_additions <= 200 THEN 'Small additions: +' || total_additions || ' lines' WHEN total_additions <= 500 THEN 'Moderate additions: +' || total_additions || ' lines' END, CASE WHEN size >= 100 AND size < 300 THEN 'Short description: under 300 characters' END,
 CASE WHEN regexp_matches(lower(commits), 'generated|copilot|ai') THEN 'Commit messages hold signs of generated code' END, CASE WHEN flagged THEN 'Flagged as generated code' END], lambda x: x IS NOT NULL)"""
_POLICY = """CASE WHEN others > 0 THEN concat_ws(chr(10), '## Repository Policy', 'Repository: ' || repo, 'Earlier requests here, without this one: ' || others, 'Merge rate: ' || printf('%.1f%%', round(100 * merge_rate, 1)), 'With review comments: ' || printf('%.1f%%', round(100 * review_ratio, 1)),
 CASE WHEN closed_for <> '' THEN 'Common in unmerged requests: ' || closed_for END, CASE WHEN policy_signs THEN 'Generated code has been a matter of discussion here.' END, 'Average review length: ' || CAST(CAST(round(review_length) AS BIGINT) AS VARCHAR) || ' characters',
 CASE WHEN merge_rate < 0.5 THEN 'Few requests are merged here.' END) ELSE '## Repository Policy' || chr(10) || 'No history of this repository.' END"""
_ESTIMATE = "(len(regexp_extract_all({0}, '[一-鿿]')) + floor(len(regexp_extract_all({0}, '[a-zA-Z]+')) * 1.3::DOUBLE)::BIGINT + (length({0}) - len(regexp_extract_all({0}, '[一-鿿]')) - len(regexp_extract_all({0}, '[a-zA-Z\\s]'))) // 2)".format
_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
GRID = f"""(WITH e AS ({_EACH}),
 p AS (SELECT e.*, {', '.join(f'{v} AS c{k}' for k, v in _BASE.items())}, {_RISKS} AS found, {_FACTS} AS facts FROM e),
 r AS (SELECT doc_id, c1, c2, c3, c4, concat_ws(chr(10), '## Risk Checklist', '### Risk Signals', CASE WHEN len(found) > 0 THEN array_to_string(list_transform(found, lambda x: '- ' || x), chr(10)) ELSE '- No obvious risk signals.' END,
   CASE WHEN len(facts) > 0 THEN '### Neutral Observations' || chr(10) || array_to_string(list_transform(facts, lambda x: '- ' || x), chr(10)) END) AS risks FROM p),
 y AS (SELECT doc_id, {_POLICY} AS policy FROM {POLICY}),
 j AS (SELECT r.*, policy, coalesce(history, '## Similar History' || chr(10) || 'No other requests.') AS history FROM r JOIN y USING (doc_id) LEFT JOIN {HISTORY} h USING (doc_id)),
 w AS (SELECT *, c4 || {_SEP} || risks || {_SEP} || policy || {_SEP} || history AS whole, substr(c4, 1, 8000) || chr(10) || chr(10) || risks || chr(10) || chr(10) || policy AS less FROM j),
 v AS (SELECT *, c4 || {_SEP} || risks AS c5, c4 || {_SEP} || risks || {_SEP} || policy AS c6, c4 || {_SEP} || risks || {_SEP} || history AS c7, CASE WHEN {_ESTIMATE('whole')} <= 12000 THEN whole WHEN {_ESTIMATE('less')} <= 12000 THEN less ELSE substr(less, 1, 56000) END AS c8, {_ESTIMATE('whole')} > 12000 AS beyond FROM w)
 SELECT doc_id, beyond, unnest([{', '.join(f"{{'context': 'C{i}', 'body': c{i}}}" for i in range(1, 9))}], recursive := true) FROM v)"""


def _grid(spark, d):
    """doc_id, context, body and whether all of C8 would be beyond the budget."""
    c = F.col
    rows, found = _histories(spark, d)
    asked = rows.where("doc_id % 50 = 0")
    figures = policy_figures(spark, d).select("doc_id", contexts.policy_text(c("repo"), c("others"), c("merge_rate"), c("review_ratio"), c("review_length"), c("closed_for"), c("policy_signs")).alias("policy"))
    named = asked.withColumns({"pr_id": c("doc_id"), "commit_messages": c("commits"), "num_commits": c("num_files")})
    based = named.select("doc_id", *[contexts.base(f"C{i}").alias(f"C{i}") for i in range(1, 5)], contexts.checklist(c("files"), c("title"), c("body"), c("total_additions"), c("commits"), c("flagged")).alias("risks"))
    whole = based.join(figures, "doc_id").join(found.select("doc_id", contexts.history_text(c("neighbours")).alias("history")), "doc_id")
    parts = [c("C4"), c("risks"), c("policy"), c("history")]
    whole = whole.withColumns({f"C{i}": contexts.combined(*parts, f"C{i}") for i in range(5, 9)})
    beyond = text.tokens_estimate(F.concat_ws("\n\n---\n\n", *parts)) > contexts.TOKENS - contexts.RESERVED
    return whole.select("doc_id", beyond.alias("beyond"), F.explode(F.array(*[F.struct(F.lit(f"C{i}").alias("context"), c(f"C{i}").alias("body")) for i in range(1, 9)])).alias("x")).select("doc_id", "beyond", "x.*")


@query(f"SELECT doc_id, context, sha256(body) AS digest, length(body) AS chars, beyond FROM {GRID}")
def whole_contexts(spark, d):
    """All eight contexts of each request as whole texts."""
    return _grid(spark, d).select("doc_id", "context", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("chars"), "beyond")


@query(f"SELECT context, count(*) AS n, round(avg(length(body)), 4) AS mean_chars, max(length(body)) AS most_chars, count(*) FILTER (length(body) > 10000) AS over, count(*) FILTER (context = 'C8' AND beyond) AS truncated FROM {GRID} GROUP BY context")
def context_grid(spark, d):
    """The grid of contexts: how long they are, how many are beyond 10000 characters, how many lost their history to the budget."""
    size = F.length("body")
    return _grid(spark, d).groupBy("context").agg(F.count("*").alias("n"), F.round(F.avg(size), 4).alias("mean_chars"), F.max(size).cast("long").alias("most_chars"), F.count_if(size > 10_000).alias("over"), F.count_if((F.col("context") == "C8") & F.col("beyond")).alias("truncated"))
