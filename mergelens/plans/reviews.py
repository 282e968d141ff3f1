"""Named queries over change requests with all their children, code in five languages, evaluation, contexts and the service.

The tables hold no change requests, so orders stand in as requests and their lines as files, reviews, comments, commits and labels. A
document is also a file of code in one of five languages, whose lines are picked by the lengths of its words.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths, signals, text
from mergelens.operators import contexts, deployable, evaluation, ml, ranks, requests, rules, service, similarity, stages, stats, structure
from mergelens.plans.catalog import _SPLIT, FILES, LABELLED, changes, labelled, lines, query, t
from mergelens.sources import io
from mergelens.storage import shared_dir

# --- code in five languages ---
LINES = {
    ".py": ["def fN(x):", "    if x > N:", "        return N", "    elif x:", "        y = N", "    for i in range(N):", "        while i:", "            break", "    try:", "    except E:", "class CN:", "# note N"],
    ".go": ["func fN(x int) int {", "    if x > N {", "        return N", "    }", "    y := N", "    for i := 0; i < N; i++ {", "        switch i {", "        case N:", "    defer g(N)", "    if err != nil {", "type tN struct {", "// note N"],
    ".js": ["function fN(x) {", "  if (x > N) {", "    return N", "  }", "  const y = N", "  for (let i = 0; i < N; i++) {", "  while (x) {", "  try {", "  } catch (e) {", "  finally {", "class CN {", "// note N"],
    ".ts": ["export function fN(x: number) {", "  if (x > N) {", "    return N", "  }", "  let y = N", "  interface IN {", "  do (x) {", "  type TN = number", "  break", "  async function gN() {", "  throw N", "* note N"],
    ".java": ["public int fN(int x) {", "  if (x > N) {", "    return N;", "  }", "  int y = N;", "  for (int i = 0; i < N; i++) {", "  struct sN", "  yield N", "  } else {", "  else {", "  try {", "/* note N"],
}
EXT = list(LINES)


def code_files(spark, d):
    ext = F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 5 + 1).cast("int"))
    kinds = F.array(*[F.array(*map(F.lit, LINES[e])) for e in EXT])
    docs = io.spread(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", ext.alias("ext"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("k"), F.split(text.safe(F.col("text")), " ").alias("w"))
    line = lambda w, i: F.replace(F.element_at(F.col("k"), (F.length(w) + i) % 12 + 1), F.lit("N"), F.length(w).cast("string"))
    return docs.select(F.col("doc_id").alias("file_id"), F.floor(F.col("doc_id") / 5).alias("pr_id"), "ext", F.array_join(F.transform("w", line), "\n").alias("code"))


_KINDS = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in LINES[e]) + "]" for e in EXT) + "]"
_EXTS = "[" + ", ".join(f"'{e}'" for e in EXT) + "]"
CODE_FILES = f"""(SELECT doc_id AS file_id, doc_id // 5 AS pr_id, {_EXTS}[(doc_id % 5 + 1)::INTEGER] AS ext,
 array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w, i: replace(k[((length(w) + i - 1) % 12 + 1)::INTEGER], 'N', length(w)::VARCHAR)), chr(10)) AS code
 FROM (SELECT *, {_KINDS}[(doc_id % 5 + 1)::INTEGER] AS k FROM documents))"""


def _count(name: str) -> str:
    quoted = lambda p: p.replace("'", "''")
    whens = " ".join(f"WHEN '{e}' THEN len(regexp_extract_all(code, '{quoted(p[name])}'))" for e, p in structure.LEXICAL.items())
    return f"CASE ext {whens} ELSE len(regexp_extract_all(code, '{quoted(structure.GENERIC_JAVA[name])}')) END"


CENSUS = f"""(SELECT f.file_id, f.pr_id, f.ext, {', '.join(f'CAST({_count(k)} AS BIGINT) AS {k}' for k in structure.PYTHON)},
 CAST(len(list_filter(string_split(code, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|//|/\\*|\\*)'))) AS BIGINT) AS own_lines,
 CAST(CASE WHEN ext = '.py' THEN coalesce(list_max(list_transform(list_filter(string_split(code, chr(10)), lambda x: rtrim(x) <> '' AND NOT starts_with(x, '#')), lambda x: length(x) - length(ltrim(x)))), 0) // 4 + 1 ELSE greatest(b.most + 1, 1) END AS BIGINT) AS max_depth
 FROM {CODE_FILES} f JOIN (SELECT file_id, max(now) AS most FROM (SELECT file_id, sum(length(x) - length(replace(x, '{{', '')) - length(x) + length(replace(x, '}}', ''))) OVER (PARTITION BY file_id ORDER BY i) AS now
   FROM (SELECT file_id, unnest(string_split(code, chr(10))) AS x, generate_subscripts(string_split(code, chr(10)), 1) AS i FROM {CODE_FILES})) GROUP BY 1) b ON f.file_id = b.file_id)"""
_TOTAL = f"greatest(own_lines + {' + '.join(structure.PYTHON)}, 1)"


@query(f"SELECT file_id, ext, {', '.join(structure.PYTHON)}, {_TOTAL} AS total_nodes, max_depth FROM {CENSUS}")
def code_census(spark, d):
    return structure.census(code_files(spark, d)).select("file_id", "ext", *structure.CENSUS, "max_depth")


@query(f"SELECT pr_id, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in structure.PYTHON)}, CAST(sum({_TOTAL}) AS BIGINT) AS total_nodes, CAST(sum(max_depth) AS BIGINT) AS max_depth, max(max_depth) AS depth_most, count(*) AS files_attempted, count(*) AS files_parsed, 1.0::DOUBLE AS parse_success_rate FROM {CENSUS} GROUP BY 1")
def census_rollup(spark, d):
    return structure.census_by(structure.census(code_files(spark, d)), "pr_id")


def _ladder(rules_) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(line, '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in rules_) + " ELSE 'statement' END"


@query(f"SELECT file_id, CASE WHEN ext = '.py' THEN {_ladder(structure.FLOW_PYTHON)} WHEN ext = '.go' THEN {_ladder(structure.FLOW_GO)} ELSE {_ladder(structure.FLOW_BRACES)} END AS flow, count(*) AS n FROM (SELECT file_id, ext, unnest(string_split(code, chr(10))) AS line FROM {CODE_FILES}) GROUP BY ALL")
def flow_lines(spark, d):
    rows = code_files(spark, d).select("file_id", "ext", F.explode(F.split("code", "\n")).alias("line"))
    return rows.groupBy("file_id", structure.flow_class(F.col("line"), F.col("ext")).alias("flow")).agg(F.count("*").alias("n"))


@query()
def flow_features(spark, d):
    return code_files(spark, d).select("file_id", "ext", structure.flow(F.col("code"), F.col("ext")).alias("x")).select("file_id", "ext", "x.*")


@query()
def flow_rollup(spark, d):
    rows = code_files(spark, d).select("pr_id", structure.flow(F.col("code"), F.col("ext")).alias("x")).select("pr_id", "x.*")
    return structure.flow_by(rows, "pr_id")


@query(f"SELECT file_id, ext FROM {CODE_FILES} WHERE ext IN ('.py', '.go') AND length(trim(code)) >= 50 ORDER BY file_id LIMIT 30")
def code_samples(spark, d):
    return structure.samples(code_files(spark, d), 30, 50, [".py", ".go"]).select("file_id", "ext")


@query(f"SELECT CAST(least(10, floor(10 * rate)) AS BIGINT) AS bin, count(*) AS n FROM (SELECT pr_id, count(*) FILTER (length(code) > 1000) / count(*)::DOUBLE AS rate FROM {CODE_FILES} GROUP BY 1) GROUP BY 1")
def parse_rate_bins(spark, d):
    rate = code_files(spark, d).groupBy("pr_id").agg((F.count_if(F.length("code") > 1000) / F.count("*")).alias("rate"))
    return rate.groupBy(F.least(F.lit(10), F.floor(10 * F.col("rate"))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


# --- requests with all their children ---
def children(spark, d):
    li, k = t(spark, d, "lineitem"), F.col("l_partkey")
    key = [F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("pos")]
    said = F.when(k % 13 == 0, "fine by Copilot").when(k % 3 == 0, "").otherwise(F.concat(F.lit("note "), k.cast("string")))
    state = F.when(F.col("l_returnflag") == "A", "APPROVED").when(F.col("l_returnflag") == "R", "CHANGES_REQUESTED").otherwise("COMMENTED")
    odd = F.col("l_linenumber") % 2 == 1
    patch = F.concat(F.lit("@@ -1,2 +1,3 @@ def f"), F.col("pos").cast("string"), F.lit("(x):\n+def g"), F.col("pos").cast("string"), F.lit("():\n-    y = 2"))
    return {
        "reviews": li.where(odd).select(*key, F.concat(F.lit("u"), (F.col("l_suppkey") % 7).cast("string")).alias("login"), state.alias("state"), said.alias("body")),
        "comments": li.where(~odd).select(*key, F.concat(F.lit("src/m"), k.cast("string"), F.lit(".py")).alias("path"), F.col("l_quantity").cast("int").alias("line"), said.alias("body")),
        "files": lines(spark, d).withColumn("patch", patch).select("pr_id", "pos", "path", "additions", "deletions", "patch"),
        "commits": li.select(*key, F.concat(F.lit("  fix "), F.col("l_suppkey").cast("string"), F.lit("\nmore")).alias("message")),
        "labels": li.where("l_tax > 0.05").select(*key, F.when(k % 17 == 0, "ai-assisted").otherwise(F.concat(F.lit("k"), (k % 5).cast("string"))).alias("name")),
    }


def detail(spark, d):
    o, s = t(spark, d, "orders"), F.col("o_orderstatus")
    text_ = lambda head: F.concat(F.lit(head), F.col("o_orderpriority"), F.lit("\nfor "), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("pr_id"), (F.col("o_orderkey") + 1).alias("pr_number"), F.concat(F.lit("repo"), (F.col("o_custkey") % 5).cast("string")).alias("repo"), text_("Change ").alias("title"),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("Generated by AI. "), text_("Body "))).when(F.col("o_orderkey") % 19 != 0, text_("Body ")).alias("body"), F.concat(F.lit("a"), (F.col("o_custkey") % 9).cast("string")).alias("author"),
        F.col("o_orderdate").cast("string").alias("created_at"), (s == "F").alias("merged"), F.when(s == "P", "open").otherwise("closed").alias("state"),
    )


def bundles(spark, d):
    c = children(spark, d)
    return requests.bundle(detail(spark, d), c["reviews"], c["comments"], c["files"], c["commits"], c["labels"])


_SAID = "CASE WHEN l_partkey % 13 = 0 THEN 'fine by Copilot' WHEN l_partkey % 3 = 0 THEN '' ELSE 'note ' || l_partkey END"
_STATE = "CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'R' THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END"
REVIEWS = f"(SELECT l_orderkey AS pr_id, l_linenumber AS pos, 'u' || (l_suppkey % 7) AS login, {_STATE} AS state, {_SAID} AS body FROM lineitem WHERE l_linenumber % 2 = 1)"
COMMENTS = f"(SELECT l_orderkey AS pr_id, l_linenumber AS pos, 'src/m' || l_partkey || '.py' AS path, CAST(l_quantity AS INTEGER) AS line, {_SAID} AS body FROM lineitem WHERE l_linenumber % 2 = 0)"
COMMITS = "(SELECT l_orderkey AS pr_id, l_linenumber AS pos, 'fix ' || l_suppkey AS head FROM lineitem)"
LABELS = "(SELECT l_orderkey AS pr_id, l_linenumber AS pos, CASE WHEN l_partkey % 17 = 0 THEN 'ai-assisted' ELSE 'k' || (l_partkey % 5) END AS name FROM lineitem WHERE l_tax > 0.05)"
DETAIL = """(SELECT o_orderkey AS pr_id, o_orderkey + 1 AS pr_number, 'repo' || (o_custkey % 5) AS repo, 'Change ' || o_orderpriority || chr(10) || 'for ' || o_custkey AS title,
 CASE WHEN o_orderkey % 11 = 0 THEN 'Generated by AI. ' || 'Body ' || o_orderpriority || chr(10) || 'for ' || o_custkey WHEN o_orderkey % 19 <> 0 THEN 'Body ' || o_orderpriority || chr(10) || 'for ' || o_custkey END AS body,
 'a' || (o_custkey % 9) AS author, o_orderstatus = 'F' AS merged, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'closed' END AS state FROM orders)"""


def _words(some) -> str:
    return "[" + ", ".join(f"'{w}'" for w in some) + "]"


def _any(c: str, some) -> str:
    return f"len(list_filter({_words(some)}, lambda w: contains(lower(coalesce({c}, '')), w))) > 0"


def _escaped(c: str, most: int) -> str:
    x = f"regexp_replace({c}, '\\r\\n|\\n|\\r', '\\\\n', 'g')"
    return f"CASE WHEN length({x}) > {most} THEN substr({x}, 1, {most}) || '...' ELSE {x} END"


FLAT = f"""(SELECT d.pr_id, d.pr_number, d.repo, {_escaped('d.title', 500)} AS title, {_escaped("coalesce(d.body, '')", 3000)} AS body, CAST(length(d.title) + length(coalesce(d.body, '')) AS BIGINT) AS pr_length, d.author, d.merged AS is_merged,
 CASE WHEN d.merged THEN 'merged' WHEN d.state = 'closed' THEN 'closed_not_merged' ELSE d.state END AS merge_status, coalesce(r.reviewers, 0) AS num_reviewers,
 CASE WHEN r.n IS NULL THEN 'NONE' WHEN r.yes >= r.no AND r.yes > 0 THEN 'APPROVED' WHEN r.no > r.yes THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END AS review_decision,
 CASE WHEN r.n IS NULL THEN 'NONE' ELSE coalesce(r.decisive, 'COMMENTED') END AS first_decision, coalesce(r.n, 0) AS num_review_comments, coalesce(c.n, 0) AS num_inline_comments,
 {_escaped("concat_ws(' | ', r.said, c.said)", 3000)} AS review_comments_text, coalesce(f.n, 0) AS num_changed_files, CAST(coalesce(f.additions, 0) AS BIGINT) AS total_additions, CAST(coalesce(f.deletions, 0) AS BIGINT) AS total_deletions,
 substr(coalesce(f.functions, ''), 1, 2000) AS modified_functions, coalesce(m.n, 0) AS num_commits, {_escaped("coalesce(m.heads, '')", 2000)} AS commit_messages, substr(coalesce(f.names, ''), 1, 2000) AS changed_files_list,
 coalesce(l.n, 0) AS num_labels, coalesce(l.names, '') AS label_names, coalesce(r.ai, false) OR coalesce(c.ai, false) OR coalesce(l.reviewer, false) AS has_ai_reviewer, {_any('d.body', signals.GENERATED)} OR coalesce(l.generated, false) AS has_ai_generated_code
 FROM {DETAIL} d
 LEFT JOIN (SELECT pr_id, count(*) AS n, count(DISTINCT login) AS reviewers, count(*) FILTER (state = 'APPROVED') AS yes, count(*) FILTER (state = 'CHANGES_REQUESTED') AS no,
   list(state ORDER BY pos, login, state, body) FILTER (state <> 'COMMENTED')[1] AS decisive, string_agg('[Review by ' || login || ']: ' || trim(body), ' | ' ORDER BY pos, login, state, body) FILTER (trim(body) <> '') AS said, bool_or({_any('body', signals.REVIEWER)}) AS ai FROM {REVIEWS} GROUP BY 1) r USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(*) AS n, string_agg('[Inline on ' || path || ' L' || line || ']: ' || trim(body), ' | ' ORDER BY pos, path, line, body) FILTER (trim(body) <> '') AS said, bool_or({_any('body', signals.REVIEWER)}) AS ai FROM {COMMENTS} GROUP BY 1) c USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(*) AS n, sum(additions) AS additions, sum(deletions) AS deletions, string_agg(path, ',' ORDER BY pos, path, additions, deletions) AS names,
   array_to_string(list_sort(list_distinct(flatten(list(['f' || pos, 'g' || pos])))), ',') AS functions FROM {FILES} GROUP BY 1) f USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(*) AS n, string_agg(head, ' | ' ORDER BY pos, head) AS heads FROM {COMMITS} GROUP BY 1) m USING (pr_id)
 LEFT JOIN (SELECT pr_id, count(*) AS n, string_agg(name, ',' ORDER BY pos, name) AS names, bool_or({_any('name', signals.REVIEWER)}) AS reviewer, bool_or({_any('name', signals.GENERATED)}) AS generated FROM {LABELS} GROUP BY 1) l USING (pr_id))"""


@query(f"SELECT * EXCLUDE (first_decision) FROM {FLAT}")
def request_rows(spark, d):
    return requests.project(bundles(spark, d)).drop("created_at")


@query(f"SELECT pr_id, first_decision AS review_decision, num_review_comments + num_inline_comments AS num_review_comments, num_review_comments AS n_reviews, replace(changed_files_list, ',', ', ') AS changed_files_list, replace(label_names, ',', ', ') AS label_names, total_additions + total_deletions AS churn FROM {FLAT}")
def request_rows_v2(spark, d):
    return requests.project(bundles(spark, d), "v2").select("pr_id", "review_decision", "num_review_comments", "n_reviews", "changed_files_list", "label_names", "churn")


@query(f"SELECT pr_id, repo, is_merged FROM {FLAT} WHERE NOT has_ai_generated_code AND merge_status IN ('merged', 'closed_not_merged') AND num_changed_files > 0 AND total_additions >= 0 AND total_deletions >= 0")
def people_only(spark, d):
    return requests.written_by_people(requests.project(bundles(spark, d))).select("pr_id", "repo", "is_merged")


@query(f"SELECT repo, count(*) AS total, count(*) FILTER (is_merged) AS merged, count(*) FILTER (NOT is_merged) AS unmerged, round(avg(is_merged::INTEGER), 4) AS merge_rate, count(*) FILTER (review_comments_text <> '') AS has_review, round(avg(num_changed_files), 4) AS mean_files, round(avg(pr_length), 4) AS mean_length, round(avg(num_reviewers), 4) AS mean_reviewers, round(avg(num_commits), 4) AS mean_commits, round(avg(has_ai_reviewer::INTEGER), 4) AS ai_reviewer_rate, round(avg(has_ai_generated_code::INTEGER), 4) AS ai_code_rate FROM {FLAT} GROUP BY 1")
def repository_stats(spark, d):
    m = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    rows = requests.project(bundles(spark, d))
    return rows.groupBy("repo").agg(
        F.count("*").alias("total"), F.count_if("is_merged").alias("merged"), F.count_if(~F.col("is_merged")).alias("unmerged"), m("is_merged").alias("merge_rate"), F.count_if(requests.has_review(F.col("review_comments_text"))).alias("has_review"),
        m("num_changed_files").alias("mean_files"), m("pr_length").alias("mean_length"), m("num_reviewers").alias("mean_reviewers"), m("num_commits").alias("mean_commits"), m("has_ai_reviewer").alias("ai_reviewer_rate"), m("has_ai_generated_code").alias("ai_code_rate"),
    )


_MEANS = ["num_changed_files", "total_additions", "total_deletions", "num_commits", "num_reviewers", "pr_length"]


@query(f"SELECT is_merged, {', '.join(f'round(avg({c}), 4) AS {c}' for c in _MEANS)} FROM {FLAT} GROUP BY 1")
def outcome_feature_means(spark, d):
    return requests.project(bundles(spark, d)).groupBy("is_merged").agg(*[F.round(F.avg(c), 4).alias(c) for c in _MEANS])


@query(f"SELECT label, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(label_names, ','), lambda x: trim(x)), lambda x: x <> '')) AS label FROM {FLAT}) GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def label_frequency(spark, d):
    names = F.filter(F.transform(F.split("label_names", ","), lambda x: F.trim(x)), lambda x: x != "")
    return requests.project(bundles(spark, d)).select(F.explode(names).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(15)


@query(f"SELECT least(num_reviewers, 3) AS reviewers, count(*) AS n FROM {FLAT} GROUP BY 1")
def reviewer_histogram(spark, d):
    return requests.project(bundles(spark, d)).groupBy(F.least("num_reviewers", F.lit(3).cast("long")).alias("reviewers")).agg(F.count("*").alias("n"))


@query(f"SELECT pr_id, total_additions + total_deletions AS code_churn, total_additions - total_deletions AS net_lines, round(total_additions / greatest(num_changed_files, 1)::DOUBLE, 6) AS additions_per_file, round(total_deletions / greatest(num_changed_files, 1)::DOUBLE, 6) AS deletions_per_file, round((num_review_comments + num_inline_comments) / greatest(num_changed_files, 1)::DOUBLE, 6) AS review_intensity FROM {FLAT}")
def derived_figures(spark, d):
    return requests.derived(requests.project(bundles(spark, d))).select("pr_id", "code_churn", "net_lines", "additions_per_file", "deletions_per_file", "review_intensity")


_SUFFIX = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_IS = {"code": f"{_SUFFIX} IN ('.py', '.go')", "config": f"{_SUFFIX} = '.json'", "doc": f"{_SUFFIX} = '.md'", "other": f"{_SUFFIX} = ''", "test": "(path LIKE 'tests/%' OR path LIKE '%/test\\_%' ESCAPE '\\')"}


@query(f"SELECT pr_id, count(*) AS files, {', '.join(f'count(*) FILTER ({v}) AS num_{k}_files' for k, v in _IS.items())}, {', '.join(f'round(count(*) FILTER ({_IS[k]}) / count(*)::DOUBLE, 6) AS {k}_file_ratio' for k in ('test', 'code', 'doc'))}, max(({_SUFFIX} = '.py')::INTEGER) AS has_py, max(({_SUFFIX} = '.go')::INTEGER) AS has_go, 0 AS has_js, 0 AS has_ts, 0 AS has_rs FROM {FILES} GROUP BY 1")
def file_type_counts(spark, d):
    return requests.file_counts(lines(spark, d), "pr_id")


@query(f"SELECT count(*) AS files, count(*) FILTER ({_IS['code']}) AS code_files, count(DISTINCT pr_id) AS requests, count(DISTINCT pr_id) FILTER ({_IS['code']}) AS with_code, round(count(*) FILTER ({_IS['code']}) / count(*)::DOUBLE, 6) AS file_share, CAST(sum(additions) AS BIGINT) AS added FROM {FILES}")
def patch_coverage(spark, d):
    code = paths.kind(F.col("path")) == "code"
    return lines(spark, d).agg(F.count("*").alias("files"), F.count_if(code).alias("code_files"), F.count_distinct("pr_id").alias("requests"), F.count_distinct(F.when(code, F.col("pr_id"))).alias("with_code"), F.round(F.count_if(code) / F.count("*"), 6).alias("file_share"), F.sum("additions").alias("added"))


@query(f"SELECT pr_id, pos, CASE WHEN {_SUFFIX} = '.py' THEN 'python' WHEN {_SUFFIX} = '.go' THEN 'go' WHEN {_SUFFIX} = '.json' THEN 'json' WHEN {_SUFFIX} = '.md' THEN 'markdown' END AS language FROM {FILES}")
def file_language(spark, d):
    return lines(spark, d).select("pr_id", "pos", paths.language(F.col("path")).alias("language"))


# --- signs of generated code ---
_FIELDS = {"title": "CASE doc_id % 7 WHEN 0 THEN 'Copilot and cursor at work' WHEN 1 THEN 'AI agent change' ELSE string_split(text, chr(10))[1] END", "body": "text", "commit_messages": "lang", "label_names": "CASE WHEN doc_id % 9 = 0 THEN 'gpt, ok' ELSE source END", "author": "source", "review_comments_text": "CASE WHEN doc_id % 11 = 0 THEN 'main llm review' END"}


def fields(spark, d):
    k = F.col("doc_id")
    title = F.when(k % 7 == 0, "Copilot and cursor at work").when(k % 7 == 1, "AI agent change").otherwise(F.split("text", "\n")[0])
    return t(spark, d, "documents").select("doc_id", title.alias("title"), F.col("text").alias("body"), F.col("lang").alias("commit_messages"), F.when(k % 9 == 0, "gpt, ok").otherwise(F.col("source")).alias("label_names"), F.col("source").alias("author"), F.when(k % 11 == 0, "main llm review").alias("review_comments_text"))


def _strong(name, c):
    return f"list_transform(list_filter({_words(signals.STRONG)}, lambda w: contains(lower(trim(coalesce({c}, ''))), w)), lambda w: '{name} contains \"' || w || '\"')"


def _weak(name, c):
    return f"CASE WHEN contains(lower(coalesce({c}, '')), 'ai') AND {_any(c, signals.BESIDE_AI)} THEN ['{name} contains \"ai\" with context words'] ELSE [] END"


REASONS = f"(SELECT doc_id, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE w END, '; ') AS reason FROM (SELECT doc_id, {' || '.join(_strong(n, n) for n in signals.FIELDS)} AS s, {' || '.join(_weak(n, n) for n in signals.FIELDS)} AS w FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM documents)))"


def reasons(spark, d):
    return fields(spark, d).select("doc_id", signals.detection({k: F.col(k) for k in signals.FIELDS}).alias("x")).select("doc_id", "x.found", "x.reason")


@query(f"SELECT doc_id, reason <> '' AS found, reason FROM {REASONS}")
def generated_detection(spark, d):
    return reasons(spark, d)


@query(f"WITH p AS (SELECT unnest(list_filter(string_split(reason, '; '), lambda x: x <> '')) AS x FROM {REASONS}) SELECT 'field' AS kind, regexp_extract(x, '^(\\S+) contains', 1) AS name, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'keyword', regexp_extract(x, '\"([^\"]*)\"', 1), count(*) FROM p GROUP BY 2")
def detection_hits(spark, d):
    return signals.detection_stats(reasons(spark, d))


@query(f"SELECT doc_id, {_any('whole', signals.QUICK)} OR (contains(lower(whole), 'ai') AND {_any('whole', signals.BESIDE_AI)}) AS quick FROM (SELECT doc_id, coalesce(title, '') || ' ' || coalesce(body, '') || ' ' || label_names AS whole FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM documents))")
def quick_filter(spark, d):
    return fields(spark, d).select("doc_id", signals.quick(F.col("title"), F.col("body"), F.array("label_names")).alias("quick"))


# --- keys, unions and sets ---
def seed_new(spark, d):
    o = t(spark, d, "orders").select(F.concat(F.lit("repo"), (F.col("o_custkey") % 5).cast("string")).alias("repo"), (F.col("o_custkey") % 400).alias("number"), F.col("o_orderkey").alias("pr_id"), "o_orderstatus")
    return o.where("o_orderstatus = 'P'").drop("o_orderstatus"), o.where("o_orderstatus <> 'P'").drop("o_orderstatus")


_SN = "SELECT 'repo' || (o_custkey % 5) AS repo, o_custkey % 400 AS number, o_orderkey AS pr_id FROM orders WHERE o_orderstatus"
_NEW = f"SELECT * FROM ({_SN} <> 'P') n WHERE NOT EXISTS (SELECT 1 FROM ({_SN} = 'P') s WHERE s.repo = n.repo AND s.number = n.number) AND pr_id NOT IN (SELECT pr_id FROM ({_SN} = 'P'))"


@query(_NEW)
def unseen_requests(spark, d):
    seed, new = seed_new(spark, d)
    return requests.unseen(new, seed, ["repo", "number"], "pr_id")


@query(f"WITH b AS (SELECT *, 'seed' AS origin FROM ({_SN} = 'P') UNION ALL SELECT *, 'new' FROM ({_NEW})) SELECT * FROM b WHERE origin = 'seed' OR (SELECT count(*) FROM b) >= 150")
def seed_and_new(spark, d):
    seed, new = seed_new(spark, d)
    return requests.enhanced(seed, new, ["repo", "number"], "pr_id")


@query(f"WITH b AS (SELECT *, 'seed' AS origin FROM ({_SN} = 'P') UNION ALL SELECT *, 'new' FROM ({_NEW})) SELECT repo, count(*) FILTER (origin = 'seed') AS seed, count(*) FILTER (origin = 'new') AS new, count(*) AS total FROM b GROUP BY 1")
def repository_composition(spark, d):
    return seed_and_new(spark, d).groupBy("repo").agg(F.count_if(F.col("origin") == "seed").alias("seed"), F.count_if(F.col("origin") == "new").alias("new"), F.count("*").alias("total"))


@query(f"SELECT repo, number FROM ({_SN} = 'P') UNION SELECT repo, number FROM ({_SN} <> 'P')")
def key_union(spark, d):
    return requests.key_union(list(seed_new(spark, d)), ["repo", "number"])


@query("SELECT o_orderkey, trim('  repo' || (o_custkey % 5) || ' ') AS repo, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_custkey END AS number FROM orders")
def composite_keys(spark, d):
    raw = F.when(F.col("o_orderkey") % 6 == 0, "n/a").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    key = requests.composite_key(F.concat(F.lit("  repo"), (F.col("o_custkey") % 5).cast("string"), F.lit(" ")), raw)
    return t(spark, d, "orders").select("o_orderkey", key.alias("k")).select("o_orderkey", "k.repo", "k.number")


@query("WITH a AS (SELECT l_orderkey AS pr_id, 'known' AS origin, count(*) FILTER (l_returnflag = 'A') AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS pr_id, 'more' AS origin, count(*) FILTER (l_returnflag <> 'A') AS n FROM lineitem GROUP BY 1) SELECT pr_id, arg_min(origin, origin) AS origin, arg_min(n, origin) AS files FROM (SELECT * FROM a WHERE n > 0 UNION ALL SELECT * FROM b WHERE n > 0) GROUP BY 1")
def merged_indexes(spark, d):
    of = lambda flag, name: t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pr_id")).agg(F.collect_list(F.when(flag, F.col("l_linenumber"))).alias("files")).withColumn("origin", F.lit(name))
    a = F.col("l_returnflag") == "A"
    return requests.merge_indexes(of(a, "known"), of(~a, "more"), "pr_id").select("pr_id", "origin", F.size("files").cast("long").alias("files"))


_DRAWN = "md5(pr_id || '-42')"


@query(f"WITH a AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_DRAWN}, pr_id) AS r FROM ({_SN} <> 'P')), k AS (SELECT repo, number, pr_id, 0 AS turn FROM a WHERE repo <> 'repo1' OR r <= 100 UNION ALL SELECT repo, number, pr_id, 1 FROM ({_SN} = 'P')) SELECT repo, number, pr_id FROM k QUALIFY row_number() OVER (PARTITION BY repo, number ORDER BY turn, {_DRAWN}, pr_id) = 1")
def rebuilt_set(spark, d):
    seed, rows = seed_new(spark, d)
    return requests.rebuilt(rows, seed, "repo", "repo1", 100, ["repo", "number"], [stats.draw("pr_id"), F.col("pr_id")])


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.n_chars END, e.value) AS n_chars FROM documents d LEFT JOIN (SELECT user_id, CAST(floor(arg_min(value, event_id)) AS BIGINT) AS value FROM events GROUP BY 1) e ON e.user_id = d.doc_id")
def attach_first(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n_chars"))
    more = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("long").alias("n_chars"), "event_id")
    return requests.attach(docs, more, "doc_id", ["n_chars"], [F.col("event_id")])


@query(f"SELECT e.doc_id, l.quality, l.toxic FROM (SELECT doc_id, doc_id || '.0' AS id FROM documents) e LEFT JOIN labels l ON regexp_replace(e.id, '\\.0$', '') = CAST(l.doc_id AS VARCHAR)")
def error_join(spark, d):
    left = t(spark, d, "documents").select("doc_id", text.id_text(F.concat(F.col("doc_id").cast("string"), F.lit(".0"))).alias("id"))
    return left.join(t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic"), "id", "left").select("doc_id", "quality", "toxic")


@query("SELECT l.l_orderkey, l.l_linenumber, o.n FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) o USING (l_orderkey, l_linenumber)")
def two_key_join(spark, d):
    li = t(spark, d, "lineitem")
    right = li.where("l_returnflag = 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return li.select("l_orderkey", "l_linenumber").join(right, ["l_orderkey", "l_linenumber"], "left")


_HIT = "regexp_matches(lower(p_name), 'ring|steel') OR regexp_matches(lower(p_name), 'small')"


@query(f"SELECT repo, number FROM (SELECT DISTINCT p_type AS repo, p_partkey AS number FROM part WHERE {_HIT}) WHERE number % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY md5(number || '-42'), number) <= 20")
def keyword_harvest(spark, d):
    listed = t(spark, d, "part").select(F.col("p_type").alias("repo"), F.col("p_partkey").alias("number"), F.col("p_name").alias("text"))
    known = listed.where("number % 4 = 0")
    return requests.harvest(listed, known, [["ring", "steel"], ["small"]], 20, draw=[stats.draw("number"), F.col("number")]).select("repo", "number")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o_orderkey AND l.l_returnflag = 'A') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_unskipped(spark, d):
    skip = t(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").select("o_orderkey", "o_orderdate").join(skip, "o_orderkey", "left_anti").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 < 2 THEN 0 ELSE 1 END AS turn FROM orders ORDER BY turn, o_custkey % 5, o_orderkey LIMIT 300")
def priority_order(spark, d):
    turn = F.when(F.col("o_custkey") % 5 < 2, 0).otherwise(1)
    return t(spark, d, "orders").orderBy(turn, F.col("o_custkey") % 5, "o_orderkey").limit(300).select("o_orderkey", turn.alias("turn"))


@query("SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), -1) AS value, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS flag FROM events")
def lenient_values(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    value = requests.lenient_float(raw)
    return t(spark, d, "events").select("event_id", F.when(F.isnan(value), -1.0).otherwise(value).alias("value"), requests.as_text(F.col("event_id") % 2 == 0, "boolean").alias("flag"))


# --- diffs ---
@query("SELECT pr_id, path, CAST(len(added) AS BIGINT) AS added FROM (SELECT pr_id, path, list_concat(list(['def g' || pos || '():', '    x = 1'] ORDER BY pos, additions)) AS a, flatten(list(['x', 'y'])) AS added FROM " + FILES + " GROUP BY 1, 2)")
def changed_file_lines(spark, d):
    files = changes(spark, d).select("pr_id", F.explode(deployable.changed_files(F.col("diff"))).alias("f"))
    return files.select("pr_id", "f.path", F.size("f.added").cast("long").alias("added"))


@query(f"SELECT pr_id, pos, array_to_string([additions], ',') AS starts FROM {FILES} QUALIFY row_number() OVER (PARTITION BY pr_id, path ORDER BY pos, additions || ',') = 1")
def target_hunks(spark, d):
    first = lines(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("pr_id", "path").orderBy("pos", F.concat(F.col("additions").cast("string"), F.lit(","))))).where("r = 1")
    rows = first.join(changes(spark, d), "pr_id")
    return rows.select("pr_id", "pos", F.array_join(diffs.new_lines(F.col("diff"), F.col("path")).cast("array<string>"), ",").alias("starts"))


@query()
def diff_features(spark, d):
    return deployable.features(changes(spark, d), 157.0)


# --- evaluation ---
def runs(spark, d):
    """Events as answers: user and kind of event are prompt and context."""
    k = F.col("event_id")
    return t(spark, d, "events").select(
        k.alias("run"), F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string")).alias("prompt"), F.concat(F.lit("C"), F.length("event_type").cast("string")).alias("context"), (k % 9 != 0).alias("parsed"),
        (k % 3 == 0).cast("int").alias("label"), (F.col("value") > 50).cast("int").alias("guess"), (F.floor(F.col("value")) % 100 / 100.0).alias("probability"), (F.col("user_id") % 1000).cast("double").alias("duration"),
    )


RUNS = "(SELECT event_id AS run, 'P' || (user_id % 4) AS prompt, 'C' || length(event_type) AS context, event_id % 9 <> 0 AS parsed, (event_id % 3 = 0)::INTEGER AS label, (value > 50)::INTEGER AS guess, (CAST(floor(value) AS BIGINT) % 100) / 100.0::DOUBLE AS probability, (user_id % 1000)::DOUBLE AS duration FROM events)"


def _r(a, b):
    return f"coalesce(({a}) / nullif(({b}), 0)::DOUBLE, 0)"


COMBOS = f"""(SELECT c.*, a.roc_auc, round({_r('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy, round({_r('2 * tp', '2 * tp + fp + fn')}, 4) AS f1, round({_r('tn', 'tn + fp')}, 4) AS specificity, round({_r('fp', 'fp + tn')}, 4) AS fpr FROM (SELECT prompt, context, count(*) FILTER (parsed) AS n_valid, count(*) AS n_total, round(avg((NOT parsed)::INTEGER), 4) AS parse_fail_rate, round(avg(probability) FILTER (parsed), 4) AS avg_probability, round(avg(duration) FILTER (parsed)) AS avg_duration,
 count(*) FILTER (parsed AND label = 0 AND guess = 0) AS tn, count(*) FILTER (parsed AND label = 0 AND guess = 1) AS fp, count(*) FILTER (parsed AND label = 1 AND guess = 0) AS fn, count(*) FILTER (parsed AND label = 1 AND guess = 1) AS tp FROM {RUNS} GROUP BY 1, 2) c
 LEFT JOIN (SELECT prompt, context, round((sum(mid * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * sum(1 - label), 0)::DOUBLE, 6) AS roc_auc FROM (SELECT *, (2 * rank() OVER (PARTITION BY prompt, context ORDER BY probability) + count(*) OVER (PARTITION BY prompt, context, probability) - 1) / 2.0::DOUBLE AS mid FROM {RUNS} WHERE parsed) GROUP BY 1, 2) a USING (prompt, context))"""


@query(f"SELECT prompt, context, n_valid, n_total, parse_fail_rate, avg_probability, avg_duration, accuracy, f1, specificity, roc_auc FROM {COMBOS}")
def combo_metrics(spark, d):
    return evaluation.combos(runs(spark, d), ["prompt", "context"]).select("prompt", "context", "n_valid", "n_total", "parse_fail_rate", "avg_probability", "avg_duration", "accuracy", "f1", "specificity", "roc_auc")


@query(f"""WITH c AS (SELECT prompt || context AS combo, CASE WHEN prompt < 'P2' THEN 'baseline' ELSE 'improved' END AS "group", specificity, fpr, f1 FROM {COMBOS}), b AS (SELECT * FROM c WHERE combo = 'P0C4')
SELECT c.*, round(c.specificity - b.specificity, 4) AS specificity_delta, round(c.fpr - b.fpr, 4) AS fpr_delta, round(c.f1 - b.f1, 4) AS f1_delta, c.specificity >= b.specificity + 0.2::DOUBLE AS specificity_passed, c.fpr <= b.fpr - 0.2::DOUBLE AS fpr_passed, c.f1 >= b.f1 * 0.85::DOUBLE AS f1_passed FROM c, b""")
def combo_comparison(spark, d):
    c = evaluation.combos(runs(spark, d), ["prompt", "context"]).select(F.concat("prompt", "context").alias("combo"), "prompt", "specificity", "fpr", "f1")
    return evaluation.compared(c.where("prompt < 'P2'").drop("prompt"), c.where("prompt >= 'P2'").drop("prompt"), "P0C4", ["specificity", "fpr", "f1"])


@query(f"SELECT prompt, quantile_cont(duration, 0.25) AS q25, quantile_cont(duration, 0.5) AS median, quantile_cont(duration, 0.75) AS q75, round(avg((NOT parsed)::INTEGER), 6) AS parse_fail_rate FROM {RUNS} GROUP BY 1")
def latency_box(spark, d):
    x = runs(spark, d)
    boxes = ranks.quantiles(x, ["duration"], [0.25, 0.5, 0.75], ["prompt"])
    failed = x.groupBy("prompt").agg(F.round(F.avg((~F.col("parsed")).cast("int")), 6).alias("parse_fail_rate"))
    return failed.join(boxes, "prompt", "left").select("prompt", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "parse_fail_rate")


@query(f"SELECT prompt, CAST(len(v) AS BIGINT) AS runs, v[len(v) // 2 + 1] AS median, v[least(CAST(floor(len(v) * 0.95::DOUBLE) AS INTEGER), len(v) - 1) + 1] AS p95 FROM (SELECT prompt, list_sort(list(duration)) AS v FROM (SELECT * FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY run) > 1) GROUP BY 1)")
def warm_timings(spark, d):
    return evaluation.warm_times(runs(spark, d), "prompt", "run", "duration")


def said(spark, d):
    """Turns of a conversation as comments on the document of its number."""
    level = F.element_at(F.array(*map(F.lit, evaluation.SEVERITIES)), (F.col("turn") % 4 + 1).cast("int"))
    rows = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", level.alias("severity"), F.concat(F.col("text"), F.lit(" please check the file")).alias("comment")))).alias("comments"))
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("reference"), F.col("source").alias("method"))
    factors = F.array(F.lit("missing check"), F.lit("zzzz"), F.concat(F.lit("file "), F.col("conv_id").cast("string")))
    return rows.join(docs, "conv_id").withColumn("factors", factors)


SAID = f"""(SELECT c.conv_id, d.source AS method, c.comments, c.levels, CASE WHEN doc_id % 3 > 0 THEN d.text END AS reference, ['missing check', 'zzzz', 'file ' || conv_id] AS factors FROM
 (SELECT conv_id, list(text || ' please check the file' ORDER BY turn) AS comments, list({_words(evaluation.SEVERITIES)}[(turn % 4 + 1)::INTEGER] ORDER BY turn) AS levels FROM conversations GROUP BY 1) c JOIN documents d ON d.doc_id = c.conv_id)"""
_TOKENS = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '')"
QUALITY = f"""(SELECT *, len(own) > 0 AND len(ref) > 0 AS paired, list_distinct(list_transform(list_filter(list_zip(own, own[2:]), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL), lambda z: z[1] || ' ' || z[2])) AS own2, list_distinct(list_transform(list_filter(list_zip(ref, ref[2:]), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL), lambda z: z[1] || ' ' || z[2])) AS ref2
 FROM (SELECT *, lower(array_to_string(comments, ' ')) AS whole, {_TOKENS.format(c="array_to_string(comments, ' ')")} AS own, {_TOKENS.format(c="coalesce(reference, '')")} AS ref FROM {SAID}))"""


@query(f"""SELECT method, round(coalesce(avg(len(list_filter(own, lambda w: list_contains(ref, w))) / len(own)::DOUBLE) FILTER (paired), 0), 4) AS avg_bleu, round(coalesce(avg(len(list_intersect(own, ref)) / len(own)::DOUBLE) FILTER (paired), 0), 4) AS avg_rouge1, round(coalesce(avg(len(list_intersect(own2, ref2)) / nullif(len(own2), 0)::DOUBLE) FILTER (paired), 0), 4) AS avg_rouge2,
 round(avg(len(list_filter(factors, lambda f: len(list_filter(string_split(f, ' '), lambda w: contains(whole, w))) > 0)) / 3.0::DOUBLE), 4) AS avg_risk_coverage, round(avg(least(1, len(list_filter({_words(evaluation.ACTION)}, lambda w: contains(whole, w))) / len(comments)::DOUBLE)), 4) AS avg_actionability,
 round(avg(least(1, len(list_filter({_words(evaluation.DETAIL)}, lambda w: contains(whole, w))) / len(comments)::DOUBLE)), 4) AS avg_specificity, count(*) FILTER (len(ref) > 0) AS n_with_real, count(*) FILTER (paired) AS n_generated, CAST(sum(len(comments)) AS BIGINT) AS total_comments,
 {', '.join(f"CAST(sum(len(list_filter(levels, lambda s: s = '{s}'))) AS BIGINT) AS {s}_count" for s in evaluation.SEVERITIES)}, round(sum(len(list_filter(levels, lambda s: s IN ('blocker', 'major')))) / greatest(sum(len(comments)), 1)::DOUBLE, 4) AS blocker_major_ratio, round(sum(len(comments)) / greatest(count(*) FILTER (paired), 1)::DOUBLE, 1) AS avg_comments_per_pr FROM {QUALITY} GROUP BY 1""")
def comment_quality(spark, d):
    return evaluation.comment_quality(said(spark, d), ["method"])


@query(f"SELECT CASE WHEN len(ref) = 0 THEN 'none' ELSE 'some' END AS real, count(*) AS requests, CAST(sum(len(comments)) AS BIGINT) AS comments, round(avg(len(comments)), 4) AS mean FROM {QUALITY} GROUP BY 1")
def unreferenced_comments(spark, d):
    real = F.when(F.size(text.lower_tokens(F.coalesce("reference", F.lit("")))) == 0, "none").otherwise("some")
    return said(spark, d).groupBy(real.alias("real")).agg(F.count("*").alias("requests"), F.sum(F.size("comments")).alias("comments"), F.round(F.avg(F.size("comments")), 4).alias("mean"))


@query(f"SELECT level AS severity, count(*) AS n FROM (SELECT unnest(levels) AS level FROM {SAID}) GROUP BY 1")
def severity_counts(spark, d):
    return said(spark, d).select(F.explode("comments").alias("c")).groupBy(F.col("c.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id AS pr_id, round(len(list_filter(own, lambda w: list_contains(ref, w))) / len(own)::DOUBLE, 6) AS bleu, substr(array_to_string(comments, ' '), 1, 500) AS generated FROM {QUALITY} WHERE paired ORDER BY bleu DESC, pr_id LIMIT 5")
def best_examples(spark, d):
    whole = F.array_join(F.transform("comments", lambda c: c["comment"]), " ")
    rows = said(spark, d).select(F.col("conv_id").alias("pr_id"), whole.alias("generated"), text.lower_tokens(whole).alias("a"), text.lower_tokens(F.coalesce("reference", F.lit(""))).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    return evaluation.best_examples(rows.select("pr_id", F.round(evaluation.precision_words(F.col("a"), F.col("b")), 6).alias("bleu"), "generated"), 5)


@query("WITH w AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda x: x <> '')) AS t FROM documents) SELECT a.doc_id, CASE WHEN len(a.t) = 0 THEN 0 ELSE round(len(list_intersect(a.t, b.t)) / len(a.t)::DOUBLE, 6) END AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def title_overlaps(spark, d):
    w = t(spark, d, "documents").select("doc_id", text.lower_tokens(F.split("text", "\n")[0]).alias("t"))
    return w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("o")), "doc_id").select("doc_id", F.round(evaluation.title_overlap(F.col("t"), F.col("o")), 6).alias("overlap"))


# --- contexts ---
def asked(spark, d):
    files = F.array_sort(F.collect_list(F.struct("pos", "path", F.lit("modified").alias("status"), "additions", "deletions", F.concat(F.lit("export x"), F.col("pos").cast("string")).alias("added"))))
    rows = lines(spark, d).groupBy("pr_id").agg(files.alias("files"), F.sum("additions").alias("total_additions"), F.sum("deletions").alias("total_deletions"))
    return rows.join(detail(spark, d).select("pr_id", "repo", "title", "body", "merged"), "pr_id").withColumns({"commit_messages": F.lit("fix it"), "num_commits": F.size("files")})


@query(f"""SELECT pr_id, tests = 0 AS missing_tests, n > 10 AS large_scope, additions > 500 AS large_additions, config > 0 AS config_change, coalesce(length(body), 0) < 100 AS short_description, contains(lower(title || ' ' || coalesce(body, '')), 'generated by') AS traces, docs = 0 AS no_docs FROM
 (SELECT pr_id, count(*) AS n, sum(additions) AS additions, count(*) FILTER (regexp_matches(lower(path), 'test|spec')) AS tests, count(*) FILTER (path LIKE '%.json') AS config, count(*) FILTER (regexp_matches(lower(path), 'doc|readme|changelog|\\.md|\\.rst')) AS docs FROM {FILES} GROUP BY 1) JOIN {DETAIL} USING (pr_id)""")
def risk_checklist(spark, d):
    x = asked(spark, d).withColumn("c", contexts.checklist(F.col("files"), F.col("title"), F.col("body"), F.col("total_additions"), F.col("commit_messages")))
    has = {"missing_tests": "MISSING_TESTS", "large_scope": "LARGE_SCOPE", "large_additions": "LARGE_ADDITIONS", "config_change": "CONFIG_DEP_CHANGE", "short_description": "SHORT_DESCRIPTION", "traces": "AI_TOOL_TRACES", "no_docs": "API_CHANGE_NO_DOCS"}
    return x.select("pr_id", *[F.col("c").contains(v).alias(k) for k, v in has.items()])


_COUNTS = ", ".join(f"(CASE WHEN quality = 0 THEN len(regexp_extract_all(lower(coalesce(string_split(text, chr(10))[1], '')), '{w}')) ELSE 0 END) AS k{i}" for i, w in enumerate(contexts.CLOSED_FOR))
_KEPT = ", ".join(f"CASE WHEN sk{i} - k{i} >= 2 THEN '{w}(x' || CAST(sk{i} - k{i} AS BIGINT) || ')' END" for i, w in enumerate(contexts.CLOSED_FOR))
POLICY = f"""(WITH o AS (SELECT doc_id, source AS repo, quality, toxic, {_COUNTS}, (trim(text) <> '')::INTEGER AS rv, CASE WHEN trim(text) <> '' THEN length(text) ELSE 0 END AS rc, ({_any('text', contexts.POLICY)})::INTEGER AS sg FROM ({LABELLED})),
 s AS (SELECT *, count(*) OVER w - 1 AS others, sum(quality) OVER w - quality AS m, sum(rv) OVER w - rv AS r, sum(rc) OVER w - rc AS c, sum(sg) OVER w - sg AS g, {', '.join(f'sum(k{i}) OVER w AS sk{i}' for i in range(len(contexts.CLOSED_FOR)))} FROM o WINDOW w AS (PARTITION BY repo))
 SELECT repo, doc_id, others, round(m / nullif(others, 0)::DOUBLE, 4) AS merge_rate, round(r / nullif(others, 0)::DOUBLE, 4) AS review_ratio, coalesce(round(c / nullif(r, 0)::DOUBLE, 4), 0) AS review_length, array_to_string(list_filter([{_KEPT}], lambda x: x IS NOT NULL)[:8], ', ') AS closed_for, g > 0 AS policy_signs FROM s)"""


def policy_rows(spark, d):
    return labelled(spark, d).select("doc_id", F.col("source").alias("repo"), (F.col("quality") == 1).alias("merged"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("review"))


@query(f"SELECT * FROM {POLICY}")
def policy_figures(spark, d):
    return contexts.policy_figures(policy_rows(spark, d), key="doc_id")


@query(f"SELECT doc_id, length(c) AS chars, c LIKE '%Few requests are merged here.' AS strict FROM (SELECT doc_id, CASE WHEN others > 0 THEN concat_ws(chr(10), '## Repository Policy', 'Repository: ' || repo, 'Earlier requests here, without this one: ' || others, 'Merge rate: ' || printf('%.1f%%', 100 * merge_rate), 'With review comments: ' || printf('%.1f%%', 100 * review_ratio), CASE WHEN closed_for <> '' THEN 'Common in unmerged requests: ' || closed_for END, CASE WHEN policy_signs THEN 'Generated code has been a matter of discussion here.' END, 'Average review length: ' || CAST(CAST(round(review_length) AS BIGINT) AS VARCHAR) || ' characters', CASE WHEN merge_rate < 0.5 THEN 'Few requests are merged here.' END) ELSE '## Repository Policy' || chr(10) || 'No history of this repository.' END AS c FROM {POLICY})")
def policy_context(spark, d):
    c = F.col
    x = policy_figures(spark, d).withColumn("c", contexts.policy_text(c("repo"), c("others"), c("merge_rate"), c("review_ratio"), c("review_length"), c("closed_for"), c("policy_signs")))
    return x.select("doc_id", F.length("c").cast("long").alias("chars"), F.col("c").endswith("Few requests are merged here.").alias("strict"))


@query(f"SELECT pr_id, repo, files, true AS titled FROM (SELECT pr_id, count(*) AS files FROM {FILES} GROUP BY 1) JOIN {DETAIL} USING (pr_id)")
def base_context(spark, d):
    x = asked(spark, d).withColumn("c", contexts.base("C2"))
    return x.select("pr_id", F.regexp_extract("c", r"(?m)^Repository: (.*)$", 1).alias("repo"), F.regexp_count("c", F.lit(r"(?m)^- \[modified\]")).cast("long").alias("files"), F.col("c").contains("## PR Title").alias("titled"))


_NAMED = "text || CASE doc_id % 4 WHEN 0 THEN ' Merge_Status: open' WHEN 1 THEN ' num_reviewers of it' ELSE '' END"


@query(f"SELECT doc_id, array_to_string(list_filter({_words(contexts.FORBIDDEN + contexts.SUSPICIOUS)}, lambda w: contains(lower(coalesce({_NAMED}, '')), w)), ',') AS leaks FROM documents")
def leakage_lint(spark, d):
    named = F.concat(F.col("text"), F.when(F.col("doc_id") % 4 == 0, " Merge_Status: open").when(F.col("doc_id") % 4 == 1, " num_reviewers of it").otherwise(""))
    return t(spark, d, "documents").select("doc_id", F.array_join(contexts.leaks(named), ",").alias("leaks"))


@query("SELECT doc_id, prompt, CAST(length(system) AS BIGINT) AS system_chars, CAST(length(replace(u, '{context}', text)) + CASE WHEN few THEN length('Example one') + 2 ELSE 0 END AS BIGINT) AS user_chars FROM documents, (VALUES ('P1', 'You review.', 'Look: {context}', false), ('P2', 'You review.', 'Look: {context} Now.', true)) v(prompt, system, u, few)")
def prompt_messages(spark, d):
    templates = spark.createDataFrame([("P1", "You review.", "Look: {context}", False), ("P2", "You review.", "Look: {context} Now.", True)], "prompt string, system string, user string, few_shot boolean")
    rows = t(spark, d, "documents").select("doc_id", F.col("text").alias("context"), F.lit("Example one").alias("shots"))
    m = contexts.messages(rows, templates, shots="shots")
    return m.select("doc_id", "prompt", F.length(F.col("messages")[0]["content"]).cast("long").alias("system_chars"), F.length(F.col("messages")[1]["content"]).cast("long").alias("user_chars"))


# --- rules and the service ---
def scanned(spark, d):
    """Files whose contents hold marks and debug output on some lines."""
    body = F.concat(F.lit("a = 1\n"), F.when(F.col("pos") % 3 == 0, "# TODO later\n").otherwise(""), F.lit("b = 2\n"), F.when(F.col("deletions") % 4 == 0, "print(b)\n").otherwise(""), F.lit("c = 3"))
    files = lines(spark, d).groupBy("pr_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "additions", body.alias("content")))), lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))).alias("files"))
    return files.join(changes(spark, d), "pr_id")


@query(f"SELECT pr_id, hit_file, rule, severity, line, count(*) AS n FROM (SELECT pr_id, path AS hit_file, 'todo-or-placeholder' AS rule, 'minor' AS severity, 2 AS line FROM {FILES} WHERE pos % 3 = 0 UNION ALL SELECT pr_id, path, 'debug-print', 'minor', CASE WHEN pos % 3 = 0 THEN 4 ELSE 3 END FROM {FILES} WHERE deletions % 4 = 0) GROUP BY ALL")
def first_hit_lines(spark, d):
    x = scanned(spark, d)
    found = service.comments(rules.score(x, F.col("files"), F.col("diff"))).where("hit_file is not null")
    return found.groupBy("pr_id", "hit_file", "rule", "severity", "line").agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT pr_id, count(*) AS n, count(*) FILTER (regexp_matches(path, '(?i)test_|_test\\.|tests?/')) AS tests, count(*) FILTER (path LIKE '%.json') AS config, count(*) FILTER (pos % 3 = 0) AS todo, count(*) FILTER (deletions % 4 = 0) AS debug FROM {FILES} GROUP BY 1) SELECT pr_id, round(least(1, 0.25::DOUBLE * (n - tests > 0 AND tests = 0)::INTEGER + 0.2::DOUBLE * (n > 5 OR 3 * n > 200)::INTEGER + 0.15::DOUBLE * (config > 0 AND config <= n * 0.7::DOUBLE)::INTEGER + 0.2::DOUBLE + 0.1::DOUBLE * todo + 0.1::DOUBLE * debug), 6) AS risk FROM f")
def scanned_risk(spark, d):
    x = scanned(spark, d)
    return rules.score(x, F.col("files"), F.col("diff")).select("pr_id", "risk")


def incoming(spark, d):
    k = F.col("event_id")
    kind = F.when(k % 2 == 0, "file").otherwise("git_diff")
    files = F.when(k % 6 == 0, F.array().cast("array<struct<path:string,content:string>>")).otherwise(F.array(F.struct(F.lit("src/a.py").alias("path"), F.when(k % 4 > 0, F.col("props")).alias("content"))))
    return t(spark, d, "events").select(k.alias("request_id"), F.col("ts").cast("timestamp").alias("time"), kind.alias("kind"), files.alias("files"), F.when(k % 5 > 0, F.concat(F.lit("+x = "), F.col("value").cast("string"))).alias("diff"))


@query("SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 AND event_id % 4 = 0 OR event_id % 2 = 0 AND event_id % 6 = 0 THEN 'kind=file requires at least one file with content' WHEN event_id % 2 = 1 AND event_id % 5 = 0 THEN 'kind=git_diff requires non-empty diff' END AS error FROM events")
def request_errors(spark, d):
    return incoming(spark, d).select("request_id", service.invalid(F.col("kind"), F.transform("files", lambda f: f["content"]), F.col("diff")).alias("error"))


@query("SELECT event_id AS request_id, strftime(ts, '%Y%m%dT%H%M%S') AS timestamp, CASE WHEN event_id % 2 = 0 AND (event_id % 4 = 0 OR event_id % 6 = 0) OR event_id % 2 = 1 AND event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events")
def history_records(spark, d):
    return service.review(incoming(spark, d), True).select("request_id", "timestamp", "status")


# --- features ---
CONTRACT = ["additions", "lines", "absent", "words", "title_chars", "toxic"]
_CONTRACT = "CASE WHEN d.doc_id % 9 > 0 THEN d.n_chars END::DOUBLE AS additions, len(string_split(d.text, chr(10)))::DOUBLE AS lines, len(string_split(d.text, ' '))::DOUBLE AS words, length(string_split(d.text, chr(10))[1])::DOUBLE AS title_chars"


def contract_rows(spark, d):
    """Documents as changes: figures of nine in ten, outcomes of those with a label, and the stratified split."""
    docs = t(spark, d, "documents")
    figures = docs.where("doc_id % 10 > 0").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.when(F.col("doc_id") % 9 > 0, F.col("n_chars")).alias("additions"), F.size(F.split("text", " ")).alias("words"), F.length(F.split("text", "\n")[0]).alias("title_chars"), (F.col("doc_id") % 2).alias("toxic"))
    rows = labelled(spark, d).select("doc_id", "source", "quality", F.col("quality").alias("label"))
    return stages.training_table(figures, rows, stats.stratified_split(rows, "doc_id", ["source", "quality"], ["quality"]), "doc_id", CONTRACT)


@query(f"""WITH t AS (SELECT l.doc_id, l.quality AS label, s.split, coalesce(f.additions, 0) AS additions, coalesce(f.lines, 0) AS lines, 0.0::DOUBLE AS absent, coalesce(f.words, 0) AS words, coalesce(f.title_chars, 0) AS title_chars, coalesce(f.toxic, 0) AS toxic
 FROM ({LABELLED}) l JOIN {_SPLIT} s ON s.doc_id = l.doc_id LEFT JOIN (SELECT d.doc_id, {_CONTRACT}, (d.doc_id % 2)::DOUBLE AS toxic FROM documents d WHERE d.doc_id % 10 > 0) f ON f.doc_id = l.doc_id),
b AS (SELECT {', '.join(f'quantile_cont({c}, 0.9) AS {c}' for c in CONTRACT)} FROM t WHERE split <> 'test')
SELECT t.doc_id, t.label, t.split, {', '.join(f'round(least(t.{c}, b.{c}), 6) AS {c}' for c in CONTRACT)} FROM t, b""")
def training_table(spark, d):
    """The training table as the stored stages make it: aligned to a contract with a name that no table has, cut at bounds of train and val rows."""
    rows = contract_rows(spark, d)
    fitted = stages.Winsorizer(inputCols=CONTRACT, quantile=0.9).fit(rows.where("split <> 'test'"))
    return fitted.transform(stages.Aligner(inputCols=CONTRACT).transform(rows)).select("doc_id", "label", "split", *[F.round(c, 6).alias(c) for c in CONTRACT])


@query()
def refitted_scores(spark, d):
    """Test rows scored by a pipeline that was refitted on train and val, stored and loaded."""
    rows = contract_rows(spark, d)
    place = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    stages.refit(rows, stages.training_pipeline(CONTRACT, ml.model_of("logistic"))).write().save(place)
    return ml.scored(PipelineModel.load(place), rows.where("split = 'test'"), "doc_id")


@query("WITH b AS (SELECT quantile_cont(n_chars, 0.99) AS p FROM documents WHERE doc_id % 10 < 7) SELECT doc_id, least(n_chars::DOUBLE, p) AS n_chars FROM documents, b")
def winsorize_train(spark, d):
    return ml.winsorize(t(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars"], F.col("doc_id") % 10 < 7)


@query(f"SELECT doc_id, quality AS label, CASE WHEN (SELECT avg(quality) FROM ({LABELLED}) WHERE doc_id % 10 < 7) > 0.5 THEN 1 ELSE 0 END AS guess FROM ({LABELLED})")
def majority_baseline(spark, d):
    return ml.majority(labelled(spark, d).select("doc_id", F.col("quality").alias("label")), F.col("doc_id") % 10 < 7).select("doc_id", "label", "guess")


@query("SELECT doc_id, n_chars::DOUBLE AS n_chars, coalesce(quality, 0)::DOUBLE AS quality, 0.0::DOUBLE AS absent FROM documents LEFT JOIN labels USING (doc_id)")
def feature_matrix(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return ml.matrix(rows, ["doc_id"], ["n_chars", "quality", "absent"])


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'supported' WHEN event_type = 'purchase' THEN 'derived' ELSE 'unknown' END AS status, count(*) AS n FROM events GROUP BY 1")
def feature_availability(spark, d):
    return deployable.availability(t(spark, d, "events"), {"view": "supported", "click": "supported", "purchase": "derived"}, "event_type")


@query()
def radial_grid(spark, d):
    """The 18 candidates of the radial-basis grid on train rows, each with its mean area under the ROC curve over five folds, which follow from the keys."""
    rows = contract_rows(spark, d).where("split = 'train'")
    _, tried = stages.radial_svm(rows, CONTRACT, [0.01, 0.1, 1.0], [0.001, 0.01, 0.1], [64, 128], rounds=10, fold=F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    return spark.createDataFrame([(c["gamma"], c["size"], c["regParam"], round(float(a), 6)) for c, a in tried], "gamma double, size int, penalty double, auc double")


@query()
def svm_scores(spark, d):
    rows = labelled(spark, d).select("doc_id", "n_chars", "toxic", F.col("quality").alias("label"))
    return ml.scored(ml.fit(rows.where("doc_id % 10 < 7"), ["n_chars", "toxic"], "svm"), rows, "doc_id").drop("guess")


@query("SELECT doc_id, round(3 * (q.source = c.source)::INTEGER + 2 * exp(-abs(q.f - c.f) / 10.0::DOUBLE) + 2 * exp(-abs(q.n_chars - c.n_chars) / 500.0::DOUBLE) + 2 * CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_intersect(q.t, c.t)) / len(q.t)::DOUBLE END, 4) AS score FROM (SELECT *, len(string_split(text, chr(10))) AS f, list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda x: x <> '')) AS t FROM documents) q JOIN (SELECT doc_id - 1 AS before, source, n_chars, len(string_split(text, chr(10))) AS f, list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda x: x <> '')) AS t FROM documents) c ON c.before = q.doc_id")
def pair_similarity(spark, d):
    own = t(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", "\n")).alias("f"), F.array_distinct(text.lower_tokens(F.split("text", "\n")[0])).alias("t"))
    other = own.select((F.col("doc_id") - 1).alias("doc_id"), *[F.col(c).alias(f"o_{c}") for c in ("source", "n_chars", "f", "t")])
    x = own.join(other, "doc_id")
    s = similarity.similarity(F.col("source") == F.col("o_source"), F.abs(F.col("f") - F.col("o_f")), F.abs(F.col("n_chars") - F.col("o_n_chars")), evaluation.title_overlap(F.col("t"), F.col("o_t")))
    return x.select("doc_id", F.round(s, 4).alias("score"))
