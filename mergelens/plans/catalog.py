"""Named queries of the library over the driver's tables, and their DuckDB twins.

The tables hold no change requests, so documents, orders and conversations stand in: a document is a request (source: its
repository, quality: whether it was merged), an order's lines are its files, and diffs are written inside the query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths, text
from mergelens.operators import metrics, moments, neighbours, ranks, responses, rules, service, similarity, stats
from mergelens.storage import shared_dir
from mergelens.streaming import history

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LABELLED = "SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
GUESSED = f"SELECT *, (n_chars % 1000) / 1000.0::DOUBLE AS score, CASE WHEN n_chars % 1000 >= 500 THEN 1 ELSE 0 END AS guess FROM ({LABELLED})"


def labelled(spark, d):
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")


def guessed(spark, d):
    part = F.col("n_chars") % 1000
    return labelled(spark, d).withColumns({"score": part / F.lit(1000.0), "guess": (part >= 500).cast("int"), "label": F.col("quality")})


# --- descriptive statistics ---
@query(f"SELECT count(*) AS total, count(*) FILTER (quality = 1) AS merged, round(100 * avg(CAST(quality = 1 AS DOUBLE)), 4) AS merged_pct, round(100 * avg(CAST(toxic = 1 AS DOUBLE)), 4) AS flagged_pct FROM ({LABELLED})")
def overall_stats(spark, d):
    return labelled(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("merged"), stats.share(F.col("quality") == 1).alias("merged_pct"), stats.share(F.col("toxic") == 1).alias("flagged_pct"))


@query(f"SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS merged, round(100 * avg(CAST(quality = 1 AS DOUBLE)), 4) AS merged_pct, round(avg(n_chars), 4) AS mean_length FROM ({LABELLED}) GROUP BY source")
def group_stats(spark, d):
    return labelled(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("merged"), stats.share(F.col("quality") == 1).alias("merged_pct"), F.round(F.avg("n_chars"), 4).alias("mean_length")).orderBy("source")


@query(f"SELECT round(avg(n_chars) FILTER (quality = 1), 4) AS merged_length, round(avg(n_chars) FILTER (quality = 0), 4) AS closed_length FROM ({LABELLED})")
def outcome_means(spark, d):
    of = lambda q: F.round(F.avg(F.when(F.col("quality") == q, F.col("n_chars"))), 4)
    return labelled(spark, d).agg(of(1).alias("merged_length"), of(0).alias("closed_length"))


_DIST = "SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"


@query(" UNION ALL ".join(_DIST.format(c=c) for c in ("l_quantity", "l_discount", "l_tax")))
def distribution_stats(spark, d):
    return stats.distribution(t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, label LIMIT 15")
def label_topk(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(15)


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), k AS (SELECT * FROM c ORDER BY n DESC, p_type LIMIT 3) SELECT p_type, n FROM k UNION ALL SELECT 'Other', CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM k) AS BIGINT)")
def topk_with_other(spark, d):
    return stats.top_with_rest(t(spark, d, "part"), "p_type", 3)


@query("SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(trim(p_name), '\\s+'), lambda x: x <> '')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 15")
def exploded_topk(spark, d):
    return t(spark, d, "part").select(F.explode(text.words(F.trim("p_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query(f"SELECT toxic, quality, count(*) AS n, round(100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS pct FROM ({LABELLED}) GROUP BY toxic, quality")
def flag_grid(spark, d):
    c = labelled(spark, d).groupBy("toxic", "quality").agg(F.count("*").alias("n"))
    return c.crossJoin(c.agg(F.sum("n").cast("double").alias("_t"))).select("toxic", "quality", "n", F.round(100 * F.col("n") / F.col("_t"), 4).alias("pct"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_discount, l_tax), 6) AS discount_tax FROM lineitem")
def corr_matrix(spark, d):
    return t(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("quantity_price"), F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax"))


MEASURES = {
    "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber", "parts": "l_partkey % 1000", "suppliers": "CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey END",
    "flagged": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END", "open": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END", "churn": "l_quantity * (1 + l_discount) + l_linenumber", "same": "1", "none": "CASE WHEN l_quantity < 0 THEN 1.0 END",
}
_PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in list(MEASURES)[i + 1 :]]


@query("WITH m AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in MEASURES.items()) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, CASE WHEN min({a}) FILTER ({b} IS NOT NULL) < max({a}) FILTER ({b} IS NOT NULL) AND min({b}) FILTER ({a} IS NOT NULL) < max({b}) FILTER ({a} IS NOT NULL) THEN round(corr({a}, {b}), 6) END AS correlation FROM m" for a, b in _PAIRS))
def correlation_pairs(spark, d):
    """All pairs of twelve measures, some with missing values, one constant, one without any."""
    rows = t(spark, d, "lineitem").select(*[F.expr(v).cast("double").alias(k) for k, v in MEASURES.items()])
    return moments.correlations(rows, list(MEASURES)).withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@query("WITH p AS (SELECT quantile_cont(n_chars, 0.99) AS top FROM documents) SELECT CAST(least(29, floor(30 * n_chars / top)) AS BIGINT) AS bin, count(*) AS n FROM documents, p WHERE n_chars <= top GROUP BY 1")
def trimmed_histogram(spark, d):
    docs = t(spark, d, "documents")
    top = ranks.bounds(docs, ["n_chars"], 0.99).withColumnRenamed("n_chars", "top")
    return docs.crossJoin(top).where("n_chars <= top").groupBy(F.least(F.lit(29), F.floor(30 * F.col("n_chars") / F.col("top"))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def heatmap_pivot(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF("o_orderpriority", "f", "o", "p")


@query("SELECT lang, quantile_cont(n_chars, 0.5) AS median, round(avg(CAST(n_chars > 10000 AS DOUBLE)), 6) AS over FROM documents GROUP BY 1")
def context_length_stats(spark, d):
    docs = t(spark, d, "documents")
    over = docs.groupBy("lang").agg(F.round(F.avg((F.col("n_chars") > 10000).cast("double")), 6).alias("over"))
    return over.join(ranks.quantiles(docs, ["n_chars"], [0.5], ["lang"]), "lang", "left").select("lang", F.col("q")[0].alias("median"), "over")


# --- texts ---
_CTRL = "regexp_replace(coalesce({c}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g')"


@query("SELECT doc_id, CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '...' ELSE x END AS clean FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n|\\n|\\r', '\\\\n', 'g') AS x FROM documents)")
def clean_text_v1(spark, d):
    return t(spark, d, "documents").select("doc_id", text.escape_newlines(F.col("text"), 500).alias("clean"))


@query(f"SELECT doc_id, substr(regexp_replace(regexp_replace({_CTRL.format(c='text')}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 1, 3000) AS clean FROM documents")
def clean_text_v2(spark, d):
    return t(spark, d, "documents").select("doc_id", text.strip_controls(F.col("text"), 3000).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || '... [truncated]' ELSE text END AS cut FROM documents")
def truncate_text(spark, d):
    return t(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 200).alias("cut"))


@query("SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words, CAST(trim(text) = '' AS INTEGER) AS blank FROM documents")
def text_features(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), text.word_count(F.col("text")).alias("words"), text.is_blank(F.col("text")).alias("blank"))


@query("SELECT doc_id, CAST(regexp_matches(text, '(?i)(#\\d+|issues?/\\d+|pull/\\d+|bugs?/\\d+)') AS INTEGER) AS issue, CAST(regexp_matches(text, '(?i)release.?note|changelog|breaking.?change') AS INTEGER) AS release FROM documents")
def regex_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", text.has_issue_link(F.col("text")).alias("issue"), text.has_release_note(F.col("text")).alias("release"))


@query("SELECT doc_id, CAST(floor(l * 1.3::DOUBLE) + (length(text) - a) // 2 AS BIGINT) AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[a-zA-Z]+')) AS l, len(regexp_extract_all(text, '[a-zA-Z\\s]')) AS a FROM documents)")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, sha256(html) AS digest, substr(sha256(html), 1, 16) AS short FROM pages")
def content_sha256(spark, d):
    h = F.sha2("html", 256)
    return t(spark, d, "pages").select("page_id", h.alias("digest"), F.substring(h, 1, 16).alias("short"))


@query("SELECT doc_id, CAST(regexp_matches(lower(text), 'the|ent') AS INTEGER) AS part, CAST(regexp_matches(lower(text), '\\b(the|ent)\\b') AS INTEGER) AS word FROM documents")
def keyword_match(spark, d):
    f = lambda w: text.contains_any(F.col("text"), ["the", "ent"], w).cast("int")
    return t(spark, d, "documents").select("doc_id", f(False).alias("part"), f(True).alias("word"))


# --- coercions and validation ---
@query("SELECT o_orderkey, s IN ('true', '1', 'yes') AS flag FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE '1' END AS s FROM orders)")
def bool_coerce(spark, d):
    k = F.col("o_orderkey") % 4
    return t(spark, d, "orders").select("o_orderkey", text.to_flag(F.when(k == 0, " TRUE").when(k == 1, "yes ").when(k == 2, "no").otherwise("1")).alias("flag"))


@query("SELECT o_orderkey, greatest(coalesce(try_cast(s AS DOUBLE), 0), 0) AS value FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN '-5' ELSE CAST(o_orderkey AS VARCHAR) END AS s FROM orders)")
def num_coerce(spark, d):
    k = F.col("o_orderkey") % 3
    return t(spark, d, "orders").select("o_orderkey", text.to_count(F.when(k == 0, "n/a").when(k == 1, "-5").otherwise(F.col("o_orderkey").cast("string"))).alias("value"))


@query("SELECT o_orderkey, regexp_replace(o_orderkey || '.0', '\\.0$', '') AS id FROM orders")
def id_normalise(spark, d):
    return t(spark, d, "orders").select("o_orderkey", text.id_text(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("id"))


@query("SELECT event_id, CASE WHEN event_type = 'click' AND value < 50 THEN 'content required' WHEN value > 1000 THEN 'out of range' END AS error FROM events")
def validate_requests(spark, d):
    return t(spark, d, "events").select("event_id", F.when((F.col("event_type") == "click") & (F.col("value") < 50), "content required").when(F.col("value") > 1000, "out of range").alias("error"))


@query("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed_not_merged' END AS merge_status FROM orders")
def merge_status(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", s, F.when(s == "F", "merged").when(s == "O", "open").otherwise("closed_not_merged").alias("merge_status"))


@query("SELECT event_id, CASE WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS by_rule, CASE WHEN p < 0.3 THEN 'high' WHEN p < 0.6 THEN 'medium' ELSE 'low' END AS by_probability FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS p FROM events)")
def risk_bands(spark, d):
    p = (F.col("event_id") % 100) / F.lit(100.0)
    return t(spark, d, "events").select("event_id", text.rule_band(p).alias("by_rule"), text.probability_band(p).alias("by_probability"))


@query("SELECT l_orderkey, l_linenumber, (l_returnflag = 'A')::INTEGER AS flag_a, (l_returnflag = 'N')::INTEGER AS flag_n, (l_returnflag = 'R')::INTEGER AS flag_r FROM lineitem")
def one_hot(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[(F.col("l_returnflag") == v).cast("int").alias(f"flag_{v.lower()}") for v in "ANR"])


# --- paths ---
def lines(spark, d):
    ext = F.when(F.col("l_returnflag") == "A", ".py").when(F.col("l_returnflag") == "N", F.when(F.col("l_linenumber") % 2 == 0, ".json").otherwise(".md")).otherwise(F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(".go"))
    folder = F.when(F.col("l_partkey") % 5 == 0, "tests").when(F.col("l_partkey") % 5 == 1, "docs").otherwise("src")
    base = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("test_"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("m"), F.col("l_partkey").cast("string")))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr_id"), F.col("l_linenumber").alias("pos"), F.concat_ws("/", folder, F.concat(base, ext)).alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.floor(F.col("l_discount") * 100 + 0.5).cast("long").alias("deletions"))


FILES = """(SELECT l_orderkey AS pr_id, l_linenumber AS pos, (CASE l_partkey % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'docs' ELSE 'src' END) || '/' || (CASE WHEN l_partkey % 7 = 0 THEN 'test_' ELSE 'm' END) || l_partkey
 || (CASE WHEN l_returnflag = 'A' THEN '.py' WHEN l_returnflag = 'N' THEN (CASE WHEN l_linenumber % 2 = 0 THEN '.json' ELSE '.md' END) ELSE (CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '.go' END) END) AS path,
 CAST(l_quantity AS BIGINT) AS additions, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS deletions FROM lineitem)"""
_SUF = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_KIND = f"CASE WHEN {_SUF} IN ('.py', '.go') THEN 'code' WHEN {_SUF} = '.json' THEN 'config' WHEN {_SUF} = '.md' THEN 'doc' ELSE 'other' END"


@query(f"SELECT pr_id, pos, path, regexp_extract(path, '[^/]*$') AS name, {_SUF} AS suffix FROM {FILES}")
def path_parts(spark, d):
    return lines(spark, d).select("pr_id", "pos", "path", paths.name(F.col("path")).alias("name"), paths.suffix(F.col("path")).alias("suffix"))


@query(f"SELECT pr_id, pos, {_KIND} AS kind FROM {FILES}")
def file_type_v1(spark, d):
    return lines(spark, d).select("pr_id", "pos", paths.kind(F.col("path")).alias("kind"))


@query(f"SELECT pr_id, pos, CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 'test' WHEN {_SUF} = '.md' THEN 'doc' WHEN {_SUF} = '.json' THEN 'config' WHEN {_SUF} <> '' THEN 'code' ELSE 'other' END AS kind FROM {FILES}")
def file_type_v2(spark, d):
    return lines(spark, d).select("pr_id", "pos", paths.exclusive_kind(F.col("path")).alias("kind"))


@query(f"SELECT pr_id, pos, path LIKE 'tests/%' OR path LIKE '%/test\\_%' ESCAPE '\\' AS markers, regexp_matches(lower(path), 'test|spec') AS part, regexp_matches(path, '(?i)test_|_test\\.|tests?/') AS pattern FROM {FILES}")
def test_file_rules(spark, d):
    p = F.col("path")
    return lines(spark, d).select("pr_id", "pos", paths.is_test(p).alias("markers"), paths.is_test_part(p).alias("part"), paths.is_test_pattern(p).alias("pattern"))


@query(f"SELECT pr_id, pos, path LIKE '%.json%' AS part, path LIKE '%.json' AS pattern FROM {FILES}")
def config_file_rules(spark, d):
    p = F.col("path")
    return lines(spark, d).select("pr_id", "pos", paths.is_config_part(p).alias("part"), paths.is_config_pattern(p).alias("pattern"))


@query(f"SELECT pr_id, max(CASE WHEN {_SUF} = '.py' THEN 1 ELSE 0 END) AS has_py, max(CASE WHEN {_SUF} = '.go' THEN 1 ELSE 0 END) AS has_go FROM {FILES} GROUP BY 1")
def language_flags(spark, d):
    has = lambda s: F.max((paths.suffix(F.col("path")) == s).cast("int"))
    return lines(spark, d).groupBy("pr_id").agg(has(".py").alias("has_py"), has(".go").alias("has_go"))


@query(f"SELECT pr_id, arg_min(s, (-n, f, s)) AS main FROM (SELECT pr_id, {_SUF} AS s, count(*) AS n, min(pos) AS f FROM {FILES} GROUP BY 1, 2) GROUP BY 1")
def main_language(spark, d):
    c = lines(spark, d).groupBy("pr_id", paths.suffix(F.col("path")).alias("s")).agg(F.count("*").alias("n"), F.min("pos").alias("f"))
    return c.groupBy("pr_id").agg(F.min_by("s", F.struct(-F.col("n"), F.col("f"), F.col("s"))).alias("main"))


@query(f"SELECT pr_id, count(*) AS files, CAST(sum(additions + deletions) AS BIGINT) AS churn, count(*) FILTER ({_KIND} = 'code') AS code, round(count(*) FILTER ({_KIND} = 'code') / CAST(count(*) AS DOUBLE), 6) AS code_share, round(sum(additions) / CAST(count(*) AS DOUBLE), 6) AS additions_per_file FROM {FILES} GROUP BY 1")
def file_rollup(spark, d):
    code = F.count_if(paths.kind(F.col("path")) == "code")
    n = F.count("*")
    return lines(spark, d).groupBy("pr_id").agg(n.alias("files"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"), code.alias("code"), F.round(code / n, 6).alias("code_share"), F.round(F.sum("additions") / n, 6).alias("additions_per_file"))


@query(f"SELECT {_SUF} AS suffix, count(*) AS n FROM {FILES} GROUP BY 1 ORDER BY n DESC, suffix LIMIT 30")
def extension_topk(spark, d):
    return lines(spark, d).groupBy(paths.suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(30)


# --- diffs ---
def changes(spark, d):
    """One diff per order: a section for each file."""
    part = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,2 +"), F.col("additions").cast("string"), F.lit(",3 @@ def f"), F.col("pos").cast("string"), F.lit("(x):\n+def g"), F.col("pos").cast("string"), F.lit("():\n+    x = 1\n-    y = 2\n context"))
    return lines(spark, d).select("pr_id", "pos", "path", part.alias("s")).groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path", "s"))), lambda x: x["s"]), "\n").alias("diff"))


CHANGES = f"""(SELECT pr_id, string_agg('diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,2 +' || additions || ',3 @@ def f' || pos || '(x):' || chr(10) || '+def g' || pos || '():' || chr(10) || '+    x = 1' || chr(10) || '-    y = 2' || chr(10) || ' context', chr(10) ORDER BY pos, path, additions || ',') AS diff FROM {FILES} GROUP BY pr_id)"""
_ADDED = "list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))"


@query(f"SELECT pr_id, CAST(len({_ADDED}) AS BIGINT) AS n, array_to_string(list_transform({_ADDED}, lambda x: substr(x, 2)), chr(10)) AS added FROM {CHANGES}")
def added_lines(spark, d):
    a = diffs.added_lines(F.col("diff"))
    return changes(spark, d).select("pr_id", F.size(a).cast("long").alias("n"), F.array_join(a, "\n").alias("added"))


@query(f"SELECT pr_id, CAST(len({_ADDED}) AS BIGINT) AS additions, CAST(len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '-') AND NOT starts_with(x, '---'))) AS BIGINT) AS deletions FROM {CHANGES}")
def diff_stats(spark, d):
    return changes(spark, d).select("pr_id", diffs.additions(F.col("diff")).alias("additions"), diffs.deletions(F.col("diff")).alias("deletions"))


@query(f"SELECT pr_id, unnest(regexp_extract_all(diff, '(?m)^\\+\\+\\+ b/(.+)$', 1)) AS path FROM {CHANGES}")
def diff_paths(spark, d):
    return changes(spark, d).select("pr_id", F.explode(diffs.paths(F.col("diff"))).alias("path"))


@query(f"SELECT pr_id, array_to_string(regexp_extract_all(diff, '(?m)^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1), ',') AS starts FROM {CHANGES}")
def hunk_starts(spark, d):
    return changes(spark, d).select("pr_id", F.array_join(diffs.hunk_starts(F.col("diff")).cast("array<string>"), ",").alias("starts"))


@query(f"SELECT pr_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(diff, '(?m)^@@ [^@]*@@.*?(\\w+)\\s*\\(', 1), regexp_extract_all(diff, '(?m)^\\+\\s*(?:def|class)\\s+(\\w+)', 1)))), ',') AS functions FROM {CHANGES}")
def modified_functions(spark, d):
    return changes(spark, d).select("pr_id", F.array_join(diffs.modified_functions(F.col("diff")), ",").alias("functions"))


@query(f"SELECT pr_id, path, count(*) AS added FROM (SELECT pr_id, x, last_value(CASE WHEN starts_with(x, '+++ b/') THEN substr(x, 7) WHEN starts_with(x, 'diff --git ') THEN regexp_extract(x, ' b/(.+)$', 1) END IGNORE NULLS) OVER (PARTITION BY pr_id ORDER BY i) AS path FROM (SELECT pr_id, unnest(string_split(diff, chr(10))) AS x, generate_subscripts(string_split(diff, chr(10)), 1) AS i FROM {CHANGES})) WHERE starts_with(x, '+') AND NOT starts_with(x, '+++') GROUP BY ALL")
def diff_file_map(spark, d):
    rows = changes(spark, d).select("pr_id", F.posexplode(diffs.lines(F.col("diff"))).alias("i", "x"))
    path = F.last(F.when(F.col("x").startswith("+++ b/"), F.expr("substr(x, 7)")), True).over(Window.partitionBy("pr_id").orderBy("i"))
    return rows.withColumn("path", path).where(F.col("x").startswith("+") & ~F.col("x").startswith("+++")).groupBy("pr_id", "path").agg(F.count("*").alias("added"))


# --- classification metrics ---
_CONF = "count(*) FILTER (quality = 0 AND guess = 0) AS tn, count(*) FILTER (quality = 0 AND guess = 1) AS fp, count(*) FILTER (quality = 1 AND guess = 0) AS fn, count(*) FILTER (quality = 1 AND guess = 1) AS tp"


def _ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / CAST(({b}) AS DOUBLE) END"


_RATES = {
    "accuracy": _ratio("tp + tn", "tn + fp + fn + tp"), "precision": _ratio("tp", "tp + fp"), "recall": _ratio("tp", "tp + fn"), "f1": _ratio("2 * tp", "2 * tp + fp + fn"), "specificity": _ratio("tn", "tn + fp"),
    "npv": _ratio("tn", "tn + fn"), "fpr": _ratio("fp", "fp + tn"), "balanced_accuracy": f"(({_ratio('tp', 'tp + fn')}) + ({_ratio('tn', 'tn + fp')})) / 2",
}
RATES_SQL = ", ".join(f"round({v}, 6) AS {k}" for k, v in _RATES.items())


@query(f"SELECT source, {_CONF} FROM ({GUESSED}) GROUP BY source")
def confusion(spark, d):
    return metrics.confusion(guessed(spark, d), ["source"])


@query(f"SELECT source, tn, fp, fn, tp, {RATES_SQL} FROM (SELECT source, {_CONF} FROM ({GUESSED}) GROUP BY source)")
def class_metrics(spark, d):
    return metrics.rates(metrics.confusion(guessed(spark, d), ["source"]))


AUC_SQL = f"""WITH g AS ({GUESSED}), r AS (SELECT lang, quality AS y, (rank() OVER (PARTITION BY lang ORDER BY score) + rank() OVER (PARTITION BY lang ORDER BY score) + count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS mid FROM g)
SELECT lang, round((sum(mid * y) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0)::DOUBLE, 6) AS roc_auc FROM r GROUP BY lang"""


@query(AUC_SQL)
def roc_auc(spark, d):
    return metrics.roc_auc(guessed(spark, d), ["lang"])


PR_SQL = f"""WITH b AS (SELECT lang, score, CAST(sum(quality) AS DOUBLE) AS p, count(*) AS n FROM ({GUESSED}) GROUP BY 1, 2), c AS (SELECT lang, p, sum(p) OVER w / sum(n) OVER w AS pr FROM b WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(p * pr) / nullif(sum(p), 0), 6) AS pr_auc FROM c GROUP BY lang"""


@query(PR_SQL)
def pr_auc(spark, d):
    return metrics.pr_auc(guessed(spark, d), ["lang"])


@query(f"WITH b AS (SELECT lang, score AS threshold, CAST(sum(quality) AS DOUBLE) AS p, CAST(sum(1 - quality) AS DOUBLE) AS q FROM ({GUESSED}) GROUP BY 1, 2) SELECT lang, threshold, round(coalesce(sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY lang), 0), 0), 6) AS tpr, round(coalesce(sum(q) OVER w / nullif(sum(q) OVER (PARTITION BY lang), 0), 0), 6) AS fpr FROM b WINDOW w AS (PARTITION BY lang ORDER BY threshold DESC)")
def roc_points(spark, d):
    return metrics.roc_points(guessed(spark, d), ["lang"])


@query(f"WITH m AS (SELECT lang, {RATES_SQL} FROM (SELECT lang, {_CONF} FROM ({GUESSED}) GROUP BY lang)), a AS ({AUC_SQL}) SELECT lang, round(0.35::DOUBLE * roc_auc + 0.30::DOUBLE * specificity + 0.20::DOUBLE * balanced_accuracy + 0.15::DOUBLE * f1, 6) AS composite FROM m JOIN a USING (lang)")
def composite_score(spark, d):
    g = guessed(spark, d)
    return metrics.composite(metrics.rates(metrics.confusion(g, ["lang"])).join(metrics.roc_auc(g, ["lang"]), "lang")).select("lang", "composite")


@query(f"WITH m AS (SELECT source, {RATES_SQL} FROM (SELECT source, {_CONF} FROM ({GUESSED}) GROUP BY source)) SELECT 'f1' AS metric, arg_min(source, (-f1, source)) AS best, max(f1) AS value FROM m UNION ALL SELECT 'specificity', arg_min(source, (-specificity, source)), max(specificity) FROM m")
def best_combo(spark, d):
    m = metrics.rates(metrics.confusion(guessed(spark, d), ["source"]))
    best = lambda c: m.agg(F.lit(c).alias("metric"), F.min_by("source", F.struct(-F.col(c), F.col("source"))).alias("best"), F.max(c).alias("value"))
    return best("f1").unionByName(best("specificity"))


@query(f"WITH m AS (SELECT lang, {RATES_SQL} FROM (SELECT lang, {_CONF} FROM ({GUESSED}) GROUP BY lang)), o AS (SELECT {RATES_SQL} FROM (SELECT {_CONF} FROM ({GUESSED}))) SELECT lang, round(m.f1 - o.f1, 6) AS f1_delta, round(m.accuracy - o.accuracy, 6) AS accuracy_delta FROM m, o")
def metric_deltas(spark, d):
    g = guessed(spark, d)
    m, o = metrics.rates(metrics.confusion(g, ["lang"])), metrics.rates(metrics.confusion(g, []))
    return m.crossJoin(F.broadcast(o.select(F.col("f1").alias("_f"), F.col("accuracy").alias("_a")))).select("lang", F.round(F.col("f1") - F.col("_f"), 6).alias("f1_delta"), F.round(F.col("accuracy") - F.col("_a"), 6).alias("accuracy_delta"))


@query(f"SELECT CASE WHEN quality = 0 THEN 'fp' ELSE 'fn' END AS kind, source, count(*) AS n, round(avg(n_chars), 4) AS mean_length FROM ({GUESSED}) WHERE quality <> guess GROUP BY ALL")
def error_profile(spark, d):
    wrong = guessed(spark, d).where("quality <> guess")
    return wrong.groupBy(F.when(F.col("quality") == 0, "fp").otherwise("fn").alias("kind"), "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_length"))


@query(f"SELECT count(*) FILTER (quality = 0 AND guess = 1) AS hard, count(*) FILTER (quality = 0 AND guess = 1 AND toxic = 1) AS corrected FROM ({GUESSED})")
def fp_correction(spark, d):
    hard = (F.col("quality") == 0) & (F.col("guess") == 1)
    return guessed(spark, d).agg(F.count_if(hard).alias("hard"), F.count_if(hard & (F.col("toxic") == 1)).alias("corrected"))


# --- sampling ---
_DRAW = "md5(doc_id || '-42')"


def _stage(name: str, rows: str, share: str) -> str:
    """CTEs that end in <name>: rows with `first`, true for all but ceil(share of them)."""
    return f"""{name}_k AS (SELECT *, CASE WHEN (SELECT min(n) < 3 FROM (SELECT count(*) AS n FROM {rows} GROUP BY source, quality)) THEN quality::VARCHAR ELSE source || '_' || quality END AS s FROM {rows}),
{name}_t AS (SELECT s, n, n * (of - ceil({share} * of)) / of::DOUBLE AS exact, (of - ceil({share} * of))::BIGINT AS total FROM (SELECT s, count(*) AS n, sum(count(*)) OVER () AS of FROM {name}_k GROUP BY s)),
{name}_a AS (SELECT s, floor(exact)::BIGINT + (row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, s) <= total - sum(floor(exact)) OVER ())::INTEGER AS take FROM {name}_t),
{name} AS (SELECT k.* EXCLUDE (s), row_number() OVER (PARTITION BY k.s ORDER BY {_DRAW}, doc_id) <= take AS first FROM {name}_k k JOIN {name}_a a ON a.s = k.s)"""


_SPLIT = f"""(WITH l AS ({LABELLED}), {_stage('one', 'l', str(1 - 0.7) + '::DOUBLE')}, rest AS (SELECT * EXCLUDE (first) FROM one WHERE NOT first), {_stage('two', 'rest', str((1 - 0.7 - 0.15) / (1 - 0.7)) + '::DOUBLE')}
SELECT doc_id, source, quality, 'train' AS split FROM one WHERE first UNION ALL SELECT doc_id, source, quality, CASE WHEN first THEN 'val' ELSE 'test' END FROM two)"""


def split(spark, d):
    return stats.stratified_split(labelled(spark, d).select("doc_id", "source", "quality"), "doc_id", ["source", "quality"], ["quality"])


@query(f"SELECT doc_id, split FROM {_SPLIT}")
def split_assign(spark, d):
    return split(spark, d).select("doc_id", "split")


@query(f"SELECT split, source, count(*) AS n, sum(quality)::BIGINT AS merged, sum(1 - quality)::BIGINT AS unmerged, round(avg(quality), 4) AS rate FROM {_SPLIT} GROUP BY GROUPING SETS ((split), (split, source))")
def split_summary(spark, d):
    return stats.split_summary(split(spark, d), "source", "quality")


@query(f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {_DRAW}, doc_id) <= (SELECT count(*) // 10 FROM documents)")
def uniform_tenth(spark, d):
    docs = t(spark, d, "documents").select("doc_id")
    n = docs.agg(F.floor(F.count("*") / 10).cast("long").alias("_n"))
    return stats.uniform_sample(docs.crossJoin(F.broadcast(n)), "doc_id", F.col("_n")).select("doc_id")


_RATE = f"(SELECT round_even(10 * avg(quality), 0)::BIGINT FROM ({LABELLED}))"


@query(f"""WITH l AS ({LABELLED}), c AS (SELECT source, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no FROM l GROUP BY source),
y AS (SELECT source, no, least(yes, {_RATE}) + least(greatest(10 - least(yes, {_RATE}) - least(no, 10 - {_RATE}), 0), yes - least(yes, {_RATE})) AS y FROM c)
SELECT doc_id, source, quality FROM l JOIN (SELECT source, y, least(no, 10 - y) AS n FROM y) USING (source) QUALIFY row_number() OVER (PARTITION BY source, quality ORDER BY (length(text) > 1000) DESC, {_DRAW}, doc_id) <= CASE quality WHEN 1 THEN y ELSE n END""")
def matched_sample(spark, d):
    rows = labelled(spark, d).select("doc_id", "source", "quality", (F.length("text") > 1000).alias("long"))
    return stats.matched_sample(rows, "quality", "source", "doc_id", F.col("long")).select("doc_id", "source", "quality")


@query(f"SELECT doc_id FROM documents ORDER BY {_DRAW}, doc_id LIMIT 20")
def hash_sample(spark, d):
    return t(spark, d, "documents").orderBy(stats.draw("doc_id"), "doc_id").limit(20).select("doc_id")


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_DRAW}, doc_id) <= 5")
def per_group_cap(spark, d):
    return stats.per_group_cap(t(spark, d, "documents"), "source", 5, stats.draw("doc_id"), "doc_id").select("doc_id", "source")


@query(f"SELECT doc_id, quality, substr(text, 1, 500) AS body FROM ({LABELLED}) QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) <= 2")
def few_shot_pick(spark, d):
    return stats.per_group_cap(labelled(spark, d), "quality", 2, stats.draw("doc_id"), "doc_id").select("doc_id", "quality", F.substring("text", 1, 500).alias("body"))


@query(f"SELECT doc_id, source, quality FROM ({LABELLED}) QUALIFY row_number() OVER (PARTITION BY source, quality ORDER BY (length(text) > 1000) DESC, {_DRAW}, doc_id) <= 3")
def quota_sample(spark, d):
    w = Window.partitionBy("source", "quality").orderBy((F.length("text") > 1000).desc(), stats.draw("doc_id"), "doc_id")
    return labelled(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("doc_id", "source", "quality")


@query(f"SELECT doc_id FROM ({GUESSED}) WHERE quality = 0 ORDER BY guess DESC, {_DRAW}, doc_id LIMIT 40")
def hard_fp_sample(spark, d):
    return guessed(spark, d).where("quality = 0").orderBy(F.desc("guess"), stats.draw("doc_id"), "doc_id").limit(40).select("doc_id")


_BALANCED = f"""WITH c AS (SELECT quality, source, count(*) AS n, greatest(1, least(25 // count(*) OVER (PARTITION BY quality), count(*), 15)) AS q FROM ({LABELLED}) GROUP BY quality, source),
k AS (SELECT quality, source, q + greatest(0, least(n - q, greatest(25 - sum(q) OVER (PARTITION BY quality), 0) - coalesce(sum(n - q) OVER (PARTITION BY quality ORDER BY n - q DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM c),
r AS (SELECT doc_id, source, quality, text, row_number() OVER (PARTITION BY quality, source ORDER BY {_DRAW}, doc_id) AS r FROM ({LABELLED}))
SELECT doc_id, source, quality, text FROM r JOIN k USING (quality, source) WHERE r <= take QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) <= 25"""


def balanced(spark, d):
    return stats.quota_picks(labelled(spark, d).select("doc_id", "source", "quality", "text"), "quality", "source", "doc_id", 25)


@query(f"SELECT doc_id, source, quality FROM ({_BALANCED})")
def quota_balanced(spark, d):
    return balanced(spark, d).select("doc_id", "source", "quality")


@query(f"SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (quality = 1) AS merged, count(*) FILTER (coalesce(text, '') = '') AS empty, count(*) FILTER (doc_id IN (SELECT doc_id FROM ({LABELLED}) QUALIFY row_number() OVER (PARTITION BY quality ORDER BY {_DRAW}, doc_id) <= 2)) AS overlap FROM ({_BALANCED})")
def balanced_check(spark, d):
    shots = few_shot_pick(spark, d).select("doc_id", F.lit(True).alias("shot"))
    found = balanced(spark, d).join(shots, "doc_id", "left")
    return found.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("quality") == 1).alias("merged"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if("shot").alias("overlap"))


@query(f"""WITH l AS (SELECT doc_id, source, quality, length(text) > 1000 AS p FROM ({LABELLED})),
g AS (SELECT quality, source, count(*) AS n, count(*) FILTER (p) AS w, count(*) OVER (PARTITION BY quality) AS groups, row_number() OVER (PARTITION BY quality ORDER BY source) AS place FROM l GROUP BY quality, source),
k AS (SELECT quality, source, least(greatest(1, 60 // groups), n) AS take, w FROM g WHERE place <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY quality, source, p ORDER BY {_DRAW}, doc_id) AS r FROM l),
t AS (SELECT r.doc_id, r.source, r.quality, CASE WHEN r.r <= CASE WHEN r.p THEN least(k.w, greatest(1, k.take * 2 // 3)) ELSE k.take - least(k.w, greatest(1, k.take * 2 // 3)) END THEN 0 ELSE 1 END AS tier FROM r LEFT JOIN k ON r.quality = k.quality AND r.source = k.source)
SELECT doc_id, source, quality FROM t QUALIFY row_number() OVER (PARTITION BY quality ORDER BY tier, {_DRAW}, doc_id) <= 60""")
def preferred_balanced(spark, d):
    rows = labelled(spark, d).select("doc_id", "source", "quality", (F.length("text") > 1000).alias("long"))
    return stats.preferred_picks(rows, "quality", "source", "doc_id", F.col("long"), 60).select("doc_id", "source", "quality")


# --- joins and sets ---
@query("SELECT d.doc_id, coalesce(l.quality, 0) AS quality, CAST(l.doc_id IS NULL AS INTEGER) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_fill_join(spark, d):
    right = t(spark, d, "labels").select("doc_id", "quality", F.lit(0).alias("missing"))
    return t(spark, d, "documents").select("doc_id").join(right, "doc_id", "left").na.fill({"quality": 0, "missing": 1})


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def semi_subset(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_resume(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT a.l_orderkey, a.l_linenumber, o.o_orderstatus FROM lineitem a JOIN orders o ON a.l_orderkey = o.o_orderkey WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)")
def anti_composite(spark, d):
    li = t(spark, d, "lineitem")
    next_line = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber").join(next_line, ["l_orderkey", "l_linenumber"], "left_anti").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")


@query("SELECT doc_id, prompt, context FROM documents, (SELECT unnest(['P1', 'P2', 'P3', 'P4']) AS prompt), (SELECT unnest(['C1', 'C2', 'C3', 'C4']) AS context)")
def task_grid(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("P1", "P2", "P3", "P4")))).alias("prompt")).select("doc_id", "prompt", F.explode(F.array(*map(F.lit, ("C1", "C2", "C3", "C4")))).alias("context"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def ordered_dedupe(spark, d):
    return stats.first_by(t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT doc_id, 'seed' AS origin FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'new' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = d.doc_id)")
def union_priority(spark, d):
    seed = t(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("seed").alias("origin"))
    return seed.unionByName(t(spark, d, "documents").join(seed, "doc_id", "left_anti").select("doc_id", F.lit("new").alias("origin")))


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set_overlap(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").select("doc_id")).agg(F.count("*").alias("n"))


# --- conversations as reviews ---
@query("SELECT conv_id, string_agg('[' || role || '] ' || text, ' | ' ORDER BY turn) AS reviews FROM conversations GROUP BY 1")
def review_text(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("s"))))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " | ").alias("reviews"))


@query("SELECT conv_id, CASE WHEN a > 0 AND a >= c THEN 'APPROVED' WHEN c > 0 THEN 'CHANGES_REQUESTED' WHEN n > 0 THEN 'COMMENTED' ELSE 'NONE' END AS decision FROM (SELECT conv_id, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS c, count(*) AS n FROM conversations GROUP BY 1)")
def majority_decision(spark, d):
    n = lambda r: F.count_if(F.col("role") == r)
    c = t(spark, d, "conversations").groupBy("conv_id").agg(n("assistant").alias("a"), n("user").alias("c"), F.count("*").alias("n"))
    return c.select("conv_id", F.when((F.col("a") > 0) & (F.col("a") >= F.col("c")), "APPROVED").when(F.col("c") > 0, "CHANGES_REQUESTED").when(F.col("n") > 0, "COMMENTED").otherwise("NONE").alias("decision"))


@query("SELECT conv_id, coalesce(arg_min(role, turn) FILTER (role <> 'system'), 'none') AS decision, count(DISTINCT role) AS reviewers FROM conversations GROUP BY 1")
def first_decision(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.expr("min_by(role, turn) FILTER (WHERE role <> 'system')"), F.lit("none")).alias("decision"), F.count_distinct("role").alias("reviewers"))


# --- similarity ---
def against_benchmark(spark, d, measure, name):
    """All documents with all items, over whole texts."""
    docs = t(spark, d, "documents").select("doc_id", text.lower_tokens("text").alias("a"))
    return similarity.against_all(docs, t(spark, d, "benchmark").select("item_id", text.lower_tokens("text").alias("b")), measure, name)


_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
_DOCS, _ITEMS = f"(SELECT doc_id, {_TOK} AS a FROM documents)", f"(SELECT item_id, {_TOK} AS b FROM benchmark)"
# the twins count common words and n-grams by joins on them, never pair by pair
_COMMON = f"(SELECT doc_id, item_id, count(*) AS c FROM (SELECT doc_id, unnest(list_distinct(a)) AS w FROM {_DOCS}) JOIN (SELECT item_id, unnest(list_distinct(b)) AS w FROM {_ITEMS}) USING (w) GROUP BY 1, 2)"


def _grams(c: str, n: int) -> str:
    return f"list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))"


def _hits(n: int) -> str:
    return f"(SELECT doc_id, item_id, sum(k) AS h{n} FROM (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest({_grams('a', n)}) AS w FROM {_DOCS}) GROUP BY 1, 2) JOIN (SELECT item_id, unnest(list_distinct({_grams('b', n)})) AS w FROM {_ITEMS}) USING (w) GROUP BY 1, 2)"


def _bleu(most: int) -> str:
    parts = " + ".join(f"CASE WHEN n >= {k} THEN ln(greatest(coalesce(h{k}, 0) / (n - {k - 1})::DOUBLE, 1e-10)) ELSE 0 END" for k in range(1, most + 1))
    joins = " ".join(f"LEFT JOIN {_hits(k)} USING (doc_id, item_id)" for k in range(1, most + 1))
    mean = "greatest(coalesce(h1, 0) / n::DOUBLE, 1e-10)" if most == 1 else f"exp(({parts}) / least(n, {most}))"
    return f"SELECT doc_id, item_id, CASE WHEN n = 0 OR m = 0 THEN 0 ELSE round({mean} * (CASE WHEN n >= m THEN 1 ELSE exp(1 - m / n::DOUBLE) END), 4) END AS bleu{most} FROM (SELECT doc_id, item_id, len(a) AS n, len(b) AS m FROM {_DOCS}, {_ITEMS}) {joins}"


@query(f"SELECT doc_id, item_id, round(CASE WHEN n + m = 0 THEN 0 ELSE 2 * coalesce(c, 0) / (n + m)::DOUBLE END, 4) AS rouge1 FROM (SELECT doc_id, item_id, len(list_distinct(a)) AS n, len(list_distinct(b)) AS m FROM {_DOCS}, {_ITEMS}) LEFT JOIN {_COMMON} USING (doc_id, item_id)")
def rouge_sets(spark, d):
    return against_benchmark(spark, d, similarity.References.overlap_f1, "rouge1")


@query(_bleu(1))
def bleu1(spark, d):
    return against_benchmark(spark, d, lambda refs, flat, sizes: refs.bleu(flat, sizes, 1), "bleu1")


@query(_bleu(4))
def bleu4(spark, d):
    return against_benchmark(spark, d, lambda refs, flat, sizes: refs.bleu(flat, sizes, 4), "bleu4")


@query()
def lcs_rouge_l(spark, d):
    return against_benchmark(spark, d, similarity.References.lcs_f1, "rouge_l")


@query(f"WITH s AS (SELECT source, count(*) AS n, sum(quality) AS q FROM ({LABELLED}) GROUP BY 1) SELECT doc_id, source, n - 1 AS others, round((s.q - l.quality) / nullif(n - 1, 0)::DOUBLE, 6) AS others_mean FROM ({LABELLED}) l JOIN s USING (source)")
def loo_policy(spark, d):
    return stats.leave_one_out(labelled(spark, d), "source", "quality").select("doc_id", "source", "others", "others_mean")


@query("SELECT event_id, user_id, count(*) OVER w AS earlier, round(avg(value) OVER w, 6) AS earlier_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def as_of_history(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return t(spark, d, "events").select("event_id", "user_id", F.count("*").over(w).alias("earlier"), F.round(F.avg("value").over(w), 6).alias("earlier_mean"))


_TITLED = f"(SELECT doc_id, source, n_chars, len(string_split(text, chr(10))) AS files, list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '\\s+'), lambda x: x <> '')) AS t FROM ({LABELLED}))"


def titled(docs):
    """Documents as change requests: lines are files, the words of the first line the title."""
    whole = F.split(text.safe(F.col("text")), "\n")
    return docs.withColumns({"files": F.size(whole), "title": F.array_distinct(text.lower_tokens(whole[0]))})


@query(f"SELECT q.doc_id, c.doc_id AS similar, round(3 * (q.source = c.source)::INTEGER + 2 * exp(-abs(q.files - c.files) / 10.0::DOUBLE) + 2 * exp(-abs(q.n_chars - c.n_chars) / 500.0::DOUBLE) + 2 * (CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_intersect(q.t, c.t)) / len(q.t)::DOUBLE END), 4) AS score FROM {_TITLED} q JOIN {_TITLED} c ON q.doc_id <> c.doc_id WHERE q.doc_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.doc_id ORDER BY score DESC, c.doc_id) <= 3")
def similar_topk(spark, d):
    rows = titled(labelled(spark, d))
    return neighbours.similar(rows, rows.where("doc_id % 50 = 0"), "doc_id", "source", "files", "n_chars", "title", 3)


# --- features ---
@query("SELECT doc_id, least(CAST(n_chars AS DOUBLE), (SELECT quantile_cont(n_chars, 0.99) FROM documents)) AS capped FROM documents")
def winsorize_all(spark, d):
    docs = t(spark, d, "documents")
    return docs.crossJoin(F.broadcast(ranks.bounds(docs, ["n_chars"], 0.99).withColumnRenamed("n_chars", "p"))).select("doc_id", F.least(F.col("n_chars").cast("double"), "p").alias("capped"))


@query("WITH b AS (SELECT avg(n_chars) AS m, nullif(stddev_pop(n_chars), 0) AS s, quantile_cont(n_chars, 0.75) AS q FROM documents WHERE doc_id % 10 < 7) SELECT doc_id, round((n_chars - m) / coalesce(s, 1), 6) AS z, CAST(n_chars > q AS INTEGER) AS large FROM documents, b")
def standardize_train(spark, d):
    docs = t(spark, d, "documents")
    train = docs.where("doc_id % 10 < 7")
    b = train.agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s")).crossJoin(ranks.bounds(train, ["n_chars"], 0.75).withColumnRenamed("n_chars", "q"))
    z = (F.col("n_chars") - F.col("m")) / F.coalesce(F.nullif(F.col("s"), F.lit(0.0)), F.lit(1.0))
    return docs.crossJoin(F.broadcast(b)).select("doc_id", F.round(z, 6).alias("z"), (F.col("n_chars") > F.col("q")).cast("int").alias("large"))


@query()
def logreg_scores(spark, d):
    from mergelens.operators import ml

    return ml.logistic_scores(labelled(spark, d).select("doc_id", "n_chars", "toxic", F.length("lang").alias("k"), F.col("quality").alias("label")), ["n_chars", "toxic"])


@query()
def forest_scores(spark, d):
    from mergelens.operators import ml

    return ml.forest_scores(labelled(spark, d).select("doc_id", "n_chars", "toxic", F.col("quality").alias("label")), ["n_chars", "toxic"])


# --- rules and contexts ---
@query(f"SELECT pr_id, risk, greatest(round(1 - risk, 4), 0.05) AS probability, CASE WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS level, CASE WHEN risk >= 0.4 THEN 'not_merged' ELSE 'merged' END AS prediction FROM (SELECT pr_id, round(0.25::DOUBLE * (CASE WHEN n > 0 AND tests = 0 THEN 1 ELSE 0 END) + 0.2::DOUBLE * (CASE WHEN n > 5 OR 3 * n > 200 THEN 1 ELSE 0 END) + 0.15::DOUBLE * (CASE WHEN config > 0 AND config <= n * 0.7::DOUBLE THEN 1 ELSE 0 END) + 0.2::DOUBLE, 6) AS risk FROM (SELECT pr_id, count(*) AS n, count(*) FILTER (regexp_matches(path, '(?i)test_|_test\\.|tests?/')) AS tests, count(*) FILTER (path LIKE '%.json') AS config FROM {FILES} GROUP BY 1))")
def rules_score(spark, d):
    files = lines(spark, d).groupBy("pr_id").agg(F.collect_list(F.struct("path", F.lit("x = 1").alias("content"))).alias("files"))
    return rules.score(files.join(changes(spark, d), "pr_id"), F.col("files"), F.col("diff")).select("pr_id", "risk", "probability", "level", "prediction")


@query(f"WITH c AS (SELECT pr_id, count(*) AS n, count(*) FILTER (regexp_matches(path, '(?i)test_|_test\\.|tests?/')) AS tests, count(*) FILTER (path LIKE '%.json') AS config FROM {FILES} GROUP BY 1) SELECT pr_id, 'missing-test' AS rule, 1 AS hits FROM c WHERE tests = 0 UNION ALL SELECT pr_id, 'large-change', 1 FROM c WHERE n > 5 OR 3 * n > 200 UNION ALL SELECT pr_id, 'config-or-dependency-change', 1 FROM c WHERE config > 0 AND config <= n * 0.7::DOUBLE UNION ALL SELECT pr_id, 'public-api-change', 1 FROM c")
def rule_findings(spark, d):
    files = lines(spark, d).groupBy("pr_id").agg(F.collect_list(F.struct("path", F.lit("x = 1").alias("content"))).alias("files"))
    return rules.findings(rules.score(files.join(changes(spark, d), "pr_id"), F.col("files"), F.col("diff")), "pr_id")


@query("SELECT doc_id, 'Title: ' || substr(text, 1, 80) || chr(10) || 'Body: ' || substr(text, 81, 3000) || chr(10) || 'Repository: ' || source AS context FROM documents")
def context_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("Title: "), F.substring("text", 1, 80)), F.concat(F.lit("Body: "), F.substring("text", 81, 3000)), F.concat(F.lit("Repository: "), "source")).alias("context"))


# --- responses and history ---
def answers(spark, d):
    k, v = F.col("event_id") % 4, F.col("user_id").cast("string")
    body = F.when(F.col("event_id") % 8 == 4, F.concat(F.lit('so: {"a": '), v, F.lit(', "notes": ["cut o'))).when(k == 0, F.concat(F.lit('{"a": '), v, F.lit("}"))).when(k == 1, F.concat(F.lit('```json\n{"a": '), v, F.lit("}\n```"))).when(k == 2, F.concat(F.lit('so: {"a": '), v, F.lit(",} end"))).otherwise("none")
    return t(spark, d, "events").select("event_id", "user_id", body.alias("body"))


@query("SELECT event_id, event_id % 4 <> 3 AS parsed, CASE WHEN event_id % 4 <> 3 THEN user_id END AS a FROM events")
def json_ladder(spark, d):
    x = answers(spark, d).withColumn("v", responses.parse(F.col("body")))
    return x.select("event_id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.a", "long").alias("a"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def response_flatten(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'view' END AS kind, least(greatest(value / 100.0::DOUBLE, 0), 1) AS p FROM events")
def response_normalise(spark, d):
    return t(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("event_type")).otherwise("view").alias("kind"), text.clamp(F.col("value") / 100.0).alias("p"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_latest(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 17")
def history_lookup(spark, d):
    return t(spark, d, "events").where("event_id = 17").select("event_id", "user_id", "event_type", "value")


_MODELS = "(SELECT source AS id, ['llm', 'rf', 'svm', 'rules', 'other'][(count(*) % 5 + 1)::INTEGER] AS kind, sum(n_chars) % 2 = 0 AS ready FROM documents GROUP BY source)"


@query(f"SELECT 'auto' AS wanted, id, kind FROM (SELECT id, kind FROM {_MODELS} WHERE ready AND kind <> 'other' ORDER BY CASE kind WHEN 'llm' THEN 1 WHEN 'rf' THEN 2 WHEN 'svm' THEN 3 ELSE 4 END, id LIMIT 1) UNION ALL SELECT 'named', id, kind FROM {_MODELS} WHERE id = 'src3'")
def model_choice(spark, d):
    """A registry of models, one for each source: its kind follows its number of documents, and it is ready if their length is even."""
    kinds = F.array(*map(F.lit, ("llm", "rf", "svm", "rules", "other")))
    models = t(spark, d, "documents").groupBy(F.col("source").alias("id")).agg(F.element_at(kinds, (F.count("*") % 5 + 1).cast("int")).alias("kind"), (F.sum("n_chars") % 2 == 0).alias("ready"))
    named = lambda how, x: x.select(F.lit(how).alias("wanted"), "id", "kind")
    return named("auto", service.choose(models)).unionByName(named("named", service.choose(models, "src3")))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, strftime(min(ts), '%Y%m%dT%H%M%S') AS first_seen FROM events GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 40")
def history_stream(spark, d):
    """The first event of each user as a history that a stream of the events keeps: the 40 newest."""
    seen = ["user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"]
    stream = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select(*seen)  # a pattern, as the table may be one file
    place = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    history.follow(stream, f"{place}/rows", f"{place}/checkpoint", "user_id", "ts").awaitTermination()
    rows = history.newest(history.stored(spark, f"{place}/rows", stream.schema), "ts", "user_id", 40)
    return rows.select("user_id", "event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("first_seen"))
