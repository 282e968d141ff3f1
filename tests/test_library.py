"""Worked examples, and every catalogue query against DuckDB over the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths, text
from mergelens.operators import metrics, responses, similarity, stats, structure
from mergelens.plans import catalog, reviews  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_texts(spark):
    assert one(spark, text.escape_newlines(F.lit("a\r\nb"), 9)) == "a\\nb"
    assert one(spark, text.escape_newlines(F.lit("abcdef"), 3)) == "abc..."
    assert one(spark, text.strip_controls(F.lit(" a\x00\n\n\n\nb "), 99)) == "a\n\nb"
    assert one(spark, text.truncate(F.lit("abcdef"), 3)) == "abc\n... [truncated]"
    assert one(spark, text.tokens_estimate(F.lit("ab cd 12"))) == 3
    assert [one(spark, text.lenient_merged(F.lit(v))) for v in ("True", "MERGED", "1")] == [1, 1, 1]
    assert [one(spark, text.strict_merged(F.lit(v))) for v in ("True", "MERGED", "1")] == [0, 1, 0]
    assert one(spark, text.contains_any(F.lit("main branch"), ["ai"])) and not one(spark, text.contains_any(F.lit("main branch"), ["ai"], True))


def test_paths(spark):
    p = F.lit("docs/test_plan.md")
    assert one(spark, paths.kind(p)) == "doc" and one(spark, paths.is_test(p)) and one(spark, paths.exclusive_kind(p)) == "test"


def test_diffs(spark):
    assert one(spark, diffs.added_lines(F.lit("+a\n-b\n c\n+++ b/x\n+--- y\n+"))) == ["a", ""]
    assert one(spark, diffs.modified_functions(F.lit("@@ -1,2 +1,3 @@ def foo(x):\n+def bar():\n+    y=1"))) == ["bar", "foo"]


def test_structure(spark):
    code = "def f(items):\n    for i in items:\n        if i > 0:\n            continue\n        total = i\n    return 1\n    x"
    nodes, edges, branches, loops, exits, cyclomatic, depth, out = structure.flow_features(code.split("\n"))
    assert (nodes, edges, branches, loops, exits, cyclomatic, depth, out) == (8, 7, 1, 1, 2, 1, 2, 1.0)
    assert one(spark, structure.indent_depth(F.lit(code))) == 4


def test_similarity(spark):
    tokens = lambda s: F.array(*map(F.lit, s.split()))
    assert one(spark, similarity.bleu(tokens("a b"), tokens("a b c"))) == 0.6065
    assert one(spark, similarity.bleu(tokens("the the"), tokens("the cat"))) == 0.0
    assert one(spark, similarity.overlap_f1(tokens("a b c"), tokens("a c"), 1)) == 0.8
    assert similarity.lcs("abc", "ac") == 2


def test_metrics(spark):
    rows = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.8), ("g", 0, 0.1)], "g string, label int, score double")
    assert metrics.roc_auc(rows, ["g"]).first()["roc_auc"] == 0.875
    assert math.isclose(metrics.pr_auc(rows, ["g"]).first()["pr_auc"], 0.833333, abs_tol=1e-6)
    r = metrics.rates(spark.createDataFrame([(6, 19, 1, 24)], "tn long, fp long, fn long, tp long"), 4).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.specificity, r.balanced_accuracy, r.fpr) == (0.6, 0.5581, 0.96, 0.7059, 0.24, 0.6, 0.76)


def test_quota_picks(spark):
    rows = spark.createDataFrame([(i, "a" if i < 20 else "b" if i < 23 else None, i % 2) for i in range(26)], "k long, g string, y int")
    got = stats.quota_picks(rows, "y", "g", "k", 6).collect()
    assert sorted((r.y, r.g) for r in got) == [(0, "a")] * 4 + [(0, "b")] * 2 + [(1, "a")] * 5 + [(1, "b")]
    few = stats.preferred_picks(rows, "y", "g", "k", F.col("k") >= 10, 6).collect()
    assert len(few) == len({r.k for r in few}) == 12 and all(r.g for r in few)
    assert not stats.quota_picks(rows.limit(0), "y", "g", "k", 6).collect()


def test_responses(spark):
    for body in ('{"a": 1,}', '```json\n{"a": 1}\n```', 'x {"a": 1} y', '{"a": 1}'):
        assert one(spark, F.try_variant_get(responses.parse(F.lit(body)), "$.a", "int")) == 1
    assert responses.close_truncated('{"a":[1,2') == '{"a":[1,2]}' and responses.close_truncated('{"a":"x') == '{"a":"x"}'


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as from '{D}/{name}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D), duck.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(want.project(quoted).fetchall())
