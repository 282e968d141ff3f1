"""Operators over change requests on worked examples, sources and sinks, models, the service."""

import json

import pytest
from pyspark.sql import functions as F

from mergelens.functions import diffs, paths, signals
from mergelens.operators import contexts, deployable, evaluation, ml, requests, rules, service, structure
from mergelens.sources import io, rest


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def array(*values, kind="string"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def test_signals(spark):
    none = F.lit("")
    fields = dict.fromkeys(signals.FIELDS, none)
    found = one(spark, signals.detection(fields | {"title": F.lit("Use Copilot"), "author": F.lit("GPT-bot")}))
    assert found.found and found.reason == 'title contains "copilot"; author contains "gpt"'
    assert one(spark, signals.detection(fields | {"body": F.lit("AI assisted")})).reason == 'body contains "ai" with context words'
    assert not one(spark, signals.detection(fields | {"body": F.lit("main branch")})).found
    assert one(spark, signals.reviewer(array("plain mail"), array())) and not one(spark, signals.reviewer(array("looks good"), array("bug")))
    assert one(spark, signals.generated(F.lit("x"), array("AI-Generated"))) and not one(spark, signals.generated(F.lit(None).cast("string"), array()))
    assert one(spark, signals.quick(F.lit("t"), F.lit("OpenAI"), array())) and not one(spark, signals.quick(F.lit("t"), F.lit("b"), array("ok")))


def test_flow_by_language():
    go = ["func f(x int) int {", "    if x > 1 {", "        return 1", "    }", "    for i := 0; i < 3; i++ {", "        x++", "    }"]
    assert structure.flow_features(go, ".go")[:5] == (8, 9, 1, 1, 1)
    js = ["if (a) {", "  b()", "} else {", "  c()", "}"]
    nodes, edges, branches, loops, exits, *_ = structure.flow_features(js, ".js")
    assert (nodes, branches, loops, exits) == (6, 1, 0, 0) and edges == 6
    assert structure.flow_features(["// only a note", ""], ".js")[:2] == (2, 1)
    assert structure.flow_features([], ".js") == (0, 0, 0, 0, 0, 0, 0, 0.0)


def test_blank_files_have_no_census(spark):
    files = spark.createDataFrame([(1, "  \n ", ".py"), (2, None, ".go"), (3, "x = 1", ".rb")], "file_id int, code string, ext string")
    got = {r.file_id: r for r in structure.census(files).collect()}
    assert [got[i].success for i in (1, 2, 3)] == [False, False, True]
    assert got[1].total_nodes == got[1].max_depth == 0 and got[3].total_nodes == 2 and got[3].assignment_nodes == 1


DIFF = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1,2 +4,3 @@ def f(x):\n+def g():\n+    return 1\n-    y = 2\n context\n@@ -9 +12 @@\n+z = 3\ndiff --git a/README.md b/README.md\n+++ b/README.md\n@@ -0,0 +1 @@\n+text\ndiff --git a/only.py b/only.py\n"


def test_diffs_to_files(spark):
    files = one(spark, deployable.changed_files(F.lit(DIFF)))
    assert [(f.path, f.added) for f in files] == [("src/a.py", ["def g():", "    return 1", "z = 3"]), ("README.md", ["text"]), ("only.py", [])]
    assert one(spark, diffs.new_lines(F.lit(DIFF), F.lit("src/a.py"))) == [4, 12] and one(spark, diffs.new_lines(F.lit(DIFF), F.lit("none"))) == []
    assert one(spark, diffs.added_simple(F.lit("+a\n+b\n+c"), 2, 3)) == "a\nb"
    assert one(spark, deployable.changed_files(F.lit(None).cast("string"))) == []


def test_features_of_a_diff(spark):
    rows = spark.createDataFrame([(1, DIFF), (2, "no files"), (3, None)], "pr_id int, diff string")
    got = deployable.features(rows, 3.0).collect()
    assert [r.pr_id for r in got] == [1] and got[0].__fields__[1:] == deployable.NAMES
    r = got[0]
    assert (r.num_changed_files, r.total_additions, r.total_deletions, r.large_pr_flag, r.num_code_files, r.num_doc_files, r.has_py) == (3, 4, 1, 1, 2, 1, 1)
    assert (r.ast_files_attempted, r.ast_files_parsed, r.ast_func_def_count, r.ast_return_count, r.ast_assignment_count, r.ast_total_nodes) == (1, 1, 1, 1, 1, 6)
    assert (r.cfg_files_with_cfg, r.cfg_exit_nodes, r.ast_missing, r.cfg_missing) == (1, 1, 0, 0)
    assert deployable.compatible(deployable.NAMES)["fits"] and deployable.compatible(["x"])["missing"] == ["x"]


def test_bundles_without_children(spark):
    detail = spark.createDataFrame([(1, 2, "r", "t", None, "a", "d", None, "closed")], "pr_id long, pr_number long, repo string, title string, body string, author string, created_at string, merged boolean, state string")
    empty = lambda s: spark.createDataFrame([], "pr_id long, pos int, " + s)
    whole = requests.bundle(detail, empty("login string, state string, body string"), empty("path string, line int, body string"), empty("path string, additions long, deletions long, patch string"), empty("message string"), empty("name string"))
    r = requests.project(whole).first()
    assert (r.merge_status, r.review_decision, r.num_changed_files, r.label_names, r.pr_length, r.has_ai_generated_code) == ("closed_not_merged", "NONE", 0, "", 1, False)
    assert requests.project(whole, "v2").first().ai_detection_reason == ""


def test_few_rows_fall_back_to_the_seed(spark):
    seed = spark.createDataFrame([("r", 1, 10)], "repo string, number int, pr_id int")
    new = spark.createDataFrame([("r", 1, 11), ("r", 2, 10), ("r", 3, 12), ("r", 4, None)], "repo string, number int, pr_id int")
    assert sorted(r.number for r in requests.unseen(new, seed, ["repo", "number"], "pr_id").collect()) == [3, 4]
    assert [r.origin for r in requests.enhanced(seed, new, ["repo", "number"], "pr_id").collect()] == ["seed"]
    assert len(requests.enhanced(seed, new, ["repo", "number"], "pr_id", 3).collect()) == 3


def test_evaluation(spark):
    words = lambda s: array(*s.split())
    assert one(spark, evaluation.precision_words(words("a a b"), words("a c"))) == pytest.approx(2 / 3)
    assert one(spark, evaluation.precision_rouge2(words("a b a b"), words("b a"))) == 0.5 and one(spark, evaluation.precision_rouge2(words("a"), words("b"))) is None
    assert one(spark, evaluation.precision_rouge2(words("a"), words("b"), 0.0)) == 0.0
    assert one(spark, evaluation.risk_coverage(array("null check", "speed"), array("Check for nulls"))) == 0.5 and one(spark, evaluation.risk_coverage(array(), array("x"))) is None
    assert one(spark, evaluation.keyword_share(array("please check", "x", "y", "z"), evaluation.ACTION)) == 0.5
    assert one(spark, evaluation.title_overlap(words("fix a bug"), words("bug fix"))) == pytest.approx(2 / 3)
    rows = spark.createDataFrame([("m", [], ["f"], None)], "method string, comments array<struct<severity:string,comment:string>>, factors array<string>, reference string")
    r = evaluation.comment_quality(rows, ["method"]).first()
    assert (r.total_comments, r.avg_bleu, r.n_with_real, r.avg_risk_coverage) == (0, 0.0, 0, 0.0)


def test_budget_drops_history_first(spark):
    long = "word " * 12_000
    whole = lambda base, history: one(spark, contexts.combined(F.lit(base), F.lit("RISK"), F.lit("POLICY"), F.lit(history), "C8"))
    assert whole("base", "HISTORY").endswith("HISTORY") and "HISTORY" not in whole("base", "HISTORY " + long)
    assert whole(long, "HISTORY").endswith("POLICY") and len(whole(long, "h")) <= 8000 + 100
    assert one(spark, contexts.combined(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), "C6")) == "a\n\n---\n\nb\n\n---\n\nc"
    assert one(spark, contexts.leaks(F.lit("x IS_MERGED y"))) == ["is_merged"]


def test_history_text(spark):
    kind = "array<struct<rank:int,score:double,title:string,repo:string,files:int,additions:long,deletions:long,merged:boolean,review:string>>"
    rows = spark.createDataFrame([([(1, 7.25, "t", "r", 2, 5, 1, True, "good")],), ([],)], f"n {kind}")
    some, none = (r[0] for r in rows.select(contexts.history_text(F.col("n"))).collect())
    assert "score 7.3" in some and "- Files: 2, lines: +5 -1" in some and "merged" in some and "- Review: good" in some and none.endswith("No other requests.")


def test_service(spark):
    kind = "request_id long, time timestamp, kind string, files array<struct<path:string,content:string>>, diff string"
    import datetime

    at = datetime.datetime(2026, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([(1, at, "file", [("src/a.py", "x = 1\n# TODO\nprint(x)")], None), (2, at, "file", [("a", None)], None), (3, at, "git_diff", [], ""), (4, at, "git_diff", [], "+def f():")], kind)
    got = {r.request_id: r for r in service.review(rows, True).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["completed", "failed", "failed", "completed"]
    assert got[1].history_id.startswith("20260102T030405-") and got[1].source_files == {"src/a.py": "x = 1\n# TODO\nprint(x)"} and got[2].source_files is None and got[2].prediction is None
    assert "diff" not in service.review(rows).columns and service.review(rows).first().history_id in {r.history_id for r in got.values()}
    found = {(r.rule, r.hit_file, r.line, r.severity, r.file) for r in service.comments(rules.score(rows, F.col("files"), F.col("diff")), "request_id").where("request_id = 1").collect()}
    assert ("todo-or-placeholder", "src/a.py", 2, "minor", "src/a.py") in found and ("debug-print", "src/a.py", 3, "minor", "src/a.py") in found and ("missing-test", None, None, "major", "src/a.py") in found
    models = spark.createDataFrame([("a", "llm", False), ("b", "rules", True), ("c", "svm", True)], "id string, kind string, ready boolean")
    assert service.choose(models).first().id == "c" and service.choose(models, "b").first().id == "b" and not service.choose(models.where("not ready")).collect()
    bad = lambda **k: one(spark, service.invalid(F.lit("file"), array("x"), F.lit(""), **{n: F.lit(v) for n, v in k.items()}))
    assert bad(line=0) and bad(probability=1.5) and bad(most=0) and bad(line=1, probability=0.5, most=10) is None


@pytest.fixture(scope="module")
def learnable(spark):
    rows = [(i, float(i % 10), float((i * 7) % 11), int(i % 10 > 4), "train" if i % 7 < 5 else "test") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id int, a double, b double, label int, split string")


def test_models(spark, learnable, tmp_path):
    train, test = F.col("split") == "train", F.col("split") == "test"
    model, tried = ml.searched(learnable.where(train), ["a", "b"], "forest", {"maxDepth": [1, 4], "numTrees": [5]}, folds=2)
    assert len(tried) == 2 and max(m for _, m in tried) > 0.9
    assert ml.importances(model, ["a", "b"])[0][0] == "a"
    found = {n: auc for n, _, auc in ml.ablation(learnable, train, test, {"good": ["a"], "noise": ["b"]}, numTrees=5)}
    assert found["good"] > 0.95 > found["noise"]
    for kind in ("logistic", "svm", "forest"):
        rows = ml.scored(ml.fit(learnable.where(train), ["a", "b"], kind), learnable.where(test), "doc_id").collect()
        assert sum(r.guess == r.label for r in rows) / len(rows) > 0.9
    ml.save(model, ["a", "b"], str(tmp_path / "m"))
    again = ml.load(spark, str(tmp_path / "m"), ["a", "b"])
    assert ml.scored(again, learnable, "doc_id").collect() == ml.scored(model, learnable, "doc_id").collect()
    with pytest.raises(ValueError):
        ml.load(spark, str(tmp_path / "m"), ["b", "a"])


def test_feature_preparation(spark):
    rows = spark.createDataFrame([(1, 1.0, True), (2, 3.0, True), (3, 100.0, False), (4, None, False)], "k int, x double, train boolean")
    assert [r.x for r in ml.winsorize(rows, ["x"], F.col("train"), 1.0).orderBy("k").collect()] == [1.0, 3.0, 3.0, 3.0]
    assert [tuple(r) for r in ml.matrix(rows, ["k"], ["none", "x"]).orderBy("k").collect()] == [(1, 0.0, 1.0), (2, 0.0, 3.0), (3, 0.0, 100.0), (4, 0.0, 0.0)]
    labelled = spark.createDataFrame([(1, True), (1, True), (0, True), (0, False)], "label int, train boolean")
    assert {r.guess for r in ml.majority(labelled, F.col("train")).collect()} == {1}


def test_sources_and_sinks(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("a int, b string, c int")
    (tmp_path / "x.csv").write_bytes('﻿b,a\n"two\nlines ""q""",1\nz,no\n'.encode())
    got = {r.b: r.a for r in io.csv(spark, str(tmp_path / "x.csv"), schema).collect()}
    assert got == {'two\nlines "q"': 1, "z": None}
    assert io.csv_text(spark, str(tmp_path / "missing.csv"), ["a"]).collect() == []
    rows = spark.createDataFrame([(1, 'x "y"\nz'), (2, None)], "a int, b string")
    io.write_csv(rows, str(tmp_path / "out"))
    assert {r.a: r.b for r in io.csv(spark, str(tmp_path / "out"), StructType.fromDDL("a int, b string")).collect()}[1] == 'x "y"\nz'
    assert next(tmp_path.glob("out/*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    io.write_json(rows, str(tmp_path / "j"))
    assert io.json_lines(spark, str(tmp_path / "j"), StructType.fromDDL("a int, b string")).count() == 2
    io.write_json(rows, str(tmp_path / "k"), 2)
    assert '\n  "a": 1' in "".join(p.read_text() for p in tmp_path.glob("k/*.txt"))
    assert io.json_array(spark, str(tmp_path / "j"), StructType.fromDDL("a int")).count() == 2
    for _ in range(2):
        io.append_history(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    text = io.report("Title", {"T": rows.orderBy("a").select("a")})
    assert text == "# Title\n\n## T\n| a |\n|---|\n| 1 |\n| 2 |\n" and "a\n1\n2" in io.report("Title", {"T": rows.orderBy("a").select("a")}, markdown=False)
    io.write_text(spark, "one", str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "one"


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def test_requests_are_tried_again():
    clock = Clock()
    pace = rest.Pace(0, clock=lambda: clock.now, sleep=clock.sleep)
    answers = iter([(429, {"Retry-After": "2"}, None), (503, {}, None), (200, {}, [1])])
    assert rest.get(lambda u, p: next(answers), "u", {}, pace)[0] == [1] and clock.slept == [3, 3]
    assert rest.get(lambda u, p: (404, {}, None), "u", {}, pace)[0] is None
    clock.slept.clear()

    def broken(u, p):
        raise ConnectionError

    with pytest.raises(rest.Unavailable):
        rest.get(broken, "u", {}, pace)
    assert clock.slept == [2, 3, 5, 9, 17]
    pace.after({"X-RateLimit-Remaining": "3", "X-RateLimit-Reset": str(clock.now + 10)})
    clock.slept.clear()
    pace.before()
    assert clock.slept == [11]


def test_pages():
    assert rest.links('<https://x/?page=2>; rel="next", <https://x/?page=9>; rel="last"') == {"next": "https://x/?page=2", "last": "https://x/?page=9"} and rest.links(None) == {}
    pace = rest.Pace(0)
    numbered = lambda u, p: (200, {}, [{"number": (p["page"] - 1) * 2 + i} for i in range(2 if p["page"] < 3 else 1)])
    assert [x["number"] for x in rest.pages(numbered, "u", pace, 2)] == [0, 1, 2, 3, 4]
    assert [x["number"] for x in rest.pages(numbered, "u", pace, 2, 3)] == [0, 1, 2]
    linked = lambda u, p: (200, {"Link": '<b>; rel="next"'} if u == "a" else {}, [{"u": u}])
    assert [x["u"] for x in rest.pages(linked, "a", pace)] == ["a", "b"]


def test_rest_source(spark, tmp_path):
    (tmp_path / "paged_client.py").write_text("def get(url, params):\n    n = [{'number': i, 'title': 't%d' % i, 'labels': [i]} for i in range(25)]\n    a = (params['page'] - 1) * params['per_page']\n    return 200, {}, n[a:a + params['per_page']]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "paged_client.py"))
    spark.dataSource.register(rest.RestSource)
    rows = spark.read.format("rest").schema("number long, labels string").option("url", "u").option("client", "paged_client:get").option("per_page", "4").option("partitions", "3").option("delay", "0").load()
    assert sorted((r.number, json.loads(r.labels)) for r in rows.collect()) == [(i, [i]) for i in range(25)]


def test_paths(spark):
    assert one(spark, paths.language(F.lit("a/b.KT"))) == "kotlin" and one(spark, paths.language(F.lit("Makefile"))) is None


def test_changed_files_of_any_diff_and_a_long_one(spark):
    """Against a walk over the lines, and 100,000 added lines in one file and over many."""
    import random
    import re
    import time

    def walk(diff):
        files, at = {}, None
        for x in (diff or "").split("\n"):
            m = re.fullmatch("diff --git a/(.+) b/(.+)", x)
            if m or x.startswith("+++ b/"):
                at = m[2] if m else x[6:]
                files.setdefault(at, [])
            elif at is not None and x.startswith("+") and not x.startswith("+++"):
                files[at].append(x[1:])
        return list(files.items())

    r = random.Random(2)
    some = ["diff --git a/x b/x", "diff --git a/y b/y", "+++ b/x", "+++ b/z", "+++ /dev/null", "+one", "+", "++two", "-gone", " same", "diff --git a/x", "@@ -1 +1 @@", "+++"]
    texts = [None, "", *["\n".join(r.choice(some) for _ in range(r.randint(0, 25))) for _ in range(200)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, d string")
    for x in rows.select("k", deployable.changed_files(F.col("d")).alias("f")).collect():
        assert [(f.path, list(f.added)) for f in x.f] == walk(texts[x.k]), texts[x.k]
    for files in (1, 2000):
        long = "\n".join(f"diff --git a/f{i} b/f{i}\n+++ b/f{i}\n" + "\n".join(f"+line {j}" for j in range(100_000 // files)) for i in range(files))
        row = spark.createDataFrame([(long,)], "d string").repartition(1).cache()
        row.count()
        began = time.time()
        assert row.select(F.size(deployable.changed_files(F.col("d")))).first()[0] == files
        assert time.time() - began < 5


def test_flow_against_a_graph(spark):
    """Figures of the fold against nodes and edges kept in lists, on random files with lines of all classes in all languages."""
    import random

    from mergelens.plans.reviews import LINES

    def graph(lines, ext):
        known = [x for x in (structure.classified_line(x, ext) for x in lines) if x is not None] or [("statement", 0)]
        nodes, edges, stack, deepest, fresh, entered = ["entry"], [], [], 0, False, set()
        last = 0
        for name, level in known:
            while stack and stack[-1]["level"] >= level:
                deepest = max(deepest, len(stack))
                stack.pop()
            node = len(nodes)
            if name == "else":
                if not stack or not stack[-1]["branch"]:
                    continue
                edges.append((stack[-1]["node"], node))
                stack[-1] = {"node": node, "level": level, "branch": True}
                fresh = True
            else:
                edges.append((last, node))
                if name in ("branch", "loop"):
                    stack.append({"node": node, "level": level, "branch": name == "branch"})
                    fresh = True
                elif name in ("statement", "exit"):
                    if fresh and stack:
                        if stack[-1]["node"] not in entered:
                            entered.add(stack[-1]["node"])
                            edges.append((stack[-1]["node"], node))
                        fresh = False
                else:
                    fresh = False
            nodes.append(name)
            last = node
        count = lambda *k: sum(n in k for n in nodes)
        return (len(nodes), len(edges), count("branch", "else"), count("loop"), count("exit", "jump"), max(0, len(edges) - len(nodes) + 2), deepest, round(len(edges) / max(len({a for a, _ in edges}), 1), 4))

    r, rows, classes = random.Random(8), [], set()
    for ext, some in LINES.items():
        indented = [" " * r.choice([0, 0, 4, 8, 12]) + x.strip() for x in some for _ in range(4)] + ["", "  ", "break", "else:", "else {", "  else {", "case 1:", "raise E", "finally:"]
        for _ in range(60):
            lines = [r.choice(indented) for _ in range(r.randint(1, 40))]
            classes |= {x[0] for x in map(lambda line: structure.classified_line(line, ext), lines) if x}  # noqa: B023
            rows.append((len(rows), "\n".join(lines), ext))
    assert classes == {"exit", "jump", "branch", "else", "loop", "exception", "statement"}
    found = spark.createDataFrame(rows, "k int, code string, ext string").select("k", "code", "ext", structure.flow(F.col("code"), F.col("ext")).alias("x")).collect()
    for x in found:
        want = graph(x.code.split("\n"), x.ext) if x.code.strip() else (0, 0, 0, 0, 0, 0, 0, 0.0)
        assert tuple(x.x) == want, (x.ext, x.code)


def test_no_template_is_left_out(spark):
    rows = spark.createDataFrame([(1, "c")], "k int, context string")
    templates = lambda n: spark.createDataFrame([(f"P{i}", "s", "u {context}", False) for i in range(n)], "prompt string, system string, user string, few_shot boolean")
    assert contexts.messages(rows, templates(100)).count() == 100
    with pytest.raises(ValueError, match="templates"):
        contexts.messages(rows, templates(contexts.TEMPLATES + 1))


def test_checklist_looks_at_patches_and_flags(spark):
    files = F.array(F.struct(F.lit("a.py").alias("path"), F.lit("x").alias("added")))
    said = lambda **more: one(spark, contexts.checklist(files, F.lit("t"), F.lit("b" * 200), F.lit(1), F.lit(""), **more))
    assert "API_CHANGE" not in said() and "Flagged" not in said()
    assert "API_CHANGE_NO_DOCS" in said(patches=array("-export y")) and "Flagged as generated code" in said(flagged=F.lit(True))
