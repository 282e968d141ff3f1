"""similar_topk against brute force: each query with all labelled rows, by all four terms."""

import math

import pytest

from mergelens.plans import catalog

DOCS = [
    (0, "one small title here\nrest", "a", 10), (50, "fix the parser bug\n" * 3, "b", 400), (100, None, None, 0), (1, "one small title here\nrest", "z", 10), (2, "other words", "a", 5000),
    (3, "fix the parser bug\n" * 40, "b", 9000), (4, "fix the parser bug\n" * 3, "c", 410), (5, "fix the lexer\n\n", "b", 420), (6, "", None, None), (7, "one small title", "a", 12), (8, "ONE small", "a", 11), (9, "one small title here", "a", 10),
]
DOCS += [(150, "same words here\nx", "m", 100), *((10 + i, "same words here\nx", "m", 100 + i) for i in range(4))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("similar"))
    spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in DOCS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def score(q, c):
    files = [len((x[1] or "").split("\n")) for x in (q, c)]
    title, other = ({*(x[1] or "").split("\n")[0].lower().split()} for x in (q, c))
    same = q[2] is not None and q[2] == c[2]
    return round(3 * same + 2 * math.exp(-abs(files[0] - files[1]) / 10) + 2 * math.exp(-abs((q[3] or 0) - (c[3] or 0)) / 500) + 2 * (len(title & other) / len(title) if title else 0), 4)


def test_all_rows_all_terms(spark, tables):
    got = {}
    for r in catalog.QUERIES["similar_topk"](spark, tables).collect():
        got.setdefault(r.doc_id, []).append((-r.score, r.similar))
    for q in (x for x in DOCS if x[0] % 50 == 0):
        want = sorted((-score(q, c), c[0]) for c in DOCS if c[0] != q[0])[:3]
        assert [i for _, i in sorted(got.pop(q[0]))] == [i for _, i in want], q
    assert not got


def test_trees_and_words_lose_no_row(spark):
    """Some thousand rows, a group with most of them, words of all frequencies; few words count as rare, so all three waves have work."""
    import random

    from mergelens.operators import neighbours

    r = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", None]), r.choice([None, 1, 2, 3, r.randint(1, 60)]), int(r.expovariate(1 / 800)), [r.choice(common) for _ in range(r.randint(0, 5))] + [r.choice(rare) for _ in range(r.randint(0, 2))] or None, "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "id long, g string, f int, a int, t array<string>, score string").repartition(5)
    queries = table.where("id % 100 = 0")

    def value(q, c):
        title = set(q[4] or [])
        return round(3 * (q[1] is not None and q[1] == c[1]) + 2 * math.exp(-abs((q[2] or 0) - (c[2] or 0)) / 10) + 2 * math.exp(-abs(q[3] - c[3]) / 500) + 2 * (len(title & set(c[4] or [])) / len(title) if title else 0), 4)

    for k, limit in ((3, 8), (1, 10_000), (40, 0)):
        got = {}
        for x in neighbours.similar(table, queries, "id", "g", "f", "a", "t", k, limit).collect():
            got.setdefault(x.id, []).append((-x.score, x.similar))
        assert len(got) == 30
        for i, found in got.items():
            want = sorted((-value(rows[i], c), c[0]) for c in rows if c[0] != i)[:k]
            assert [s for s, _ in sorted(found)] == pytest.approx([s for s, _ in want], abs=2e-4)
            sure = {j for s, j in want if s < want[-1][0] - 2e-4}  # a score that rounds the other way may change places with its equal
            assert sure <= {j for _, j in found}
    assert neighbours.similar(table.limit(0), queries, "id", "g", "f", "a", "t", 3).count() == 0
    assert neighbours.similar(table, queries.limit(0), "id", "g", "f", "a", "t", 3).count() == 0
    assert {x.id for x in neighbours.similar(table.where("id < 2"), table.where("id < 2"), "id", "g", "f", "a", "t", 3).collect()} == {0, 1}
