"""Ranked lexical search against DuckDB and a plain walk over all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from mergelens.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, k=50):
    """docs: (doc_id, text); items: (item_id, text)."""
    there = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(there), sum(sum(c.values()) for _, c in there)
    df = Counter(t for _, c in there for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for doc, c in there:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=50, kept=""):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, position int")
    q = lexical.queries_of(spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string"))
    rows = lexical.search(lexical.build(d, q), q, k=k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def test_odd_rows(spark):
    docs = [(1, "Apple pie, apple tart"), (2, None), (3, ""), (4, "..."), (5, "apple pie, apple tart"), (5, "apple pie, apple tart"), (6, "ÄPFEL Äpfel é1 pie"), (None, "pie pie"), (8, "apple\x00pie"), (9, "pie " * 50_000), (7, "0")]
    items = [(1, "apple PIE"), (2, None), (3, ""), (4, "nothing"), (5, "Äpfel"), (None, "tart"), (6, "pie"), (6, "0")]
    for k in (50, 2):
        assert found(spark, docs, items, k) == brute(docs, items, k)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == []


def test_many_segments_with_ties(spark):
    r = random.Random(2)
    docs = [(i * 3, " ".join(r.choice("abcdefghij") * r.choice([1, 1, 2]) for _ in range(r.randint(1, 6)))) for i in range(3 * lexical.SEGMENT)]
    items = [(i, " ".join(r.choice("abcdefghij") * r.choice([1, 2]) for _ in range(r.randint(1, 5)))) for i in range(12)]
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("seed", range(6))
def test_best_first_opens_no_more_than_bounds_ask(seed):
    r = np.random.default_rng(seed)
    leaves = np.where(r.random((5, lexical.SEGMENT)) < 0.03, r.integers(0, 1000, (5, lexical.SEGMENT)) // 50 * 50, 0)
    flat = np.stack([lexical.grown(np.flatnonzero(row), row[row > 0]) for row in leaves])
    trees, weights = [flat[:, :256], flat[:, 256:]], np.array([3, 1, 7, 0, 2])
    scores = (weights[:, None] * leaves).sum(axis=0)
    order = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)
    for floor in (0, -order[20][0]):
        opened = [0, 0]
        want = [(-s, i) for s, i in order[:10] if -s >= floor]
        assert lexical.best_first(weights, trees, leaves, 10, floor, opened) == want
        least = max(floor, want[-1][0])
        assert opened[0] <= int(((weights[:, None] * trees[0]).sum(axis=0) >= least).sum()) < 256


def test_whole_table(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.ORACLE})").fetchall())
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op12_lexical(spark, sf).collect()) == want
