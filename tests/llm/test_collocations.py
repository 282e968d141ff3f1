"""Phrases against a plain count of all n-grams, with shared buckets, nulls, ties, repeated rows and an empty table."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from mergelens.llm import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, ranks=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        known = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        rows = []
        for p, a in known.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items()):
                continue
            score, cut = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p.decode(), a, left, right, n[lang], -s) for i, (s, _, p, a, left, right) in enumerate(sorted(rows)[:ranks], 1)]
    return sorted(out)


def found(spark, docs, **more):
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, a int, phrase string").repartition(3)
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(rows, **more).collect())


def prose(seed, n, letters="abcdefgh"):
    r, out = random.Random(seed), []
    for _ in range(n):
        text = "".join(r.choice([*letters, "The quick", "é日", "the quick brown fox"]) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  ", " . "]) for _ in range(r.randint(0, 40)))
        out.append((r.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out


@pytest.mark.parametrize(("seed", "buckets"), [(1, 1 << 14), (2, 1 << 20)])
def test_random_texts(spark, seed, buckets):
    docs = prose(seed, 150) + [("en", None), (None, None), ("en", ""), ("xx", "...")] + [("fr", "même texte ici. " * 4)] * 3
    assert found(spark, docs, least=9, buckets=buckets) == brute(docs, 9)
    assert found(spark, docs, least=9, ranks=3, buckets=buckets) == brute(docs, 9, 3)


def test_crowded_buckets_change_nothing(spark):
    """Far more phrases than buckets."""
    r = random.Random(7)
    docs = [("en", " ".join(str(r.randint(0, 400)) if r.random() < 0.9 else "a b c" for _ in range(4000))) for _ in range(20)]
    assert found(spark, docs, least=9, buckets=1 << 14) == brute(docs, 9)


def test_empty_table_and_bounds(spark):
    assert found(spark, [], least=2) == []
    assert found(spark, [("en", "a b")], least=2) == []
    with pytest.raises(ValueError):
        found(spark, [], least=256)


def test_a_very_long_text(spark):
    docs = [("en", "one two three " * 200_000)]
    assert found(spark, docs, least=30) == brute(docs, 30)


def test_whole_table(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.ORACLE})").fetchall())
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.op13_collocations(spark, sf).collect()) == want
