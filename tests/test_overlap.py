"""The text-overlap queries against brute force: all documents with all items, over whole texts."""

import math

import pytest

from mergelens.operators.similarity import lcs
from mergelens.plans import catalog

PASSAGE = "The planted passage has Nine words and ends here"
DOCS = {1: "filler word " * 100 + PASSAGE, 2: PASSAGE, 3: "", 4: None, 5: "the the passage", 41: "x" * 400 + " " + PASSAGE + " " + PASSAGE, 80: "ends here\tthe planted  nine", 7: "zwei"}
ITEMS = {0: PASSAGE.lower(), 3: "word filler", 9: "the planted word has nine", 11: "", 300: "a b a b a b ends here " * 20}


def grams(t, n):
    return [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]


def bleu(a, b, most):
    if not a or not b:
        return 0.0
    logs = [math.log(max(sum(g in grams(b, n) for g in grams(a, n)) / (len(a) - n + 1), 1e-10)) for n in range(1, min(most, len(a)) + 1)]
    return math.exp(sum(logs) / len(logs)) * (1 if len(a) >= len(b) else math.exp(1 - len(b) / len(a)))


def ratio(x, y):
    return x / y if y else 0.0


BRUTE = {
    "rouge_sets": lambda a, b: ratio(2 * len({*a} & {*b}), len({*a}) + len({*b})),
    "bleu1": lambda a, b: bleu(a, b, 1),
    "bleu4": lambda a, b: bleu(a, b, 4),
    "lcs_rouge_l": lambda a, b: ratio(2 * lcs(a, b), len(a) + len(b)),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("overlap"))
    spark.createDataFrame(list(DOCS.items()), "doc_id long, text string").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", BRUTE)
def test_all_pairs_whole_texts(spark, tables, name):
    got = {(r[0], r[1]): r[2] for r in catalog.QUERIES[name](spark, tables).collect()}
    words = lambda t: (t or "").lower().split()
    want = {(i, j): BRUTE[name](words(a), words(b)) for i, a in DOCS.items() for j, b in ITEMS.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 6e-5 for k in want), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) >= 6e-5}
