"""Every label is a class, however many there are, and whole texts teach the model."""

import random

import numpy as np

from mergelens.llm import language


def text(k, seed):
    r = random.Random(k)
    stems = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
    draw = random.Random(seed)
    return " ".join(draw.choice(stems) for _ in range(80))


def test_rare_labels_are_classes(spark):
    rows = [(1000 * k + i, text(k, i), f"l{k:02d}") for k in range(70) for i in range(5 if k < 66 else 2)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:02d}" for k in range(70)]
    found = model.likelihoods([text(k, 999) for k in range(70)])
    assert [int(np.argmax(r)) for r in found] == list(range(70))


def test_whole_texts_are_fitted(spark):
    rows = [(10 * k + i, "same start " * 300 + text(k, i) * 3, f"l{k}") for k in range(3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.fit(docs).likelihoods([text(k, 99) for k in range(3)])
    assert [int(np.argmax(r)) for r in found] == [0, 1, 2]
