"""Chunks, thresholds, names that clash and markup without an end."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mergelens.llm import bpe, fingerprint, language, near, packing, quality, repeats, tokenfile, topk
from mergelens.llm.encoder import read_spec

BYTE, WORD = (read_spec(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def test_chunks_of_texts_give_the_same_ids():
    machine, library, r = bpe.Transducer(BYTE, 64), Tokenizer.from_str(BYTE), random.Random(4)
    parts = ["a", " ", "  ", "\n", "the", " of", "tion", ".", "<|endoftext|>", "é", "日本", "\t", "x" * 40]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 200)))
        ids = library.encode(t, add_special_tokens=False).ids
        arrays = list(machine.emit(t, 16))
        assert np.concatenate([*arrays, np.zeros(0, int)]).tolist() == ids
        assert "".join(machine.decoded(iter(arrays))) == t


def test_no_array_grows_with_the_text():
    machine = bpe.Transducer(BYTE)
    r = random.Random(5)
    solid = "".join(r.choice("abcdefghilmnorst") for _ in range(600_000))
    spaced = "some words of a long text " * 120_000
    for t in (solid, spaced):
        back, most = hashlib.sha256(), 0
        for part in machine.decoded(machine.emit(t)):
            most = max(most, len(part))
            back.update(part.encode())
        assert most <= 4 * bpe.CHUNK and back.digest() == hashlib.sha256(t.encode()).digest()


def test_levels_prune():
    r = np.random.default_rng(5)
    rows, ids = np.floor(1024 * r.normal(size=(4000, 32))), np.arange(4000)
    seen = np.zeros(len(topk.statistics(rows[:1])) + 1, np.int64)
    list(topk.search(rows[:20], ids[:20], rows, ids, 10, None, seen))
    first = seen.copy()
    assert first[-1] < first[0]
    exact = np.sort(rows[:20] @ rows.T, axis=1)[:, -12]
    list(topk.search(rows[:20], ids[:20], rows, ids, 10, exact, seen))
    assert (np.diff(first) <= 0).all()


def test_names_that_clash(spark):
    rows = [(1, "some text here", "a", "b", 1.0, 2), (2, None, "a", "b", 1.0, 2)]
    names = ["fingerprint", "decoded", "score", "predicted"]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} string, {names[1]} string, {names[2]} double, {names[3]} int")
    assert fingerprint.fingerprints(docs).columns.count("fingerprint") == 1
    assert [r.decoded for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).orderBy("doc_id").collect()] == ["some text here", ""]
    model = quality.Model((), None, 0.25)
    assert [(r.score, r.predicted) for r in quality.score(docs, model).collect()] == [(0.25, 0)] * 2
    more = docs.selectExpr("*", "1 AS class_id", "2 AS start", "3 AS bucket", "4 AS low", "5 AS host", "'x' AS lang", "'y' AS source")
    assert [near.classes(more).count(), repeats.remove(more).count(), packing.pack(more, WORD).count(), tokenfile.documents(tokenfile.write(more, WORD)).count(), language.identify_documents(more).count()] == [2] * 5


@pytest.mark.parametrize("ids", [[None, None, 3], [5, 5, 5], [None, 1, 1]])
def test_null_and_repeated_ids(spark, ids):
    text = "every word of this text stands in each of the rows, whatever the id is " * 2
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    gone = sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove(docs).collect())
    assert gone == sorted((i or 0, 0) for i in ids)
    assert packing.pack(docs, WORD).count() == tokenfile.documents(tokenfile.write(docs, WORD)).count() == 3
    assert sorted((r.doc_id or 0, r.held_out) for r in docs.select("doc_id", quality.held_out().alias("held_out")).collect()) == [(i or 0, False) if i is None else (i, bool(__import__("zlib").crc32(str(i).encode()) % 5 == 0)) for i in sorted(ids, key=lambda i: i or 0)]


def test_wide_groups_go_by_windows(spark, monkeypatch):
    from test_operators import brute_repeats

    r = random.Random(6)
    passage = "a passage that goes on in very many different ways, as "
    texts = {i: passage + "".join(r.choice("abc ") for _ in range(60)) for i in range(60)}
    monkeypatch.setattr(repeats, "WIDE", 500)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: tuple(x)[1:5] for x in repeats.remove(docs).collect()} == brute_repeats(texts)


def test_longest_previous_factors():
    """Lengths and places against all pairs of suffixes."""
    r = random.Random(4)
    for _ in range(150):
        letters = r.choice(["a", "ab", "\0a", "abc"])
        texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 8, 9, 17, r.randint(0, 90)]))).encode() for _ in range(r.randint(1, 6))]
        docs = np.sort(np.array([r.randint(0, 4) for _ in texts]))
        least = r.choice([1, 1, 7, 8, 20])
        starts, factor, source = repeats.previous_factors(texts, docs, least)
        flat = b"".join(texts)
        for i, t in enumerate(texts):
            earlier = [texts[q] for q in range(len(texts)) if docs[q] < docs[i]]
            for j in range(len(t)):
                want = max((k for k in range(1, len(t) - j + 1) if any(t[j : j + k] in e for e in earlier)), default=0)
                at = starts[i] + j
                assert factor[at] == want or max(factor[at], want) < least
                assert flat[source[at] : source[at] + factor[at]] == t[j : j + factor[at]]


def test_findings_are_looked_up_by_document_and_hash():
    """Keys that meet in the mixture but differ in document or hash are not taken for each other."""
    mixed = np.array([5, 5, 5, 9], np.uint64)
    docs, wholes = np.array([1, 2, 2, 3]), np.array([7, 7, 8, 1], np.uint64)
    whole = np.array([8, 9], np.uint64)
    real = repeats.mix(whole + repeats.mix(np.array([2, 2], np.int64).astype(np.uint64)))
    keys = (np.sort(np.append(mixed, real[0])), *(np.append(x, y)[np.argsort(np.append(mixed, real[0]), kind="stable")] for x, y in ((docs, 2), (wholes, np.uint64(8)))))
    where, found = repeats.looked_up(keys, np.array([2, 2]), whole)
    assert found.tolist() == [True, False] and keys[1][where[0]] == 2 and keys[2][where[0]] == 8


def test_markup():
    assert language.strip_markup("a<b>c</b>d<!-- <x> -->e<SCRIPT>if (a<b) c</script >f<style>x") == "a c d e f x"
    assert language.strip_markup("1 < 2") == "1 < 2"
    for part in ("<script", "<!--", "<", "<style>"):
        began = time.time()
        language.strip_markup(part * 200_000)
        assert time.time() - began < 5


def test_hosts_by_salts_equal_those_by_broadcast(spark):
    rows = spark.createDataFrame([(i, f"h{i % 3}", "s") for i in range(50)], "id int, host string, suffix string")
    hosts = spark.createDataFrame([(f"h{k}", "s", k) for k in range(3)], "host string, suffix string, n int")
    found = [sorted((r.id, r.n) for r in language.join_known(rows, hosts, ["host", "suffix"], most).collect()) for most in (2, 10)]
    assert found[0] == found[1] == [(i, i % 3) for i in range(50)]


def test_only_suffixes_that_are_still_alike_are_sorted_again(monkeypatch):
    r = np.random.default_rng(2)
    texts = [r.integers(97, 123, 60).astype(np.uint8).tobytes() for _ in range(200)] + [r.integers(97, 123, 5000).astype(np.uint8).tobytes()]
    texts += [texts[0] + b"x", texts[0] + b"y"]
    n, sorted_ = sum(map(len, texts)), []
    argsort = np.argsort
    monkeypatch.setattr(repeats.np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or argsort(x, *a, **k))
    starts, factor, _ = repeats.previous_factors(texts, np.arange(len(texts)), 50)
    assert factor[starts[201]] == 60 and factor[starts[202]] == 60 and (factor >= 50).sum() == 22
    assert sum(sorted_) < 2 * n  # a text of 5000 bytes asks for ten doublings
