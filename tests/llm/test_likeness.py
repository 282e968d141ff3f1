"""Fingerprints, quality and language against figures that the operators do not use themselves."""

import numpy as np

from mergelens.llm import fingerprint, language, quality


def grams(t, n=16):
    data = t.encode()
    return {data[i : i + n] for i in range(len(data) - n + 1)}


def test_likeness_follows_common_substrings(spark):
    rows = [r for r in fingerprint.with_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect() if r.n_chars > 500]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    real = []
    for r in rows:
        t, n = texts[r.doc_id], len(texts[r.doc_id]) // 4
        a, b = grams(t), grams(t[: len(t) - n] + texts[after[r.doc_id]][:n])
        real.append(len(a & b) / len(a | b))
    found = np.array([r.near_edited for r in rows])
    assert np.abs(found - np.array(real)).mean() < 0.08
    assert max(r.near_next for r in rows) < 0.2 or np.median([r.near_next for r in rows]) < 0.1


def test_quality_beats_the_majority(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.96 > len(good) / len(rows)
    assert sum(r.predicted for r in good) / len(good) > 0.98 and sum(1 - r.predicted for r in bad) / len(bad) > 0.85


def test_language_of_pages_with_wrong_or_no_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    rows = [(r.doc_id, f"http://h{r.doc_id}.example/", f"<html lang='{'xx' if r.doc_id % 2 else 'en'}'><body><p>{r.text}</p></body></html>", r.lang) for r in docs.where("doc_id % 3 = 0").collect()]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    truth = {r[0]: r[3] for r in rows}
    found = language.identify_pages(pages, docs.where("doc_id % 3 > 0")).collect()  # the pages' texts are held out
    assert sum(r.language == truth[r.page_id] for r in found) / len(found) > 0.97


def test_likelihoods_agree_with_plain_counts(spark):
    """The text model against counts of one, two and three bytes in dictionaries, on texts it has not seen."""
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = language.fit(docs.where("doc_id % 3 > 0"), sample=10_000)
    seen = {n: {x: Counter() for x in model.languages} for n in (1, 2, 3)}
    for r in docs.where("doc_id % 3 > 0").collect():
        data = r.text.lower().encode()
        for n in (1, 2, 3):
            seen[n][r.lang].update(data[i : i + n] for i in range(len(data) - n + 1))
    held = docs.where("doc_id % 3 = 0").collect()
    found = model.likelihoods([r.text for r in held]).argmax(axis=1)

    def plain(text):
        data = text.lower().encode()
        value = {x: 0.0 for x in model.languages}
        for n in (1, 2, 3):
            for x, c in seen[n].items():
                total = sum(c.values()) + 0.05 * 256**n
                value[x] += sum(np.log((c[data[i : i + n]] + 0.05) / total) for i in range(len(data) - n + 1))
        return max(value, key=value.get)

    wanted = [plain(r.text) for r in held]
    assert sum(model.languages[i] == w for i, w in zip(found, wanted, strict=True)) / len(held) > 0.98
    assert sum(w == r.lang for w, r in zip(wanted, held, strict=True)) / len(held) > 0.95


def test_a_declaration_that_occurs_once_says_nothing_of_its_own(spark):
    """Of a page whose declaration no other page has, it gives no evidence: the posterior is that of no declaration but for the smoothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    texts = [r.text[:60] for r in docs.limit(6).collect()]
    rows = [(i, "http://a.example/", f"<html{' lang=qq' if i == 0 else ''}>{t}</html>") for i, t in enumerate(texts)]
    same = [(i, "http://a.example/", f"<html>{t}</html>") for i, t in enumerate(texts)]
    got = [{r.page_id: r.posterior for r in language.identify_pages(spark.createDataFrame(x, "page_id long, url string, html string"), docs).collect()} for x in (rows, same)]
    assert abs(got[0][0] - got[1][0]) < 0.2
