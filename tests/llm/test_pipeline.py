"""Each stage of the corpus pipeline, rows and texts, against a brute-force version on a small corpus with rejects, copies and repeats."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from test_operators import jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from mergelens.llm import language, quality

SOURCE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SOURCE}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = next(r for r in rows if r[1] and len(r[1].split()) > 300)
    words = base[1].split(" ")
    near = " ".join([*words[:5], "changed", *words[6:]])
    part = "start of another text " + base[1][200:420] + " and its end, which is its own"
    extra = [
        (900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "12 34 !!", "en", "s", 8), (903, near, *base[2:]), (904, base[1], *base[2:]), (905, part, base[2], "s", len(part)),
        (906, part + " one more", base[2], None, 9), (906, part + " one more", base[2], None, 9), (906, "another text of that id, " + part[::-1], None, "s", 9), (None, part + " without an id", base[2], "s", 5),
    ]
    spark.createDataFrame([*rows, *extra], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SOURCE}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def language_brute(docs, spark):
    """Rows that stay: Bayes' rule over dictionaries, from the text model's likelihoods."""
    model = language.fit(spark.createDataFrame(docs, SCHEMA))
    scores = model.likelihoods([r[1] or "" for r in docs])
    own = np.exp(scores - scores.max(axis=1, keepdims=True))
    own /= own.sum(axis=1, keepdims=True)
    hosts, declared = Counter(), Counter()
    for r, o in zip(docs, own, strict=True):
        hosts[r[3] or ""] = hosts[r[3] or ""] + o
        declared[(r[2] or "").strip().lower()] = declared[(r[2] or "").strip().lower()] + o
    everywhere = own.sum(axis=0) + 1
    suffix = (own.sum(axis=0) + 20 * everywhere / everywhere.sum()) / (own.sum() + 20)
    kept = []
    for r, o, s in zip(docs, own, scores, strict=True):
        host, said = hosts[r[3] or ""], (r[2] or "").strip().lower()
        logs = s + np.log((np.maximum(host - o, 0) + 10 * suffix) / (max(host.sum() - 1, 0) + 10))
        if said:
            logs = logs + np.log((np.maximum(declared[said] - o, 0) + 1) / (everywhere - o + len(declared) + 1))
        sure = 1 / np.exp(logs - logs.max()).sum() >= 0.5
        if r[1] and any(c.isalpha() for c in r[1]) and sure:
            kept.append(r)
    return kept


def quality_brute(docs, spark):
    model = quality.fit(spark.createDataFrame(docs, SCHEMA), spark.read.parquet(f"{SOURCE}/labels.parquet"))
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False) for kind, data in model.dictionaries]

    def good(text):
        data = text.encode()
        small, large = (sum(len(c.compress(data[i : i + 4096])) for i in range(0, len(data), 4096)) for c in pair)
        return 1 / (1 + math.exp(-((large - small) / len(data) * model.weights[0] + model.weights[1]))) >= 0.3

    return [r for r in docs if good(r[1])]


def near_brute(docs):
    """The first row of each component, rows whose id is missing or shared standing last: rows of the same words, or of a similarity of 0.8 or more, belong together."""
    alone = {i for i, n in Counter(r[0] for r in docs).items() if n == 1 and i is not None}
    rows = sorted(docs, key=lambda r: (r[0] not in alone, r[0] is None, r[0] or 0))
    words = [r[1].lower().split() for r in rows]
    sets = [Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for w in words]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for k in range(len(rows)):
        for j in range(k):
            if words[k] and (words[j] == words[k] or sets[j].keys() & sets[k].keys() and jaccard(sets[j], sets[k]) >= 0.8):
                p, q = sorted((root(j), root(k)))
                parent[q] = p
    return [r for i, r in enumerate(rows) if root(i) == i]


def repeats_brute(docs, n=50):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            for k in range(len(data := t.encode()) - n + 1):
                first[data[k : k + n]] = min(first.get(data[k : k + n], i), i)
    out = []
    for i, t, lang, source, _ in docs:
        data = t.encode()
        stays = np.ones(len(data), bool)
        for k in range(len(data) - n + 1):
            if i is not None and first[data[k : k + n]] < i:
                stays[k : k + n] = False
        kept = np.frombuffer(data, np.uint8)[stays].tobytes().decode("utf-8", "ignore")
        out.append((i, kept, lang, source, len(kept)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v) for v in r])


def test_every_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    brute = {"language": lambda x: language_brute(x, spark), "quality": lambda x: quality_brute(x, spark), "near_duplicates": near_brute, "repeats": repeats_brute}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.table(stage(spark, docs, corpus), name)
        want = brute[name](rows)
        assert docs.columns == corpus_pipeline.COLUMNS and ordered(docs.collect()) == ordered(want), name
        sizes.append((len(rows), len(want)))
        if name != "repeats":
            assert len(want) < len(rows), name
        else:
            assert sum(len(r[1]) for r in want) < sum(len(r[1]) for r in rows)
        rows = [tuple(r) for r in docs.collect()]
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    pieces, total = [], 0
    for r in rows:
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces += [(r[0], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048))]
    packed = corpus_pipeline.run(spark, corpus).collect()
    assert ordered(tuple(r)[:5] for r in packed) == ordered(pieces)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= math.ceil(total / 2048) * 11 / 9 + 1


def test_empty_corpus(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
