"""Every operator against brute force or an exact round trip, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mergelens.llm import bpe, fingerprint, language, licences, near, packing, quality, repeats, tokenfile, topk
from mergelens.llm.encoder import Encoder, read_spec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
BYTE, WORD = (read_spec(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeginorst") for _ in range(r.randint(2, 9))) for _ in range(n))


TEXTS = {
    1: words(1, 300), 2: None, 3: "", 4: words(1, 300), 5: words(1, 290) + " " + words(9, 10), 6: "zwölf Boxkämpfer jagen Eva quer über den großen Sylter Deich " * 3,
    7: words(2, 40) + " é日本 " + words(3, 60), 8: words(4, 30) + " " + words(3, 60), 9: "x", 10: words(5, 6000), 11: "a  b\n\n c <|endoftext|> d", 12: words(2, 40), 13: "ñ" * 3000,
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 0.5) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(i):
    return TEXTS[i] or ""


def test_encoders_equal_the_library():
    machine, own, library = bpe.Transducer(BYTE, 64), Encoder(WORD), Tokenizer.from_str(BYTE)
    r = random.Random(3)
    parts = ["a", "É", " ", "  ", "\n", "'s", "<|endoftext|>", "12", "½", "日本", "\x1c", "\x85", "　", "é", "Σ", "İ", "😀", "$$", "ª", "the", "tion", "."]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert machine.ids(t).tolist() == ids
        assert "".join(machine.decode(machine.ids(t), 3)) == library.decode(ids, skip_special_tokens=False)
        assert own.ids(t).tolist() == own.library.encode(t, add_special_tokens=False).ids
    long = "".join(r.choice("abcdefghilmnorst") for _ in range(20_000))
    assert machine.ids(long).tolist() == library.encode(long, add_special_tokens=False).ids
    assert "".join(machine.decode(np.array([160, 101, 222]))) == library.decode([160, 101, 222], skip_special_tokens=False)


def test_bpe_digests(docs, none):
    library = Tokenizer.from_str(BYTE)
    for row in bpe.digests(docs, BYTE).collect():
        ids = library.encode(text(row.doc_id), add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text(row.doc_id).encode()).hexdigest()
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()}
    assert all(back[i].decoded == text(i) for i in TEXTS)
    assert bpe.digests(none, BYTE).count() == 0


def test_packing(docs, none):
    code = Encoder(WORD)
    rows = packing.pack(docs, WORD, size=256).collect()
    ids = {i: np.append(code.ids(TEXTS[i]), 0).astype("<u4") for i in TEXTS}
    seen, sequences = Counter(), {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 256 and zlib.crc32(part) == r.ids_crc32 and r.start == 256 * r.piece
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(v) for i, v in ids.items()}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(none, WORD).count() == 0


def test_plan_fills_every_rank():
    r = random.Random(1)
    for _ in range(200):
        size = r.choice([8, 50, 128])
        counts = Counter(r.randint(1, size) for _ in range(r.randint(1, 300)))
        used, rooms = Counter(), Counter()
        for length, first, n, sequence, offset in packing.plan(counts, size):
            assert first == used[length]
            used[length] += n
            for k in range(n):
                for at in range(offset, offset + length):
                    rooms[sequence + k, at] += 1
        assert used == counts and set(rooms.values()) == {1} and all(at < size for _, at in rooms)
        least = -(-sum(k * n for k, n in counts.items()) // size)
        assert len({s for s, _ in rooms}) <= least * 11 / 9 + 1


def test_token_file(docs, none):
    code, at = Encoder(WORD), 0
    rows = {r.doc_id: r for r in tokenfile.documents(tokenfile.write(docs, WORD, shard_ids=500)).collect()}
    for i in sorted(TEXTS):
        ids = np.append(code.ids(TEXTS[i]), 1).astype("<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert tokenfile.documents(tokenfile.write(none, WORD)).count() == 0


def test_grammar_round_trip():
    r = np.random.default_rng(2)
    for k in range(200):
        stop = int(r.integers(2, 12))
        parts = [r.integers(0, stop - 1, r.integers(0, 300)) if r.random() < 0.7 else np.zeros(r.integers(0, 90), np.int64) for _ in range(r.integers(1, 8))]
        ids = np.concatenate([np.append(p, stop) for p in parts]).astype("<u4")
        shard = tokenfile.Shard(tokenfile.write_shard(ids, 1, stop, 2 + k % 4))
        whole = np.where(ids == stop, 1, ids)
        assert (shard.all() == whole).all()
        assert all((shard.document(i) == np.append(p, 1)).all() for i, p in enumerate(parts))
        assert all(shard.id_at(i) == whole[i] for i in range(0, len(whole), 17))


def test_grammar_is_exhausted():
    r = np.random.default_rng(3)
    for least in (2, 4, 7):
        ids = np.concatenate([np.append(r.integers(0, 5, 400), 6) for _ in range(6)]).astype(np.uint32)
        symbols, rules, sizes = tokenfile.repair(ids, 7, 6, least)
        count, last = Counter(), None
        for pair in zip(symbols.tolist(), symbols[1:].tolist()):
            overlaps = pair == last and pair[0] == pair[1]
            last = None if overlaps else pair
            if not overlaps and 6 not in pair:
                count[pair] += 1
        assert len(rules) and max(count.values(), default=0) < least
        assert sizes.tolist() == [sum(1 if x < 7 else sizes[x - 7] for x in rule) for rule in rules.tolist()]


def test_token_file_is_smaller_than_its_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = tokenfile.write(docs, WORD).collect()
    n, size = sum(s.n_ids for s in shards), sum(len(s.blob) for s in shards)
    assert size < 1.5 * n  # 2 bytes are what plain 16-bit ids take


def test_batches_equal_the_library():
    import pyarrow as pa

    own, r = Encoder(WORD), random.Random(8)
    parts = ["a", "À", "ß", "×", "÷", "µ", "don't", "'", "'re", "'l", "re", "x'", "l", "s", "5", "É", " ", "\n", "<|endoftext|>", "½", "日本", "\x1c", "\x85", "é", "Σ", "İ", "😀", "$$", "ª", "the", ".", "\t"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(6000)] + [None, ""]
    for k in range(0, len(texts), 7):
        ids, starts = own.batch(pa.array(texts[k : k + 7], pa.string()))
        for i, t in enumerate(texts[k : k + 7]):
            assert ids[starts[i] : starts[i + 1]].tolist() == own.library.encode(t or "", add_special_tokens=False).ids


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-3, 4, 16).astype(float).tolist()) for i in range(160)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 16), (203, [1.0] * 4), (None, [1.0] * 16), (7, rows[7][1]), (204, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, topk.top_k(topk.whole_numbers(vectors), "vec_id % 20 = 0", 5).collect()))
    fine = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) in (4, 16) and None not in v and v[0] == v[0]]
    want = []
    for q, a in fine:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in fine if c != q and len(b) == len(a))[:5]
            want += [(q, k + 1, c, -v) for k, (v, c) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(topk.whole_numbers(vectors.limit(0)), "vec_id % 20 = 0").count() == 0


def test_fingerprints(docs, none):
    rows = {r.doc_id: r for r in fingerprint.with_edits(docs).collect()}
    ids = sorted(TEXTS)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, n = text(i), len(text(i)) // 4
        edited = t[: len(t) - n] + text(after)[:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[1].fingerprint == rows[4].fingerprint and rows[2].fingerprint == rows[3].fingerprint
    assert rows[10].near_edited > 0.4 > 0.1 > rows[10].near_next
    a, b = fingerprint.sketch([TEXTS[10].encode(), ("shift " + TEXTS[10]).encode()])
    assert fingerprint.likeness(a[None], b[None])[0] > 0.9
    assert fingerprint.with_edits(none).count() == 0


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.88
    empty = spark.createDataFrame([(1, "")], "doc_id long, text string")
    model = quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.score(["", None, "x"]).tolist() == [0.5] * 3


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in keys) for x in a.keys() & b.keys())


def test_near_duplicates(spark, docs, none):
    r = random.Random(5)
    rows, base = dict(TEXTS), words(20, 200).split()
    for k in range(40):  # a chain: each differs from the one before in a few words
        base[r.randrange(200)] = f"new{k}"
        rows[100 + k] = " ".join(base)
    sets = {}
    for i, t in rows.items():
        w = (t or "").lower().split()
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    parent = {i: i for i in rows}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in rows:
        for b in rows:
            if a < b and sets[a].keys() & sets[b].keys() and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    table = spark.createDataFrame([*rows.items(), (None, "x y"), (1, rows[1])], "doc_id long, text string")
    got = near.classes(table).collect()
    assert len(got) == len(rows) + 2
    assert all(g.class_id == (None if g.doc_id is None else root(g.doc_id)) for g in got)
    assert near.classes(none).count() == 0


def test_probability_jaccard():
    r = random.Random(2)
    pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[x] for x in sorted(d)]))
    for _ in range(100):
        a, b = (Counter({r.randint(0, 30): r.choice([1, 1, 4]) for _ in range(r.randint(1, 30))}) for _ in "ab")
        assert abs(near.probability_jaccard(pack(a), pack(b)) - jaccard(a, b)) < 1e-9


def brute_repeats(texts, n=50):
    first, out = {}, {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        for k in range(len(t) - n + 1):
            first.setdefault(t[k : k + n], i)
    for i in texts:
        t = (texts[i] or "").encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if first[t[k : k + n]] < i:
                gone[k : k + n] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out[i] = len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()
    return out


def test_repeats(spark, docs, none):
    want = brute_repeats(TEXTS)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.remove(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 2000
    kept = {r.doc_id: r for r in repeats.remove(docs, keep=("lang", "source")).collect()}
    assert kept[8].lang == "en" and kept[8].source == "s0" and kept[4].kept == ""
    assert repeats.remove(none).count() == 0


def test_language(spark, none):
    d = "/root/testdata/sf0.01"
    rows = language.op10_language(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/pages.parquet").count() and sum(r.language == r.declared for r in rows) / len(rows) > 0.95
    pages = spark.createDataFrame([(1, None, None), (2, "bad", ""), (2, "bad", "")], "page_id long, url string, html string")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [r.accepted for r in language.identify_pages(pages, docs).collect()] == [False] * 3
    assert language.identify_pages(pages, none).count() == 3
    assert language.identify_documents(none).count() == 0


def test_licences(spark, none):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.txt", "text"), ("a/b/LICENSE", "text\nLicensed under the Apache License, Version 2.0.\n"), ("a/y.txt", None), ("z.txt", "a license"),
        ("a/own.txt", "// Licensed under CC BY-NC 4.0."), (None, "x"), ("a/y.txt", ""),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {(r.path, r.licence, r.inherited_from) for r in licences.inherit(licences.own_licences(files)).collect()}
    assert got == {("a/LICENSE", "MIT", None), ("a/b/c/x.txt", "Apache-2.0", "a/b"), ("a/b/LICENSE", "Apache-2.0", None), ("a/y.txt", "MIT", "a"), ("z.txt", None, None), ("a/own.txt", "CC-BY-NC-4.0", None), (None, None, None)}
    assert licences.inherit(licences.own_licences(files.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.table(stage(spark, kept, d), name)
        assert kept.columns == corpus_pipeline.COLUMNS and kept.count() <= before.count()
        if name == "repeats":
            want = brute_repeats({r.doc_id: r.text for r in before.collect()})
            assert {r.doc_id: len((r.text or "").encode()) for r in kept.collect()}.keys() == want.keys()
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}
