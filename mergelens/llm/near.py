"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

A text's lower-cased words give shingles of five (a shorter text is one shingle), weighted by their counts. Each shingle is a
Poisson process of the rate of its weight; an arrival falls into one of 64 registers, which keeps its earliest shingle, and a
shingle stops once its next arrival is later than all registers. Two texts agree in a register with their
probability Jaccard. 16 bands of 4 registers meet at similarity 0.8 with probability 0.9998.

Links are found without all pairs of a bucket:

1. equal texts are one class from the start, and only their smallest doc_id goes on;
2. every member of a bucket is compared with the bucket's smallest, first in the first bands, then in the others where the two are not
   yet in one component;
3. where a bucket's members are still in different components, all outside its most frequent component are compared with all members of
   the buckets that have the same, in blocks: members are dealt to blocks of some 256, the others are sent to each block, and only
   links leave it.

Pairs are verified by their exact probability Jaccard (0.8 or more). Components come from minimum labels
with pointer jumping. Everything that a later step reads again is a table in the shared folder.

Result: one row per row of docs: doc_id, copy_of (smallest doc_id with the same words), class_id (smallest doc_id of its component).
Texts without words, null ones included, are linked to nothing; rows without a doc_id have null classes and are linked to nothing. Rows
that repeat a doc_id get the same class. Columns beside doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Memo, batch_of, kept, mapped, mix, read, slices, table

WIDTH, REGISTERS, ROWS = 5, 64, 4
BANDS = REGISTERS // ROWS
MASK = U64((1 << 44) - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


def word_hashes() -> Memo:
    return kept("word hashes", lambda: Memo(lambda w: xxhash.xxh3_64_digest(w.encode()), 500_000))


def elements(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each list of words: its place, 44 bits of the shingle's hash, its count; ordered so."""
    memo, pad = word_hashes(), b"\0" * 8
    data, counts = [], []
    for words in texts:
        if words:
            data.append(b"".join(map(memo.__getitem__, words)) + pad * (WIDTH - len(words)))
        counts.append(max(len(words), WIDTH) if words else 0)
    h = np.frombuffer(b"".join(data), "<u8")
    n = len(h) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    s = np.zeros(n, U64)
    for i in range(WIDTH):
        s += mix(h[i : i + n] * ODD[i])
    owner = np.repeat(np.arange(len(texts)), counts)
    within = owner[:n] == owner[WIDTH - 1 :]
    assert len(texts) < 1 << 20
    key = np.sort((owner[:n][within].astype(U64) << U64(44)) | (mix(s[within]) & MASK))
    new = np.append(True, key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return (key[at] >> U64(44)).astype(np.int64), key[at] & MASK, np.diff(np.append(at, len(key)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The shingle that each register keeps, one row for each of n texts; texts without shingles have zeros."""
    first, ident = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, U64)
    d, e, w, x, j = owner, shingle, 1.0 / weight, np.zeros(len(owner)), 0
    while len(d):
        j += 1
        r = mix(mix(e * ODD[0] + U64(j)) + ODD[1])
        x = x - np.log(((r >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) * w
        at = d * REGISTERS + (r & U64(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(first, at, x)
        won = x == first[at]
        ident[at[won]] = e[won]
        late = first.reshape(n, REGISTERS).max(axis=1)
        alive = x < late[d]
        d, e, w, x = d[alive], e[alive], w[alive], x[alive]
    return ident.reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of two weighted sets: sorted shingles and their counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    j = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = b[0][j] == a[0]
    n = int(i.sum())
    if not n:
        return 0.0
    if a[1].max() == 1 == b[1].max():
        return n / (len(a[0]) + len(b[0]) - n)
    ca, cb = a[1][i].astype(float), b[1][j[i]].astype(float)
    only_a, only_b = a[1].sum() - ca.sum(), b[1].sum() - cb.sum()
    # a shingle's term depends on its two weights by their ratio only, but for the factor of the first
    ratios, of = np.unique(ca / cb, return_inverse=True)
    total = np.bincount(of, ca)
    return float(sum(t / (only_a + r * only_b + np.maximum(ca, r * cb).sum()) for r, t in zip(ratios, total, strict=True)))


def shingled(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, shingle, count = elements([text.lower().split()])
    return shingle, count


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of the words, null without words), bands."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        number = np.arange(BANDS, dtype=U64) * ODD[3]
        for batch in slices(batches, 1):
            texts = [(t or "").lower().split() for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_hexdigest(" ".join(w).encode()) if w else None for w in texts]
            ident = signatures(*elements(texts), len(texts)).reshape(len(texts), BANDS, ROWS)
            band = mix((mix(ident) * ODD[:ROWS]).sum(axis=2, dtype=U64) + number).view(np.int64)
            yield batch_of(out, batch.column(0), keys, [b.tolist() if k else [] for b, k in zip(band, keys, strict=True)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "doc_id long, key string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        memo: dict[int, tuple] = {}
        for batch in slices(batches, 2):
            a, ta, b, tb = (batch.column(i).to_pylist() for i in (0, 2, 1, 3))
            found = []
            for i, x, y in zip(a, ta, tb, strict=True):
                if i not in memo:
                    if len(memo) > 32:
                        memo.clear()
                    memo[i] = shingled(x)
                found.append(probability_jaccard(memo[i], shingled(y)))
            yield batch_of(out, a, b, found)

    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return both.transform(mapped, run, "a long, b long, similarity double")


def components(links: DataFrame, files: int, start: DataFrame | None = None) -> DataFrame:
    """doc, label of every document in links (a, b): the smallest in its component. start: labels from some of the links. Its tables hold a
    few numbers for each link and are written as so many files."""
    both = table(links.select("a", "b").union(links.select("b", "a")).distinct().coalesce(files), "edges")
    first = both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m"))
    if start is None:
        first = first.select("doc", F.least("doc", "m").alias("label"))
    else:
        first = first.join(start.select("doc", F.col("label").alias("s")), "doc", "left").select("doc", F.least("doc", "m", "s").alias("label"))
    labels = table(first.coalesce(files), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "doc").select("doc", F.least("label", "m").alias("next"), F.col("label").alias("old"))
        jump = labels.select(F.col("doc").alias("next"), F.col("label").alias("far"))
        new = table(lower.join(jump, "next", "left").select("doc", F.least("next", F.coalesce("far", "next")).alias("label"), "old").coalesce(files), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("doc", "label")
        labels = new.select("doc", "label")


BLOCK = 256


def in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: block (hash), order (0 members, 1 others), doc, label, text. Links (a, b, similarity) between members and others of a block with different labels."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    class Block:
        def __init__(self):
            self.docs, self.labels, self.sets, self.ready = [], [], [], False

        def close(self):
            self.doc, self.label = np.array(self.docs, np.int64), np.array(self.labels, np.int64)
            self.size = np.array([len(x[0]) for x in self.sets])
            self.plain = np.array([not len(x[1]) or x[1].max() == 1 for x in self.sets])
            all_of = np.concatenate([x[0] for x in self.sets]) if self.sets else np.zeros(0, U64)
            order = np.argsort(all_of)
            self.all, self.owner, self.ready = all_of[order], np.repeat(np.arange(len(self.sets)), self.size)[order], True
            self.part = np.concatenate([x[1] / max(1, x[1].sum()) for x in self.sets])[order] if self.sets else np.zeros(0)

        def links(self, doc, label, own):
            lo, hi = np.searchsorted(self.all, own[0], "left"), np.searchsorted(self.all, own[0], "right")
            n = hi - lo
            at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            common = np.bincount(self.owner[at], minlength=len(self.doc))
            other = (self.label != label) & (common > 0)
            plain = self.plain & (own[1].max(initial=1) == 1)
            similar = common / (self.size + len(own[0]) - common)
            for i in np.flatnonzero(other & plain & (similar >= threshold)):
                yield doc, int(self.doc[i]), float(similar[i])
            if (other & ~plain).any():  # the sum of the smaller of the two normalised weights is no less than the similarity
                smaller = np.minimum(self.part[at], np.repeat(own[1] / own[1].sum(), n))
                other &= np.bincount(self.owner[at], smaller, minlength=len(self.doc)) >= threshold - 1e-9
            for i in np.flatnonzero(other & ~plain):
                value = probability_jaccard(own, self.sets[i])
                if value >= threshold:
                    yield doc, int(self.doc[i]), value

    def run(batches):
        at, block = None, None
        for batch in slices(batches, 4):
            found = []
            for key, order, doc, label, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    at, block = key, Block()
                if not order:
                    block.docs.append(doc)
                    block.labels.append(label)
                    block.sets.append(shingled(words))
                    continue
                if not block.ready:
                    block.close()
                found += block.links(doc, label, shingled(words))
            if found:
                yield batch_of(out, *map(list, zip(*found, strict=True)))

    return rows.transform(mapped, run, "a long, b long, similarity double")


def classes(docs: DataFrame, threshold: float = 0.8, first_bands: int = 4) -> DataFrame:
    signed = table(sketch(docs), "signed", narrow=True)
    known = signed.where("key is not null and doc_id is not null")
    reps = known.groupBy("key").agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands"))
    rows = reps.select("doc", F.posexplode("bands").alias("band", "bucket"))
    hubs = rows.groupBy("band", "bucket").agg(F.min("doc").alias("hub"), F.max("doc").alias("last")).where("hub < last").select("band", "bucket", "hub")
    members = table(rows.join(hubs, ["band", "bucket"]).where("doc <> hub"), "members")  # the hub itself is in its column
    wanted = members.select("doc").union(members.select(F.col("hub").alias("doc"))).distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    texts = table(source.join(wanted, "doc", "left_semi"), "texts")
    pairs = lambda m: m.select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    done = table(verified(pairs(members.where(F.col("band") < first_bands)), texts), "verified")
    files = 1 + done.count() // 500_000
    linked = lambda x: x.where(F.col("similarity") >= threshold).select("a", "b")
    labels = components(linked(done), files)
    lx, ly = labels.select(F.col("doc").alias("a"), F.col("label").alias("_a")), labels.select(F.col("doc").alias("b"), F.col("label").alias("_b"))
    rest = pairs(members.where(F.col("band") >= first_bands)).join(done.select("a", "b"), ["a", "b"], "left_anti")
    rest = rest.join(lx, "a", "left").join(ly, "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    links = table(linked(done).unionByName(linked(verified(rest, texts))), "links")
    labels = components(links, files, labels)
    # buckets whose members lie in different components: these were held against the hub only
    here = members.select("band", "bucket", "doc").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    counts = here.groupBy("band", "bucket", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    # buckets with one main component are one group, so that a pair which meets in several bands is compared once
    group = table(here.join(mixed, ["band", "bucket"]).select("main", "doc", "label").distinct(), "mixed")
    if not group.isEmpty():
        sizes = group.groupBy("main").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        here = group.join(sizes, "main")
        own = here.select(F.xxhash64("main", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).alias("block"), F.lit(0).alias("order"), "doc", "label")
        sent = here.where("label <> main").select("main", "doc", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
        both = own.unionByName(sent.select(F.xxhash64("main", "k").alias("block"), F.lit(1).alias("order"), "doc", "label"))
        rows = both.join(texts.dropDuplicates(["doc"]), "doc").select("block", "order", "doc", "label", "text")
        more = table(in_blocks(rows.repartition("block").sortWithinPartitions("block", "order"), threshold), "more")
        if not more.isEmpty():
            labels = components(links.unionByName(more.select("a", "b")), files + more.count() // 500_000, labels)
    copies = reps.select("key", F.col("doc").alias("copy_of"))
    found = signed.select("doc_id", "key").join(copies, "key", "left").withColumn("copy_of", F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")))
    return found.join(labels.select(F.col("doc").alias("copy_of"), "label"), "copy_of", "left").select("doc_id", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
