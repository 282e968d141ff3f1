"""Phrases of two to four words that stand together, found by hash counting (PCY, DHP) and Apriori pruning.

Words are counted in the first pass, and every later one counts phrases that are a word longer. While a pass counts phrases of k words
exactly, it counts those of k + 1 in hash buckets, and only where both their own parts of k words may still be frequent. A phrase is counted exactly only if its
bucket holds `least` and both its parts of one word less are frequent. Both facts reach the tasks as bitmaps of a fixed size,
whatever the corpus holds: one of the buckets with `least`, one of the hashes of the frequent phrases of the pass before. A shared bucket or hash only lets more
through; counts are of the phrases themselves, so results do not depend on the hash.

A task counts its buckets in one array, with one byte each, as no more than `least` <= 255 matters, and gives it out in blocks that are
compressed, so that a task gives out no more than a few bits for each phrase that it has seen, however many buckets there are; blocks meet in two
steps, so no group gets more than a share of the tasks' blocks. A pass's counts are deleted when they are summed up. Exact counts are gathered by batch and once more before they are dealt out.

Every language is counted by itself; a missing language is `und`. Null texts are empty. Repeated documents count as often as they are
there; ties of scores go by count and by the bytes of the phrase. Other columns are not read. Arithmetic is that of decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.operators.stats import per_group_cap
from mergelens.storage import release

from .common import U64, Memo, mapped, mix, read, slices, table
from .words import cut, kinds

#: Fixed values of the words: blank and tab between them, and what ends a piece.
KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
LONGEST = 4
#: Fixed values of the result: the score's factor, the share that a longer phrase has of one that is dropped for it, the ranks.
SCALE, SHARE, RANKS = 2_000_000, 80, 2000
#: Bytes of text for each bucket, and the least and the most buckets (a bitmap of 16 MB).
TEXT_A_BUCKET, BUCKETS = 64, (1 << 18, 1 << 27)
PART = 1 << 14
SLOTS = 256


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """A power of two that follows the length of all texts, within fixed bounds."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    return min(BUCKETS[1], max(BUCKETS[0], 1 << int(size // TEXT_A_BUCKET).bit_length()))


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mix(hashes * U64(0x9E3779B97F4A7C15) + words)


class Batch:
    """The words of texts, as numbers within the batch, and for each place of a word the hashes of the phrases that begin there."""

    def __init__(self, langs: pa.Array, texts: pa.Array, memo: Memo):
        words, starts, pieces = cut(texts, KINDS)
        coded, named = words.dictionary_encode(), pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.words, self.langs = coded.dictionary, named.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = np.repeat(named.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(starts))
        self.piece, n = pieces, len(self.code)
        own = np.fromiter(map(memo.__getitem__, self.words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(self.words))
        of = np.array([_hash(x) for x in self.langs.to_pylist()], np.uint64)
        self.hash = own[self.code] if n else np.zeros(0, np.uint64)
        self.seed = of[self.lang] if n else np.zeros(0, np.uint64)

    def phrases(self, k: int) -> np.ndarray:
        """Hashes of the phrases of k words, with their language; of a place whose piece ends before, whatever."""
        n = len(self.code) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = longer(self.seed[:n], self.hash[:n])
        for i in range(1, k):
            found = longer(found, self.hash[i : i + n])
        return found

    def within(self, k: int) -> np.ndarray:
        n = len(self.code) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and count of the distinct phrases of k words at these places, told apart by their words."""
        key, size = self.lang[at], len(self.words)
        for i in range(k):
            _, key = np.unique(key * size + self.code[at + i], return_inverse=True) if i < k - 1 else (None, key * size + self.code[at + i])
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        parts = [self.words.take(pa.array(self.code[at + i])) for i in range(k)]
        return self.langs.take(pa.array(self.lang[at])), pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0], times


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & U64(len(bitmap) * 8 - 1)
    return (bitmap[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) == 1


def add(counts: np.ndarray, hashes: np.ndarray, most: int) -> None:
    at, times = np.unique(hashes & U64(len(counts) - 1), return_counts=True)
    counts[at] = np.minimum(counts[at] + times, most)


def given(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The blocks of an array that hold something."""
    for i in range(0, len(counts), PART):
        block = counts[i : i + PART]
        if block.any():
            yield i // PART, pack(block)


def pack(block: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(block.astype(np.uint8).tobytes())


def unpack(block: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)


COUNTED = "lang string, phrase string, a long, part int, slot int, buckets binary"
_OUT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("part", pa.int32()), ("slot", pa.int32()), ("buckets", pa.binary())])


def _pass(docs: DataFrame, k: int, buckets: int, least: int, heavy=None, frequent=None) -> DataFrame:
    """Exact counts of a task's batches, phrases of k words, and blocks of its bucket counts of k + 1 words. heavy: the bitmap of buckets of k words;
    frequent: that of frequent phrases of k - 1 words."""

    def run(batches):
        from pyspark import TaskContext

        memo, counts, slot = Memo(_hash, 200_000), np.zeros(buckets if k < LONGEST else 0, np.uint16), TaskContext.get().partitionId() % SLOTS
        for batch in slices(batches, 1, 16 << 20):
            x = Batch(batch.column(0), batch.column(1), memo)
            keep, hashes = x.within(k), x.phrases(k)
            if k > 1:
                known = holds(frequent.value, x.phrases(k - 1))
                keep &= known[:-1] & known[1:] if len(hashes) else False
                keep &= holds(heavy.value, hashes)
            if k < LONGEST and len(keep) > 1:
                add(counts, x.phrases(k + 1)[x.within(k + 1) & keep[:-1] & keep[1:]], least)
            at = np.flatnonzero(keep)
            if len(at):
                lang, phrase, times = x.counted(at, k)
                none = pa.nulls(len(times), pa.int32())
                yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(times, pa.int64()), none, none, pa.nulls(len(times), pa.binary())], schema=_OUT)
        for part, block in given(counts):
            yield pa.RecordBatch.from_pylist([{"part": part, "slot": slot, "buckets": block}], schema=_OUT)

    return docs.transform(mapped, run, COUNTED)


def _bitmap(blocks: DataFrame, buckets: int, least: int) -> np.ndarray:
    """A bit for each bucket whose counts in all blocks reach least. What comes to the driver is the bitmap itself, of a fixed size."""

    def joined(whole: bool):
        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(PART, np.uint16)
            for batch in batches:
                for block in batch.column("buckets"):
                    total = np.minimum(total + unpack(block.as_py()), least)
            out = np.packbits(total >= least, bitorder="little").tobytes() if whole else pack(total)
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out], pa.binary())], names=["part", "buckets"])

        return run

    once = blocks.groupBy("part", "slot").applyInArrow(joined(False), "part int, buckets binary")
    twice = once.groupBy("part").applyInArrow(joined(True), "part int, buckets binary")
    bits = np.zeros(buckets // 8, np.uint8)
    for part, block in twice.collect():
        bits[part * PART // 8 : (part + 1) * PART // 8] = np.frombuffer(block, np.uint8)
    return bits


def _hashed(phrases: DataFrame, buckets: int, least: int) -> DataFrame:
    """Blocks that hold `least` at the hash of each of these phrases."""

    def run(batches):
        from pyspark import TaskContext

        counts, memo = np.zeros(buckets, np.uint8), Memo(_hash, 200_000)
        for batch in batches:
            hashes = []
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.array([_hash(lang)], np.uint64)
                for word in phrase.split(" "):
                    h = longer(h, np.array([memo[word]], np.uint64))
                hashes.append(h)
            if hashes:
                counts[np.concatenate(hashes) & U64(buckets - 1)] = least
        for part, block in given(counts):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([block], pa.binary())], names=["part", "slot", "buckets"])

    return phrases.select("lang", "phrase").mapInArrow(run, "part int, slot int, buckets binary")


def frequent_phrases(docs: DataFrame, least: int = 30, lang: str = "lang", text: str = "text", buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of all phrases of one to four words that are there `least` times, and (lang, n), the words of each language."""
    if not 0 < least < 256:
        raise ValueError("least must be from 1 to 255")
    spark, rows = docs.sparkSession, docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    buckets = buckets or buckets_for(rows)
    found, words, heavy, known = [], None, None, None
    for k in range(1, LONGEST + 1):
        counted = table(_pass(rows, k, buckets, least, heavy, known), f"pass{k}")
        exact = counted.where("part is null").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        if k == 1:
            words = table(counted.where("part is null").groupBy("lang").agg(F.sum("a").alias("n")), "words")
        found.append(table(exact.where(F.col("a") >= least).select("lang", F.lit(k).alias("k"), "phrase", "a"), f"phrases{k}"))
        if k < LONGEST:
            heavy = spark.sparkContext.broadcast(_bitmap(counted.where("part is not null").select("part", "slot", "buckets"), buckets, least))
            known = spark.sparkContext.broadcast(_bitmap(_hashed(found[-1], buckets, least), buckets, least))
        release(counted)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every, words


def collocations(docs: DataFrame, least: int = 30, ranks: int = RANKS, lang: str = "lang", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Of each language its first phrases by the score of their lowest cut: lang, rank, phrase, a, l, r, n, score."""
    every, words = frequent_phrases(docs, least, lang, text, buckets)
    parts = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(parts, F.lit(1), i), " ").alias("first"), F.array_join(F.slice(parts, i + 1, F.col("k")), " ").alias("rest")))
    cut_ = every.where("k > 1").select("lang", "k", "phrase", "a", F.inline(cuts))
    left, right = (every.select(F.col("lang"), F.col("phrase").alias(c), F.col("a").alias(n)) for c, n in (("first", "l"), ("rest", "r")))
    big = F.col("a").cast("decimal(20,0)")
    held = cut_.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(f"({SCALE} * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    least_cut = held.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    long = every.where("k > 2")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(parts, at, size), " "))))
    around = long.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    keep = F.col("around").isNull() | (100 * F.col("around").cast("decimal(20,0)") < SHARE * big)
    left_ = least_cut.join(around, ["lang", "phrase"], "left").where(keep)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = per_group_cap(left_, "lang", ranks, *order)
    ranked = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("b"), "phrase", "a", "l", "r", "score"))).alias("x"))
    flat = ranked.select("lang", F.posexplode("x").alias("i", "x")).join(words, "lang")
    return flat.select("lang", (F.col("i") + 1).cast("long").alias("rank"), "x.phrase", "x.a", "x.l", "x.r", "n", F.col("x.score").cast("long").alias("score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def _grams(k: int) -> str:
    side = "".join(f", w[i + {j}]" for j in range(1, k))
    return f"SELECT lang, {k} AS k, concat_ws(' ', w[i]{side}) AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p)"


ORACLE = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS ({' UNION ALL '.join(map(_grams, range(1, 5)))}),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
t AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT t.lang, t.phrase, t.a, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * t.a) // (l.a + r.a) AS score FROM t JOIN f l ON l.lang = t.lang AND l.phrase = x JOIN f r ON r.lang = t.lang AND r.phrase = y),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS around FROM (SELECT *, unnest(range(1, k - z + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS z FROM c)) GROUP BY ALL),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN b ON b.lang = m.lang AND b.phrase = m.phrase WHERE around IS NULL OR 100 * around < 80 * a)
SELECT o.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000"""
