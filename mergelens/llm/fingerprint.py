"""Document fingerprints by locally consistent parsing.

A text's bytes are symbols of level 0. At each level, runs of one symbol become one symbol; deterministic coin tossing then
labels each symbol with the lowest bit in which it differs from its predecessor, twice, until labels are tiny; a
symbol whose label is a strict local maximum begins a phrase, as does one that no boundary preceded within eight symbols.
A phrase's name is a hash of its symbols, and the names are the next level's symbols. A boundary depends on a few neighbours only,
so equal substrings are parsed alike, and share names, but near their ends, whatever their offset.

The fingerprint keeps, for phrases of levels 2, 3 and 4 (some 10 to 150 bytes long), a one-permutation MinHash sketch each: 64, 48 and 16
bins with the smallest name in the bin (empty bins take the next full one's), 8 bits of it in hex, so 256 digits.
Likeness is the share of bins that agree, less what chance gives; the empty text's fingerprint is all zeros, like itself only.

Documents stand in ascending doc_id (nulls first, ties by text, nulls first); the next of the last is the first. They are dealt to range buckets of
doc_id whose bounds come from quantiles; each bucket's first document is also sent to the bucket before it. Null
texts are empty. Repeated rows follow each other. A column named fingerprint is replaced; with_edits reads doc_id and text only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch_of, flat_bytes, mapped, mix, partitions, read, slices

BINS = (64, 48, 16)
REACH = 8


def coin(a: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the lowest bit that differs, plus that bit of the symbol; a and before differ."""
    differ = a ^ before
    low = differ & (~differ + type(a.flat[0])(1)) if a.size else differ
    at = np.round(np.log2(low.astype(np.float64))).astype(a.dtype) if a.size else low
    return (at << 1) | ((a & low) != 0)


#: Level 0 tosses coins of bytes; all pairs fit in a table.
_A, _B = np.meshgrid(np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint16))
_SAFE = np.where(_A == _B, _A ^ 1, _B)
BYTE_COIN = coin(_A.ravel(), _SAFE.ravel()).astype(np.uint8)  # at 256 * before + symbol
_S, _T = np.meshgrid(np.arange(128, dtype=np.uint16), np.arange(128, dtype=np.uint16))
SMALL_COIN = coin(_S.ravel(), np.where(_S == _T, _S ^ 1, _T).ravel()).astype(np.uint8)  # at 128 * before + symbol


def phrases(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin. first marks the first symbol of each text; neighbours within a text differ."""
    n = len(symbols)
    before = np.empty_like(symbols)
    before[1:], before[0] = symbols[:-1], 0
    if symbols.dtype == np.uint8:
        label = BYTE_COIN[(before.astype(np.int32) << 8) | symbols]
    else:
        differ = symbols ^ before
        low = differ & (~differ + U64(1))
        exponent = (low.astype(np.float64).view(np.uint64) >> U64(52)).astype(np.int32) - 1023
        label = ((np.maximum(exponent, 0) << 1) | ((symbols & low) != 0)).astype(np.uint8) & np.uint8(127)
    label[first] = 0
    prior = np.empty_like(label)
    prior[1:], prior[0] = label[:-1], 0
    label = SMALL_COIN[(prior.astype(np.int32) << 7) | label] + np.uint8(1)
    label[first] = 0
    after = np.append(label[1:], np.uint8(0))  # the end of the last text is like that of any other
    cut = np.zeros(n, bool)
    cut[1:] = (label[1:] > label[:-1]) & (label[1:] >= after[1:])
    cut[1:] &= ~cut[:-1]
    cut |= first
    places = np.flatnonzero(cut)
    gap = np.diff(np.append(places, n))
    if len(gap) and gap.max() > REACH:  # long stretches without a maximum are cut from their left end
        long = np.flatnonzero(gap > REACH)
        cut[np.concatenate([np.arange(places[i] + REACH, places[i] + gap[i], REACH) for i in long])] = True
        places = np.flatnonzero(cut)
    return places


def collapse(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one symbol within a text: their symbols, lengths, which are a text's first, and each text's first run."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[starts[starts < len(symbols)]] = True
    places = np.flatnonzero(new)
    lengths = np.diff(np.append(places, len(symbols)))
    to = np.searchsorted(places, starts)
    first = np.zeros(len(places), bool)
    first[to[to < len(places)]] = True
    return symbols[places], lengths, first, to


def sketch(texts: list[bytes]) -> np.ndarray:
    """One row of 128 bytes for each text."""
    out = np.zeros((len(texts), sum(BINS)), np.uint8)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    symbols, starts = flat_bytes([texts[i] for i in full])
    starts = starts[:-1]
    column = 0
    for level in range(1, 5):
        symbols, lengths, first, starts = collapse(symbols, starts)
        places = phrases(symbols, first)
        # a phrase's name: its symbols and run lengths, mixed with their places in it
        value = mix(symbols.astype(U64) * U64(0x9E3779B97F4A7C15) + lengths.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(level))
        inside = np.arange(len(symbols)) - np.repeat(places, np.diff(np.append(places, len(symbols))))
        names = mix(np.add.reduceat(mix(value + inside.astype(U64) * U64(0xD6E8FEB86659FD93)), places))
        symbols, starts = names, np.searchsorted(places, starts)
        if level < 2:
            continue
        bins = BINS[level - 2]
        owner = np.repeat(np.arange(len(full)), np.diff(np.append(starts, len(names))))
        best = np.full(len(full) * bins, ~U64(0))
        np.minimum.at(best, owner * bins + (names % U64(bins)).astype(np.int64), names // U64(bins))
        best = best.reshape(len(full), bins)
        empty = best == ~U64(0)
        for _ in range(bins):  # every text has a name, so empty bins fill up
            if not empty.any():
                break
            best = np.where(empty, np.roll(best, -1, axis=1) * U64(0x9E3779B97F4A7C15) + U64(1), best)
            empty = empty & np.roll(empty, -1, axis=1)
        out[full, column : column + bins] = np.maximum(mix(best) >> U64(56), U64(1))
        column += bins
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of sketches: the share of equal bins, less chance, from 0 to 1."""
    same = (a == b).mean(axis=1)
    return np.clip((same - 1 / 255) / (1 - 1 / 255), 0, 1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with their fingerprint, each text on its own."""
    from .common import widen

    docs = docs.drop("fingerprint")
    at, schema = docs.columns.index(text), widen(docs, fingerprint="string")

    def run(batches):
        for batch in slices(batches, at):
            found = sketch([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes().hex() for r in found])], names=[*batch.schema.names, "fingerprint"])

    return docs.transform(mapped, run, schema)


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, guest: each bucket's rows, and as guest the first row after them; the last bucket's guest is the first row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = sorted(set(ids.where("doc_id is not null").stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 1 / (8 * buckets)))) if buckets > 1 else []
    bounds = [int(b) for b in bounds]
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))), F.lit(0))) if bounds else F.lit(0)
    rows = ids.withColumn("bucket", bucket.cast("int"))
    firsts = sorted((r["bucket"], r["low"] is not None if not r["holes"] else False, r["low"]) for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("holes")).collect())
    # one row for each bucket; the first document of a bucket goes to the bucket before, that of the first to the last
    to = {b: firsts[i - 1][0] for i, (b, _, _) in enumerate(firsts)}
    sent = F.lit(None).cast("int")
    for b, known, low in firsts:
        sent = F.when((F.col("bucket") == b) & (F.col("doc_id").eqNullSafe(F.lit(low if known else None).cast("long"))), F.lit(to[b])).otherwise(sent) if len(firsts) <= 1 else sent
    if len(firsts) > 1:
        pairs = F.create_map(*[F.lit(x) for b, _, _ in firsts for x in (b, to[b])])
        lows = F.create_map(*[F.lit(x) for b, known, low in firsts if known for x in (b, low)]) if any(f[1] for f in firsts) else None
        nulls = F.array(*[F.lit(b) for b, known, _ in firsts if not known])
        is_low = (F.col("doc_id") == lows[F.col("bucket")]) if lows is not None else F.lit(False)
        is_first = F.coalesce(F.when(F.array_contains(nulls, F.col("bucket")), F.col("doc_id").isNull()).otherwise(is_low), F.lit(False)) if any(not f[1] for f in firsts) else F.coalesce(is_low, F.lit(False))
        sent = F.when(is_first, pairs[F.col("bucket")])
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    both = F.when(sent.isNotNull(), F.array(own, F.struct(sent.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(both).alias("x")).select("doc_id", "text", "x.bucket", "x.guest")


def with_edits(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of each text, and of the text whose last 1/share is replaced by the beginning of the next document."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = in_order(docs, n).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def done(ids, texts, after):
        """Rows of texts; after: the text that follows the last."""
        followers = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // share] + f[: len(t) // share] for t, f in zip(texts, followers, strict=True)]
        raw = [t.encode() for t in edited]
        own, other = sketch([t.encode() for t in [*texts, after]]), sketch(raw)
        return batch_of(
            out, ids, [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in raw], [r.tobytes().hex() for r in own[:-1]],
            [r.tobytes().hex() for r in other], likeness(own[:-1], other), likeness(own[:-1], own[1:]),
        )

    def run(batches):
        ids, texts, at, closed = [], [], None, False
        for batch in slices(batches, 1, 2 << 20):
            for doc, text, bucket, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if bucket != at:
                    at, closed = bucket, False
                if guest:
                    if texts and not closed:  # of equal first ids the first text is the neighbour
                        yield done(ids, texts, text)
                    ids, texts, closed = [], [], True
                    continue
                ids.append(doc)
                texts.append(text)
            if len(texts) > 1:
                yield done(ids[:-1], texts[:-1], texts[-1])
                ids, texts = ids[-1:], texts[-1:]

    return rows.transform(mapped, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_edits(read(spark, sf_dir, "documents"))
