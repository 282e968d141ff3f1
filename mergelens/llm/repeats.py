"""Removal of repeated passages by longest-previous-factor arrays over suffix order, distributed.

A byte goes if a `length`-byte string that covers it also starts in a document with a smaller doc_id. All windows of that length with
the same smallest hash among their 24-grams belong together, and equal windows have equal smallest hashes; runs of neighbouring windows
with one such hash make a segment, so segments cover every window once and are some 63 bytes long.

1. Each task sends for every segment its smallest hash's bucket, that hash, a 64-bit hash of all its windows, and the document; of equal
   segments within a block of documents only the first, since the others are then known to be later copies. So a passage
   that a third of all documents share reaches its bucket once per block.
2. A bucket tells for equal segments which documents are later. Where segments that differ share a smallest hash, the first
   document of each is to send its bytes, for some windows in them may still be equal.
3. Documents meet their findings by shards of doc_id. Those with nothing open are finished.
4. The open segments' bytes come sorted by smallest hash and are taken in chunks of some `CHUNK` bytes that end where the hash changes; each
   is one text, in document order. Its suffixes are sorted to their ends (prefix doubling from 8-byte words, ties in text order), and each one's longest
   previous factor is the longer of its common prefixes with the previous and the next smaller document's suffix in that order (see
   previous_factors). A window repeats if its factor is no shorter than it.
5. A smallest hash whose open segments exceed `WIDE` bytes (a passage that goes on in very many ways) does not fit a chunk: its suffixes, cut
   after `length` bytes, are ordered by a shuffle, and equal ones meet the smallest document among them, which is their previous smaller one.
6. The open documents get the rest of their ranges and are finished.

Buckets and shards are `FINE` times as many as shuffle partitions and are worked on one at a time, so memory is a fraction of a partition.

Two segments are held equal if they share their bucket, 32 bits of the smallest hash and the 64-bit hash: of n different segments some two are
mistaken with a probability of about n^2 / 2^97 (a bucket's number tells a bit or more). What a bucket finds is looked up by the document and the
64-bit hash, both compared, so another segment is hit only if it has the hash of one of the same document. What shares a smallest hash but is not
equal so is compared byte by byte. Null and empty texts, and texts shorter than `length`, keep all. Rows without a doc_id
neither lose bytes nor make others lose any. Rows that repeat a doc_id are one document: none removes from the other. Extra columns are
left out, but for those named in `keep`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch_of, flat_bytes, mapped, mix, partitions, read, slices, table

GRAM = 24
HOLD = 500_000
FINE = 4
CHUNK, WIDE = 1 << 17, 2 << 20  # a chunk's arrays stay in a core's cache; which hashes are wide is another matter
WORDS_PER_SLICE = 1 << 18
ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words(flat: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros after the end."""
    padded = np.zeros(len(flat) + 16, np.uint8)
    padded[: len(flat)] = flat
    out = np.empty(len(flat) + 8, U64)
    for o in range(8):
        part = padded[o : o + (len(padded) - o) // 8 * 8].view(">u8" if big else "<u8")
        target = out[o::8]
        target[:] = part[: len(target)]
    return out[: len(flat)]


def segments(flat: np.ndarray, starts: np.ndarray, length: int):
    """Owner, first window, number of windows, smallest hash and hash of all segments; places are in flat."""
    n = len(flat)
    size = np.diff(starts)
    full = np.flatnonzero(size >= length)
    if not len(full):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    w = words(flat)
    h = w[: n - 16] * ODD[0]
    h ^= h >> U64(29)
    h += w[8 : n - 8] * ODD[1]
    h ^= h >> U64(32)
    h *= U64(0xBF58476D1CE4E5B9)
    h += w[16:] * ODD[2]
    del w
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    span, low, have = length - GRAM + 1, h, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    change = np.zeros(n + 1, np.int32)
    change[starts[full]] += 1
    change[starts[full] + size[full] - length + 1] -= 1
    valid = np.cumsum(change[:n], dtype=np.int8) > 0
    new = valid.copy()
    m = min(len(low), n)
    new[1:m] &= low[1:m] != low[: m - 1]
    new[starts[full]] = True
    first = np.flatnonzero(new)
    owner = np.searchsorted(starts, first, side="right") - 1
    last = starts[owner] + size[owner] - length  # the document's last window
    count = np.minimum(np.append(first[1:], n), last + 1) - first
    # a window's hash mixes grams that cover it, a segment's the hashes of its windows by their places
    places = np.flatnonzero(valid)
    window = np.zeros(len(places), U64)
    for k, o in enumerate([*range(0, length - GRAM, GRAM), length - GRAM]):
        window += h[places + o] * (ODD[3] + U64(2 * k))
    power = np.full(int(count.max()), ODD[1], U64)
    power[0] = 1
    np.cumprod(power, out=power)
    at = np.cumsum(count) - count
    whole = mix(np.add.reduceat(mix(window) * power[places - np.repeat(first, count)], at) + count.astype(U64) * ODD[3])
    return owner, first, count, mix(low[first]), whole


def pack_docs(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending ids as distinct ids and their counts."""
    ids, counts = np.unique(docs, return_counts=True)
    return ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes()


def unpack_docs(ids: bytes, counts: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4"))


SENT = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("whole", pa.binary())])
FOUND = pa.schema([("shard", pa.int32()), ("first", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("whole", pa.binary()), ("open", pa.binary())])


def send(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        held, n = [], 0

        def parcel(known, bucket, doc, low, whole):
            order = np.argsort(doc, kind="stable")
            return bucket, known, *pack_docs(doc[order]), b"" if known else low[order].astype("<u4").tobytes(), whole[order].astype("<u8").tobytes()

        def flush():
            nonlocal turn
            doc, low, whole = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, whole, low))
            doc, low, whole = doc[order], low[order], whole[order]
            same = np.append(False, (low[1:] == low[:-1]) & (whole[1:] == whole[:-1]))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            later = doc > doc[first]
            rows = []
            if later.any():
                turn += 1
                one = np.unique(np.rec.fromarrays([doc[later], whole[later]]))
                rows.append(parcel(True, turn % buckets, one.f0, None, one.f1))
            keep = ~same
            doc, low, whole = doc[keep], low[keep], whole[keep]
            bucket = (low % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if cuts[b] < cuts[b + 1]:
                    part = order[cuts[b] : cuts[b + 1]]
                    rows.append(parcel(False, b, doc[part], low[part] // U64(buckets), whole[part]))
            held.clear()
            return batch_of(SENT, *map(list, zip(*rows, strict=True)))

        for batch in slices(batches, 1, WORDS_PER_SLICE):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, starts = flat_bytes([(t or "").encode() for t in batch.column(1).to_pylist()])
            owner, _, _, low, whole = segments(flat, starts, length)
            if len(owner):
                held.append((ids[owner], low, whole))
                n += len(owner)
            if n >= HOLD:
                yield flush()
                n = 0
        if held:
            yield flush()

    known = docs.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    return known.transform(mapped, run, "bucket int, known boolean, docs binary, counts binary, low binary, whole binary")


def judge(sent: DataFrame, buckets: int, shards: int) -> DataFrame:
    """What each bucket finds, for the shards of the documents: later copies, and segments that are open."""

    def verdicts(rows):
        known = [r for r in rows if r[1]]  # later copies already, for any bucket
        rest = [r for r in rows if not r[1]]
        for r in known:
            yield unpack_docs(r[2], r[3]), np.frombuffer(r[5], "<u8"), False
        if not rest:
            return
        doc = np.concatenate([unpack_docs(r[2], r[3]) for r in rest])
        low = np.concatenate([np.frombuffer(r[4], "<u4") for r in rest])
        whole = np.concatenate([np.frombuffer(r[5], "<u8") for r in rest])
        order = np.lexsort((doc, whole, low))
        doc, low, whole = doc[order], low[order], whole[order]
        new_low = np.append(True, low[1:] != low[:-1])
        new = new_low | np.append(True, whole[1:] != whole[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        later = doc > doc[first]
        if later.any():
            yield doc[later], whole[later], False
        group = np.cumsum(new_low) - 1
        kinds = np.bincount(group[new])
        ends = np.flatnonzero(np.append(new_low[1:], True))
        heads = np.flatnonzero(new_low)
        several = np.maximum.reduceat(doc, heads) > np.minimum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
        assert len(ends) == len(kinds)
        still = new & ((kinds > 1) & several)[group]
        if still.any():
            yield doc[still], whole[still], True

    def out(held):
        """Findings of several buckets, (docs, hashes, open or not), dealt to the shards."""
        made = []
        for is_open in (False, True):
            if not (mine := [h for h in held if h[2] == is_open]):
                continue
            doc, whole = (np.concatenate([h[i] for h in mine]) for i in (0, 1))
            shard = doc % shards
            order = np.lexsort((doc, shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[s] : cuts[s + 1]]
                made.append((s, 0, *pack_docs(doc[part]), whole[part].astype("<u8").tobytes(), b"\1" if is_open else b"\0"))
        return batch_of(FOUND, *map(list, zip(*made, strict=True)))

    def run(batches):
        at, rows, held = None, [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != at:
                    held += verdicts(rows)
                    rows = []
                    if sum(len(h[0]) for h in held) >= HOLD:
                        yield out(held)
                        held = []
                at = r[0]
                rows.append(r)
        held += verdicts(rows)
        if held:
            yield out(held)

    return sent.repartition(buckets // FINE, "bucket").sortWithinPartitions("bucket").transform(mapped, run, "shard int, first int, docs binary, counts binary, whole binary, open binary")


def finish(data: bytes, ranges: list[tuple[int, int]] | np.ndarray):
    """n_bytes, n_removed, n_spans and what is kept of a text without the ranges."""
    if not len(ranges):
        return len(data), 0, 0, data
    change = np.zeros(len(data) + 1, np.int32)
    r = np.asarray(ranges, np.int64)
    np.add.at(change, r[:, 0], 1)
    np.add.at(change, r[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int((gone & ~np.append(False, gone[:-1])).sum())
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return len(data), int(gone.sum()), spans, kept


DONE = "kind int, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, text string, ranges binary, place long, low long, extra string"
DONE_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("text", pa.string()), ("ranges", pa.binary()), ("place", pa.int64()), ("low", pa.int64()), ("extra", pa.string())])
FINISHED, OPEN, SEGMENT = 0, 1, 2


def finished(doc, data: bytes, ranges, keep_text: bool, extra: str | None = None):
    n, removed, spans, kept = finish(data, ranges)
    return FINISHED, doc, n, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None, None, None, None, None, extra


def looked_up(keys: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each (document, hash) stands among keys, which are in the order of their mixture, and whether it does: both are compared."""
    key, docs, wholes = keys
    mine = mix(whole + mix(doc.astype(U64)))
    where = np.searchsorted(key, mine)
    last = np.searchsorted(key, mine, side="right")
    found = np.zeros(len(mine), bool)
    while True:
        at = np.flatnonzero(~found & (where < last))
        if not len(at):
            return np.minimum(where, max(len(key) - 1, 0)), found
        found[at] = (docs[where[at]] == doc[at]) & (wholes[where[at]] == whole[at])
        where[at[~found[at]]] += 1


def apply_findings(rows: DataFrame, length: int, shards: int, keep_text: bool) -> DataFrame:
    """rows: shard, first, docs, counts, whole, open (0 first) or shard, 1, doc_id, text. Finished documents, open documents, open segments' bytes."""

    def run(batches):
        at, parts, keys, opens, flagged = None, [], None, None, None
        for batch in slices(batches, 7, WORDS_PER_SLICE):
            made = []
            cols = [c.to_pylist() for c in batch.columns]
            texts = []
            for shard, first, docs, counts, whole, is_open, doc, text, extra in zip(*cols, strict=True):
                if shard != at:
                    made += settle(texts, keys, opens, flagged)
                    texts, at, parts, keys = [], shard, [], None
                if not first:
                    parts.append((unpack_docs(docs, counts), np.frombuffer(whole, "<u8"), is_open == b"\1"))
                    continue
                if keys is None:
                    keys, opens, flagged = index(parts)
                texts.append((doc, text, extra))
            made += settle(texts, keys, opens, flagged)
            if made:
                yield batch_of(DONE_SCHEMA, *map(list, zip(*made, strict=True)))

    def index(parts):
        if not parts:
            return (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64)), np.zeros(0, bool), np.zeros(0, np.int64)
        docs, whole = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        opens = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
        key = mix(whole + mix(docs.astype(U64)))
        order = np.lexsort((opens, key))
        return (key[order], docs[order], whole[order]), opens[order], np.unique(docs)

    def settle(texts, keys, opens, flagged):
        if not texts:
            return []
        ids = np.array([-1 if d is None else d for d, *_ in texts], np.int64)
        hit = np.isin(ids, flagged) & np.array([d is not None for d, *_ in texts])
        made = [finished(d, (t or "").encode(), (), keep_text, x) for (d, t, x), h in zip(texts, hit, strict=True) if not h]
        some = [(d, (t or "").encode(), t, x) for (d, t, x), h in zip(texts, hit, strict=True) if h]
        if not some:
            return made
        flat, starts = flat_bytes([x[1] for x in some])
        owner, first, count, low, whole = segments(flat, starts, length)
        where, found = looked_up(keys, ids[hit][owner], whole)
        is_open = found & opens[where]
        low = low.view(np.int64)
        gone = found & ~is_open
        begin = first - starts[owner]
        end = begin + count - 1 + length
        for i, (doc, data, text, extra) in enumerate(some):
            lo, hi = np.searchsorted(owner, [i, i + 1])
            g = gone[lo:hi]
            ranges = np.c_[begin[lo:hi][g], end[lo:hi][g]]
            o = np.flatnonzero(is_open[lo:hi]) + lo
            if not len(o):
                made.append(finished(doc, data, ranges, keep_text, extra))
                continue
            made.append((OPEN, doc, None, None, None, None, None, text, ranges.astype("<i8").tobytes(), None, None, extra))
            for j in o.tolist():
                made.append((SEGMENT, doc, None, None, None, None, None, None, data[begin[j] : end[j]], int(begin[j]), int(low[j]), None))
        return made

    return rows.repartition(shards // FINE, "shard").sortWithinPartitions("shard", "first").transform(mapped, run, DONE)


def since(new: np.ndarray) -> np.ndarray:
    """Where the run of each place begins; new: whether a place differs from the one before, from the second on."""
    return np.maximum.accumulate(np.where(np.append(True, new), np.arange(len(new) + 1), 0))


def suffix_ranks(flat: np.ndarray, left: np.ndarray, least: int = 1) -> list[tuple[int, np.ndarray]]:
    """For 8, 16, 32, ... bytes the rank of each suffix by its first so many (how many are smaller); a suffix ends with its text, of which it has
    `left` bytes. Equal ranks are equal strings; only what a doubling can still tell apart is sorted again. The last ranks tell all suffixes apart but those that are equal to their ends; they are made only for
    suffixes of `least` bytes or more, -1 for others."""
    n, most = len(flat), int(left.max(initial=0))
    short = np.minimum(left, 8)
    word = words(flat, big=True)
    ends = np.flatnonzero(short < 8)
    word[ends] &= ~(U64(0xFFFFFFFFFFFFFFFF) >> (short[ends].astype(U64) * U64(8)))
    if n and not flat.min():  # a zero byte is not the end of a text
        order = np.lexsort((short, word))
        new = (word[order][1:] != word[order][:-1]) | (short[order][1:] != short[order][:-1])
    else:
        order = np.argsort(word)
        new = word[order][1:] != word[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = since(new)[:n]
    levels, have, at = [(8, rank)], 8, order
    while have < most:
        # what is alone in its rank, or equal to its end to all of its rank, has its place already
        heads = np.flatnonzero(np.append(True, rank[at][1:] != rank[at][:-1]))
        count = np.diff(np.append(heads, len(at)))
        at = at[np.repeat((count > 1) & (np.maximum.reduceat(left[at], heads) > have), count)]
        if not len(at):
            break
        last = rank.copy()
        if 2 * have >= most:
            last[left < least] = -1
            at = at[left[at] >= least]
        key = rank[at] * (n + 2)
        on = np.flatnonzero(left[at] > have)
        key[on] += rank[at[on] + have] + 1
        order = np.argsort(key)
        at, key = at[order], key[order]
        old = rank[at]
        last[at] = old + since(key[1:] != key[:-1])[: len(at)] - since(old[1:] != old[:-1])[: len(at)]
        rank, have = last, 2 * have
        levels.append((have, rank))
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], flat: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the longest common prefix of each two suffixes: from the longest level down, what agrees is stepped over."""
    a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(flat)
    rest = np.append(left, 0)  # a place behind the last text has nothing left, and its rank is that of no suffix
    for size, rank in reversed(levels):
        rank = np.append(rank, -1)
        x = rank[a]
        same = np.flatnonzero((x == rank[b]) & (x >= 0))
        own, other = rest[a[same]], rest[b[same]]
        step = np.minimum(size, own)  # equal ranks: both are as short, or neither is
        found[same] += step
        done = (own <= size) | (other <= size)
        a[same] = np.where(done, n, a[same] + step)
        b[same] = np.where(done, n, b[same] + step)
    word = np.append(words(flat, big=True), U64(0))  # fewer than eight bytes are still alike
    differ = word[a] ^ word[b]
    alike = sum((differ < (U64(1) << U64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    return found + np.minimum(alike, np.minimum(rest[a], rest[b]))


def nearest_smaller(document: np.ndarray) -> np.ndarray:
    """Of each place the nearest before it with a smaller document, -1 for none: what lies between a place and the one it points to is never smaller than its own, so
    a place that points to one no smaller may point on to where that one points."""
    before = np.arange(-1, len(document) - 1)
    at = np.flatnonzero(before >= 0)
    while True:
        at = at[document[before[at]] >= document[at]]
        if not len(at):
            return before
        before[at] = before[before[at]]
        at = at[before[at] >= 0]


def previous_factors(texts: list[bytes], docs: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in document order, one after another: where each begins, with the end as last; of each place the length of the longest factor that
    also starts in a text of a smaller document, and where it does (0 and -1 for none). Factors of fewer than `least` bytes are told as such or as
    none, since suffixes that are shorter take no part.

    Of all suffixes of smaller documents the nearest before and the nearest after a suffix in suffix order share most with it (its previous and
    next smaller places), so its longest previous factor is the longer of the two common prefixes.
    """
    flat, starts = flat_bytes(texts)
    n, sizes = len(flat), np.diff(starts)
    left = np.repeat(starts[1:], sizes) - np.arange(n)
    levels = suffix_ranks(flat, left, least)
    order = np.flatnonzero(left >= least)
    order = order[np.argsort(levels[-1][1][order], kind="stable")]  # ties in text order
    m, document = len(order), np.repeat(docs, sizes)[order]
    factor, source = np.zeros(n, np.int64), np.full(n, -1)
    for turned in (False, True):
        near = nearest_smaller(document[::-1] if turned else document)
        near = np.where(near >= 0, m - 1 - near, -1)[::-1] if turned else near
        hit = np.flatnonzero(near >= 0)
        own, other = order[hit], order[near[hit]]
        shared = common_prefixes(levels, flat, left, own, other)
        more = shared > factor[own]
        factor[own[more]], source[own[more]] = shared[more], other[more]
    return starts, factor, source


def resolve(open_segments: DataFrame, length: int, buckets: int, shards: int) -> DataFrame:
    """shard, first, doc_id, ranges: the repeated ranges of open segments (low, doc_id, place, ranges: their bytes)."""
    out = pa.schema([("shard", pa.int32()), ("first", pa.int32()), ("doc_id", pa.int64()), ("ranges", pa.binary())])
    result = "shard int, first int, doc_id long, ranges binary"

    def find(rows):
        rows.sort(key=lambda r: (r[1], r[2]))
        starts, factor, _ = previous_factors([r[3] for r in rows], np.array([r[1] for r in rows], np.int64), length)
        hits = np.flatnonzero(factor >= length)
        cuts = np.searchsorted(hits, starts)
        made = []
        for (_, doc, place, _), a, b, start in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), starts.tolist(), strict=False):
            if a < b:
                mine = hits[a:b] - start
                cut = np.flatnonzero(np.append(True, np.diff(mine) > length))
                ends = np.append(mine[cut[1:] - 1], mine[-1]) + length
                made.append((doc % shards, 0, doc, (np.c_[mine[cut], ends] + place).astype("<i8").tobytes()))
        return batch_of(out, *map(list, zip(*made, strict=True))) if made else None

    def run(batches):
        at, rows, size = None, [], 0
        for batch in slices(batches, 3, CHUNK):
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[0] != at and size >= CHUNK:
                    if (found := find(rows)) is not None:
                        yield found
                    rows, size = [], 0
                at = r[0]
                rows.append(r)
                size += len(r[3])
        if rows and (found := find(rows)) is not None:
            yield found

    def each_window(batches):
        kind = pa.schema([("window", pa.binary()), ("doc_id", pa.int64()), ("place", pa.int64())])
        for batch in slices(batches, 3, CHUNK // 8):
            made = [(data[i : i + length], doc, place + i) for _, doc, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i in range(len(data) - length + 1)]
            yield batch_of(kind, *map(list, zip(*made, strict=True)))

    rows = open_segments.select("low", "doc_id", "place", "ranges")
    wide = rows.groupBy("low").agg(F.sum(F.length("ranges")).alias("n")).where(F.col("n") > WIDE).select("low")
    if wide.isEmpty():
        return rows.repartition(buckets // FINE, "low").sortWithinPartitions("low").transform(mapped, run, result)
    wide = table(wide, "wide")
    narrow = rows.join(wide, "low", "left_anti").select(rows.columns)
    windows = table(rows.join(wide, "low", "left_semi").select(rows.columns).transform(mapped, each_window, "window binary, doc_id long, place long"), "windows")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
    late = windows.join(first, "window").where("doc_id > least")

    def as_ranges(batches):
        for batch in batches:
            doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pairs = np.c_[place, place + length].astype("<i8")
            yield batch_of(out, doc % shards, np.zeros(len(doc), np.int32), doc, [x.tobytes() for x in pairs])

    found = late.select("doc_id", "place").transform(mapped, as_ranges, result)
    return narrow.repartition(buckets // FINE, "low").sortWithinPartitions("low").transform(mapped, run, result).unionByName(found)


def complete(rows: DataFrame, shards: int, keep_text: bool) -> DataFrame:
    """rows: shard, first, doc_id, ranges, text, extra; a document's text comes after its ranges."""

    def run(batches):
        at, known = None, {}
        for batch in slices(batches, 4, WORDS_PER_SLICE):
            made = []
            for shard, first, doc, ranges, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    at, known = shard, {}
                more = np.frombuffer(ranges, "<i8").reshape(-1, 2)
                if not first:
                    known.setdefault(doc, []).append(more)
                else:
                    made.append(finished(doc, text.encode(), np.concatenate([more, *known.get(doc, ())]), keep_text, extra))
            if made:
                yield batch_of(DONE_SCHEMA, *map(list, zip(*made, strict=True)))

    return rows.repartition(shards // FINE, "shard").sortWithinPartitions("shard", "first").transform(mapped, run, DONE)


def remove(docs: DataFrame, length: int = 50, keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with a tuple of columns to keep also these and `kept`, the text left (bytes of cut characters left out)."""
    spark = docs.sparkSession
    keep_text, columns = keep is not None, keep or ()
    buckets = shards = FINE * partitions(spark)
    extra = F.to_json(F.struct(*columns)) if columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), extra.alias("extra"))
    found = judge(send(rows, length, buckets), buckets, shards)
    nothing = F.lit(None)
    text, more = nothing.cast("string").alias("text"), nothing.cast("string").alias("extra")
    left = found.select("*", nothing.cast("long").alias("doc_id"), text, more)
    right = rows.select(
        F.coalesce(F.pmod("doc_id", F.lit(shards)), F.pmod(F.xxhash64("text"), F.lit(shards))).cast("int").alias("shard"), F.lit(1).alias("first"), *[nothing.cast("binary").alias(c) for c in ("docs", "counts", "whole", "open")], "doc_id", "text", "extra",
    )
    done = table(apply_findings(left.unionByName(right), length, shards, keep_text), "repeats", True)
    closed = done.where(F.col("kind") == FINISHED)
    ranges = resolve(done.where(F.col("kind") == SEGMENT), length, buckets, shards).select("*", text, more)
    opened = done.where(F.col("kind") == OPEN).select(F.pmod("doc_id", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("first"), "doc_id", "ranges", "text", "extra")
    every = closed.unionByName(complete(ranges.unionByName(opened), shards, keep_text))
    figures = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if not keep_text:
        return every.select(*figures)
    back = F.from_json("extra", docs.select(*columns).schema) if columns else None
    return every.select(*figures, *[back[c].alias(c) for c in columns], "kept")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    return remove(read(spark, sf_dir, "documents"))
