"""Best-fit packing planned on the histogram of lengths.

1. Every document becomes ids and an end id; only one longer than a sequence is cut, into full pieces
   and a rest. The table of pieces (no ids) is written once, each piece with its task and its place
   among the task's pieces of its length.
2. Counts by length, at most one row for each length, go to the driver. Best fit in falling order works on
   counts: all pieces of a length enter open sequences with the least sufficient room together, and
   sequences filled alike stay one class. The plan is a list of slots (length, first rank, count, first
   sequence, offset); its size depends on the sequence length only, not on the number of documents.
3. A piece's rank within its length is its task's base (a sum over counts by task and length) plus its
   place; the plan's slot of that rank is its place.

Null and empty texts are the end id alone. Repeated rows, null and equal ids are pieces of their own. Columns beside doc_id and text are
not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, mapped, read, slices, table
from .encoder import encoder, read_spec

PIECES = "doc_id long, n_tokens long, piece int, start long, length long, ids_crc32 long, task int, place long"


def place_in_kind(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(x, kind="stable")
    new = np.append(True, x[order][1:] != x[order][:-1])[: len(x)]
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    return out


def pieces(docs: DataFrame, spec: str, size: int, end: int) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        task, made, code = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), encoder(spec)
        for batch in slices(batches, 1):
            ids, starts = code.closed(batch.column(1), end)
            whole = np.diff(starts)
            n = -(-whole // size)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(size, whole[doc] - size * piece)
            place = made[length] + place_in_kind(length)
            made += np.bincount(length, minlength=size + 1)
            data, at = memoryview(ids).cast("B"), (starts[doc] + size * piece).tolist()
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
            yield batch_of(out, batch.column(0).take(pa.array(doc)), whole[doc], piece, size * piece, length, crc, np.full(len(doc), task), place)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset), by length and first rank.

    Lengths come in falling order; each piece goes where the least room that suffices is left.
    """
    room: dict[int, list[list[int]]] = {}  # room left: runs [first sequence, count]
    open_rooms: list[int] = []
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_right(open_rooms, length - 1)
            if i < len(open_rooms):
                r = open_rooms[i]
                first, n = room[r].pop()
                if n > left:
                    room[r].append([first + left, n - left])
                    n = left
                if not room[r]:
                    del room[r]
                    open_rooms.pop(i)
            else:
                each = size // length  # a new sequence's best fit for the next of this length is itself
                n, r = max(1, left // each), size
                first, sequences = sequences, sequences + n
                for k in range(min(each, left)):
                    slots.append((length, rank, n, first, k * length))
                    rank, left, r = rank + n, left - n, r - length
                _put(room, open_rooms, r, first, n)
                continue
            slots.append((length, rank, n, first, size - r))
            rank, left = rank + n, left - n
            _put(room, open_rooms, r - length, first, n)
    return sorted(slots)


def _put(room, open_rooms, r, first, n):
    if r <= 0:
        return
    if r not in room:
        room[r] = []
        open_rooms.insert(bisect_right(open_rooms, r), r)
    runs = room[r]
    if runs and runs[-1][0] + runs[-1][1] == first:
        runs[-1][1] += n
    else:
        runs.append([first, n])


def pack(docs: DataFrame, spec: str, size: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = table(pieces(docs, spec, size, end), "pieces", narrow=True)
    by_task = table(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = plan(counts, size)
    first = {length: i for i, (length, *_) in reversed(list(enumerate(slots)))}
    last = {length: i + 1 for i, (length, *_) in enumerate(slots)}
    grid = np.array(slots or [(0, 0, 0, 0, 0)], np.int64)
    base = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # lengths times tasks grow with the input, so this is never broadcast
    ranked = cut.join(base.hint("merge"), ["length", "task"]).select(*names, (F.col("base") + F.col("place")).alias("rank"))

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                mine, lo, hi = lengths == length, first[length], last[length]
                at[mine] = lo + np.searchsorted(grid[lo:hi, 1], ranks[mine], side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(grid[at, 3] + ranks - grid[at, 1]), pa.array(grid[at, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.transform(mapped, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json")))
