"""Token ids in a grammar-compressed binary format with random access.

A file is one table in the shared folder, written and committed by Spark; each row is a shard, a run of
documents in ascending id order whose ids are compressed by Re-Pair. A document's closing id is a symbol of its own, which
no pair holds, so every document begins and ends between symbols and can be decoded alone.

Re-Pair here replaces in rounds: all pairs of neighbouring symbols seen at least `least` times are counted exactly and ranked by
their counts; where two of them overlap the higher rank wins, and every pair that won `least` places gets a nonterminal. The highest
always does, so rounds go on until no pair is left that often. `least` is 4: a rule takes two symbols and its expansion length and each use
saves one symbol, so three uses would save next to nothing; measured, 3, 5 and 6 all make larger files (by 0.5 to 1.4 %).

A shard's blob, all integers little-endian:
    8 bytes  "MLTOKEN2"
    u4 x 8   symbol of a document's end (nonterminals follow it), its id, numbers of rules, symbols, documents and ids, bits
             of an expansion length, bits of a document's count
    planes of the rules' left symbols, right symbols and expansion lengths, of the symbols, and of each document's
    numbers of symbols and of ids
Planes hold n numbers of b bits: b // 8 rows of n bytes, the lowest bytes first, then b % 8 rows of n bits. A symbol has as many bits as
the highest one needs. Any run of numbers can be read by itself.

Null and empty texts are the end id alone. Null doc_ids come first; among equal doc_ids the order is that of
the texts. Repeated rows are kept. Columns beside doc_id and text are not read. A shard closes after the first batch of texts that
fills it, so a single document is never cut and must fit into memory.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batch_of, mapped, partitions, read, slices, table
from .encoder import encoder, read_spec

MAGIC = b"MLTOKEN2"
SHARD = "shard int, part int, before long, doc_ids array<long>, n_ids long, blob binary"


def repair(ids: np.ndarray, first: int, end: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths; a rule's symbols come before it.

    Counts of old pairs only fall, so after a round it is enough to look at pairs with a new symbol and at those that lost
    their places; when these give nothing more, all places are looked at again before it ends.
    """
    symbols, made, known = ids.astype(np.uint32), [], 0
    look, salt = None, 0x9E3779B97F4A7C15  # the places to look at, None for all
    while len(symbols) > 1:
        at = np.arange(len(symbols) - 1) if look is None else look
        a, b = (symbols[:-1], symbols[1:]) if look is None else (symbols[at], symbols[at + 1])
        code = (a.astype(U64) << U64(32)) | b
        may = (a != end) & (b != end)
        run = np.append(False, (code[1:] == code[:-1]) & (at[1:] == at[:-1] + 1))[: len(code)]
        if run.any():  # of a pair that overlaps itself every second place
            place = np.arange(len(code))
            may &= (place - np.maximum.accumulate(np.where(run, 0, place))) % 2 == 0
        sorted_codes = np.sort(code[may])
        heads = np.flatnonzero(np.append(True, sorted_codes[1:] != sorted_codes[:-1])[: len(sorted_codes)])
        counts = np.diff(np.append(heads, len(sorted_codes)))
        pairs, counts = sorted_codes[heads[counts >= least]], counts[counts >= least]
        where = np.zeros(0, np.int64)
        if len(pairs):
            order = np.argsort(counts, kind="stable")
            rank = np.empty(len(pairs), np.int32)
            rank[order] = np.arange(1, len(pairs) + 1)
            # a table of hashed slots finds a place's pair; of pairs that share a slot the others wait for another salt
            bits = max(12, (8 * len(pairs)).bit_length())
            salt = (salt * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
            slot = lambda x: ((x * U64(salt)) >> U64(64 - bits)).astype(np.int32)  # noqa: B023, E731
            owner = np.zeros(1 << bits, np.int32)
            owner[slot(pairs[order])] = order + 1
            which = owner[slot(code)] - 1
            hit = may & (pairs[which] == code)  # an empty slot's -1 is the last pair, which then is not this one or has no slot
            height = rank[which]
            height *= hit
            before, after = np.append(np.int32(0), height[:-1]), np.append(height[1:], np.int32(0))
            if look is not None:
                beside = at[1:] == at[:-1] + 1
                before[1:] *= beside
                after[:-1] *= beside
            won = np.flatnonzero(hit & (height > before) & (height >= after))
            good = np.bincount(which[won], minlength=len(pairs)) >= least
            won = won[good[which[won]]]
            where = at[won]
        if not len(where):
            if look is None:
                break
            look = None
            continue
        new = first + known + (np.cumsum(good) - 1)[which[won]]
        lost = hit.copy()
        lost[won] = False
        made.append(np.c_[pairs[good] >> U64(32), pairs[good] & U64(0xFFFFFFFF)].astype(np.int64))
        flag = np.zeros(len(symbols), bool)
        flag[at[lost]] = True
        flag[where] = True
        flag[np.maximum(where, 1) - 1] = True  # a pair whose right symbol is new; one that was replaced itself is skipped below
        symbols[where] = new
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        # a place before a replaced pair may itself have been the right half of another: then its left half is the neighbour
        gone = where[(where >= 2)] - 1
        flag[gone[~keep[gone]] - 1] = True
        symbols, look = symbols[keep], np.flatnonzero(flag[keep][:-1])
        known += int(good.sum())
    rules = np.concatenate(made) if made else np.zeros((0, 2), np.int64)
    sizes, done = np.concatenate([np.ones(first, np.int64), np.zeros(known, np.int64)]), first
    for part in made:
        sizes[done : done + len(part)] = sizes[part].sum(axis=1)
        done += len(part)
    return symbols, rules.astype(np.uint32), sizes[first:]


def planes(x: np.ndarray, bits: int) -> bytes:
    rows = [((x >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8).tobytes() for k in range(bits // 8)]
    return b"".join([*rows, *(np.packbits((x >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes() for k in range(bits // 8 * 8, bits))])


class Planes:
    """n numbers of some bits, from a place in a blob on."""

    def __init__(self, blob: bytes, at: int, n: int, bits: int):
        self.blob, self.at, self.n, self.bits = blob, at, n, bits
        self.end = at + bits // 8 * n + bits % 8 * (-(-n // 8))

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(self.n)
        b, low = max(a, b), self.bits // 8
        out = np.zeros(b - a, np.uint32)
        for k in range(low):
            out |= np.frombuffer(self.blob, np.uint8, b - a, self.at + k * self.n + a).astype(np.uint32) << np.uint32(8 * k)
        for k in range(self.bits % 8):
            row = np.frombuffer(self.blob, np.uint8, -(-b // 8) - a // 8, self.at + low * self.n + k * -(-self.n // 8) + a // 8)
            out |= np.unpackbits(row, bitorder="little")[a % 8 : a % 8 + b - a].astype(np.uint32) << np.uint32(8 * low + k)
        return out


def width(x: np.ndarray) -> int:
    return int(x.max(initial=0)).bit_length()


def write_shard(ids: np.ndarray, end: int, stop: int, least: int = 4) -> bytes:
    """The blob of documents' ids, each closed by stop, which is over every id and stands for the end id."""
    symbols, rules, sizes = repair(ids, stop + 1, stop, least)
    n_ids, n_symbols = (np.diff(np.append(0, np.flatnonzero(x == stop) + 1)).astype(np.uint32) for x in (ids, symbols))
    wide, long, many = (stop + len(rules)).bit_length(), width(sizes), width(n_ids)
    head = struct.pack("<8I", stop, end, len(rules), len(symbols), len(n_ids), len(ids), long, many)
    parts = ((rules[:, 0], wide), (rules[:, 1], wide), (sizes.astype(np.uint32), long), (symbols, wide), (n_symbols, many), (n_ids, many))
    return MAGIC + head + b"".join(planes(x, bits) for x, bits in parts)


class Shard:
    """A blob opened for reading."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        stop, self.end, r, s, d, self.n_ids, long, many = struct.unpack("<8I", blob[8:40])
        self.stop, self.first, at, found = stop, stop + 1, 40, []
        wide = (stop + r).bit_length()
        for n, bits in ((r, wide), (r, wide), (r, long), (s, wide), (d, many), (d, many)):
            found.append(Planes(blob, at, n, bits))
            at = found[-1].end
        left, right, sizes, self.symbols, n_symbols, n_ids = found
        self.rules, self.sizes = np.c_[left[:], right[:]], sizes[:].astype(np.int64)
        self.firsts, self.starts = (np.append(0, np.cumsum(x[:], dtype=np.int64)) for x in (n_symbols, n_ids))
        self.strings = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: each stands for a run of one string, which holds all ids and then the rules' expansions."""
        if self.strings is None:
            flat = self.rules.ravel()
            while (big := flat >= self.first).any():
                to = np.cumsum(np.where(big, 2, 1)) - np.where(big, 2, 1)
                out = np.empty(len(flat) + int(big.sum()), np.uint32)
                out[to[~big]] = flat[~big]
                pair = self.rules[flat[big] - self.first]
                out[to[big]], out[to[big] + 1] = pair[:, 0], pair[:, 1]
                flat = out
            ids = np.arange(self.first, dtype=np.uint32)
            ids[self.stop] = self.end
            self.strings = np.concatenate([ids, flat])
            self.begin = np.concatenate([np.arange(self.first), self.first + np.cumsum(self.sizes) - self.sizes])
            self.length = np.concatenate([np.ones(self.first, np.int64), self.sizes])
        n = self.length[symbols]
        at = np.repeat(self.begin[symbols] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return self.strings[at]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, without its neighbours."""
        return self.expand(self.symbols[self.firsts[i] : self.firsts[i + 1]])

    def id_at(self, place: int) -> int:
        """One id, by its place among the shard's ids: down the rules by expansion length."""
        i = int(np.searchsorted(self.starts, place, side="right")) - 1
        left = place - int(self.starts[i])
        size_of = lambda symbol: 1 if symbol < self.first else int(self.sizes[symbol - self.first])
        for symbol in self.symbols[self.firsts[i] : self.firsts[i + 1]].tolist():
            if left < size_of(symbol):
                break
            left -= size_of(symbol)
        while symbol >= self.first:
            a, b = self.rules[symbol - self.first].tolist()
            symbol, left = (a, left) if left < size_of(a) else (b, left - size_of(a))
        return self.end if symbol == self.stop else symbol

    def all(self) -> np.ndarray:
        return self.expand(self.symbols[:])


def write(docs: DataFrame, spec: str, end: int = 1, shard_ids: int = 1_000_000, least: int = 4) -> DataFrame:
    """Writes the file and returns its table of shards; shard and part give the order, before the number of ids in earlier parts of the shard."""
    out = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("blob", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        task, code, part, held, names, before = TaskContext.get().partitionId(), encoder(spec), 0, [], [], 0
        stop = code.library.get_vocab_size()

        def shard():
            ids = np.concatenate(held)
            return len(ids), batch_of(out, [task], [part], [before], pa.array([pa.concat_arrays(names)], pa.list_(pa.int64())), [len(ids)], [write_shard(ids, end, stop, least)])

        for batch in slices(batches, 1, 1 << 20):
            held.append(code.closed(batch.column(1), stop)[0])
            names.append(batch.column(0))
            if sum(map(len, held)) >= shard_ids:
                n, made = shard()
                yield made
                part, held, names, before = part + 1, [], [], before + n
        if held:
            yield shard()[1]

    return table(rows.transform(mapped, run, SHARD), "tokens", True)


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the file."""
    totals = shards.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect()  # a row for each task that wrote, whatever the number of shards
    starts = np.append(0, np.cumsum([n for _, n in totals])).tolist()
    first = shards.sparkSession.createDataFrame([(s, at) for (s, _), at in zip(totals, starts, strict=False)], "shard int, first long")
    rows = shards.join(F.broadcast(first), "shard").select("doc_ids", (F.col("first") + F.col("before")).alias("start"), "blob")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                opened, start = Shard(batch.column(2)[i].as_py()), batch.column(1)[i].as_py()
                ids, s = memoryview(opened.all().astype("<u4")).cast("B"), opened.starts
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                yield batch_of(out, batch.column(0)[i].values, s[:-1] + start, np.diff(s), crc)

    return rows.transform(mapped, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return documents(write(read(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("word_bpe_49k.json"))))
