"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

The merge list itself bounds how far to the right a decision can depend. A merge of X and Y happens
unless Y, or a part at Y's left edge that must first become Y, is taken by an earlier merge to its
right; so the bytes after X on which rule r = (X, Y) depends are
``need(r) = |Y| + max(need(q))`` over rules q = (S, Z) that come before S's own next step in r, for S on
Y's right edge. Ranks fall along the chain, so one pass over the rules gives every bound, and the
largest is the lookahead. A token whose end lies that far behind the end of what was read can never
change, and what follows it is encoded as if it began there; so it is emitted and forgotten. Memory is
the block plus the lookahead, for a word of any length.

A text is taken in chunks of some `CHUNK` characters that end before a blank which a non-blank follows, as the split pattern always cuts
there; a piece longer than a block goes through the transducer block by block. Ids leave chunk by chunk, so beside the text itself memory
does not grow with it.

Decoding turns ids into bytes and feeds them to an incremental UTF-8 automaton, which keeps an
unfinished character between steps and puts U+FFFD for what can't be one.

Nulls are empty texts with no ids. Tie and repeated rows are independent rows. A column of docs with the name of the result is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, kept, mapped, read, slices, widen
from .encoder import byte_letters, read_spec

#: The fixed split pattern of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern means it; the regex module's own class agrees but for U+001C to U+001F.
SPACE = r"[\t-\r \x85\xa0  -     　]"
SPLITTER = regex.compile(SPLIT.replace(r"(?!\S)", f"(?={SPACE}|\\Z)").replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r \x85\xa0  -     　\p{L}\p{N}]").replace(r"\s+", f"{SPACE}+"))
BLOCK = 4096
CHUNK = 1 << 16


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a place that are enough to decide all that ends before it."""
    made: dict[bytes, tuple[int, bytes]] = {}  # token: the rank that makes it, its right part
    after: dict[bytes, tuple[list[int], list[int]]] = {}  # left part: ranks, largest need so far
    worst = 1

    def before(symbol: bytes, rank: int) -> int:
        ranks, needs = after.get(symbol, ((), ()))
        i = bisect_left(ranks, rank)
        return needs[i - 1] if i else 0

    for rank, (x, y) in enumerate(merges):
        need, symbol, limit = before(y, rank), y, rank
        while symbol in made:
            limit, symbol = made[symbol]
            need = max(need, before(symbol, limit))
        need += len(y)
        worst = max(worst, need)
        ranks, needs = after.setdefault(x, ([], []))
        ranks.append(rank)
        needs.append(max(need, needs[-1] if needs else 0))
        made.setdefault(x + y, (rank, y))
    return worst + max((len(t) for t in made), default=1)


class Transducer:
    def __init__(self, spec: str, block: int = BLOCK):
        about = json.loads(spec)
        model, back = about["model"], {ord(c): b for b, c in byte_letters().items()}
        pack = lambda s: bytes(back[ord(c)] for c in s)
        self.added = {t["content"]: t["id"] for t in about["added_tokens"]}
        self.vocab = {pack(t): i for t, i in model["vocab"].items() if t not in self.added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(pack(a), pack(b)) for a, b in pairs]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.lookahead, self.block = lookahead(merges), block
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        self.kind = "<u2" if size <= 65_536 else "<u4"
        self.bytes_of = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pieces = Memo(self._piece)
        self.first = Memo(self._unit)
        self.spaced = Memo(self._spaced, 600_000)

    def merge(self, data: bytes) -> list[bytes]:
        """All merges of a string, lowest rank first and leftmost among equals."""
        if data in self.vocab and len(data) == 1:
            return [data]
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.rank.get
        if len(parts) <= 64:
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = get((parts[i], parts[i + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return parts
        return self._merge_long(parts)

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same with a heap of candidate pairs over a linked list."""
        import heapq

        n, get = len(parts), self.rank.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], right[i] = a + b, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := get((parts[k], parts[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
        return [p for p, live in zip(parts, alive, strict=True) if live]

    def stream(self, chunks):
        """Tokens of one split piece given in chunks of bytes, each once it is stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            if len(held) < self.block + self.lookahead:
                continue
            end, stable = 0, len(held) - self.lookahead
            for token in self.merge(held):
                if end + len(token) > stable:
                    break
                end += len(token)
                yield token
            held = held[end:]
        yield from self.merge(held) if held else ()

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        chunks = (data[i : i + self.block] for i in range(0, len(data), self.block))
        return np.array([self.vocab[t] for t in self.stream(chunks)], self.kind).tobytes()

    def _unit(self, unit: str) -> bytes:
        if self.special and self.special.search(unit):
            raise Unsafe
        return b"".join(map(self.pieces.__getitem__, SPLITTER.findall(unit)))

    def _spaced(self, word: str) -> bytes:
        if not word or BLANK.match(word):
            raise Unsafe  # a run of white space here could reach over the cut
        return self._unit(" " + word)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text. A cut before a blank that a non-blank follows is always one of the pattern's."""
        if not text:
            return np.zeros(0, self.kind)
        head, *rest = text.split(" ")
        try:
            return np.frombuffer((self.first[head] if head else b"") + b"".join(map(self.spaced.__getitem__, rest)), self.kind)
        except Unsafe:
            return np.frombuffer(b"".join(self._parts(text)), self.kind)

    def _parts(self, text: str):
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            for piece in SPLITTER.finditer(text, at, m.start() if m else len(text)) if not m else SPLITTER.finditer(text[at : m.start()]):
                if piece.end() - piece.start() > self.block:
                    yield from self._long(piece.group())
                else:
                    yield self.pieces[piece.group()]
            if m:
                yield np.array([self.added[m.group()]], self.kind).tobytes()
                at = m.end()

    def _long(self, piece: str):
        """A long piece's ids, some thousand at a time, as they become stable."""
        tokens = self.stream(piece[i : i + self.block].encode() for i in range(0, len(piece), self.block))
        while some := list(islice(tokens, self.block)):
            yield np.array([self.vocab[t] for t in some], self.kind).tobytes()

    def emit(self, text: str | None, chunk: int = CHUNK):
        """The ids of a whole text, array by array."""
        text, at = text or "", 0
        while at < len(text):
            end = len(text)
            if end - at > 2 * chunk and (m := CUT.search(text, at + chunk)):
                end = m.start()
            if end - at <= 4 * chunk:
                yield self.ids(text[at:end])
            else:  # hardly any blanks
                for part in self._parts(text[at:end]):
                    yield np.frombuffer(part, self.kind)
            at = end

    def decode(self, ids, step: int = 32_768):
        """Text of ids, piece by piece; memory is one step."""
        return self.decoded(ids[at : at + step] for at in range(0, len(ids), step))

    def decoded(self, arrays):
        """Text of ids that come in arrays."""
        automaton = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in arrays:
            yield automaton.decode(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))
        yield automaton.decode(b"", True)


class Unsafe(Exception):
    """A unit whose encoding depends on what stands beside it."""


BLANK = regex.compile(SPACE)
CUT = regex.compile(f" (?!{SPACE})(?=.)", regex.DOTALL)


def transducer(spec: str) -> Transducer:
    return kept(("bpe", hash(spec)), lambda: Transducer(spec))


def encode(docs: DataFrame, spec: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (binary, little-endian unsigned 32-bit); null texts have none."""
    docs = docs.drop(ids)
    schema = widen(docs, **{ids: "binary"})
    at = docs.columns.index(text)

    def run(batches):
        machine = transducer(spec)
        for batch in slices(batches, at):
            found = [b"".join(a.astype("<u4").tobytes() for a in machine.emit(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, ids])

    return docs.transform(mapped, run, schema)


def decode(rows: DataFrame, spec: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids."""
    rows = rows.drop(text)
    schema = widen(rows, **{text: "string"})
    at = rows.columns.index(ids)

    def run(batches):
        machine = transducer(spec)
        for batch in slices(batches, at):
            found = [None if b is None else "".join(machine.decode(np.frombuffer(b, "<u4"))) for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return rows.transform(mapped, run, schema)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, then decoded from the ids, in one pass."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        machine = transducer(spec)
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                n, own, back = 0, hashlib.sha256(), hashlib.sha256()

                def told(arrays):
                    nonlocal n
                    for ids in arrays:
                        n += len(ids)
                        own.update(ids.astype("<u4").tobytes())  # noqa: B023
                        yield ids

                for part in machine.decoded(told(machine.emit(text))):
                    back.update(part.encode())
                rows.append((n, own.hexdigest(), back.hexdigest()))
            yield batch_of(out, batch.column(0), *map(list, zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), read_spec(public_tokenizers.path("byte_bpe_50k.json")))
