"""SentencePiece encoding and decoding of merge-type models by backtracking.

A merge-type model begins with single characters and again and again joins the two neighbours whose union has the best score, the
leftmost of equals. What it ends with is the only way to cut the text into pieces in which each two neighbours are compatible: merging
their characters anew gives just these two. (Up to the first merge across a border the merges on both sides are those that the two
pieces alone would see, so they would make it too.) So the encoder walks from left to right, takes the longest piece that an
Aho-Corasick automaton finds at its place, shortens it to the piece's longest own prefix while it does not go with the one before,
and where none does gives up the piece before. A cut of a prefix into compatible pieces is its only one, so a place that was given up once is
given up for good: one bit for each place keeps the walk linear. Compatibility of two pieces is found by re-merging and remembered.

Blanks are written as U+2581 and one is put before each text that is not empty, as such models do; characters that no piece holds
become a piece for each byte. Between two characters that no piece holds side by side (a letter and a blank behind it, say) there is
always a border, so a text is cut there and each distinct part of a batch is encoded once.

Nulls are empty texts, and empty texts have no ids. Repeated rows are independent rows. A text of any length is encoded
whole; memory is the text and a few numbers for each character of its longest part. A column of docs with the name of the result is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, kept, mapped, read, slices, widen

#: Fixed values of the file format: kinds of pieces, the kind of model, the blank, what an unknown id is decoded to.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
MERGES = 2
BLANK = "▁"
UNKNOWN_TEXT = " ⁇ "
#: More than a piece or a character can be.
WIDE = 1 << 24


def _each_byte(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("mergelens-each-byte", _each_byte)


class Pieces:
    """A model: its file's bytes. Merge-type models without normalisation, that put a blank first and have pieces for bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        about = sentencepiece_model_pb2.ModelProto()
        about.ParseFromString(model)
        form, kinds = about.normalizer_spec, [p.type for p in about.pieces]
        if about.trainer_spec.model_type != MERGES or USER in kinds or UNUSED in kinds or kinds.count(BYTE) != 256:
            raise ValueError("only models of the merge type with a piece for each byte and without pieces of the user are supported")
        if form.precompiled_charsmap or not form.add_dummy_prefix or form.remove_extra_whitespaces or not form.escape_whitespaces or about.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are but for a blank in front are supported")
        self.n = len(about.pieces)
        self.text = [p.piece for p in about.pieces]
        self.score = {p.piece: p.score for p in about.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(about.pieces) if p.type == NORMAL}
        bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(about.pieces) if p.type == BYTE}
        self.byte_id, self.of_byte = bytes_of, {i: b for b, i in bytes_of.items()}
        self.silent = {i: "" for i, k in enumerate(kinds) if k == CONTROL} | {i: UNKNOWN_TEXT for i, k in enumerate(kinds) if k == UNKNOWN}
        self.size, self.back = [len(p) for p in self.text], [len(p) - 1 for p in self.text]
        self.decimal = [f",{i}" for i in range(self.n)]
        self.plain = [self.silent.get(i, p.replace(BLANK, " ")) for i, p in enumerate(self.text)]
        self.other = {*self.silent, *self.of_byte}
        self.apart = self._apart()
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.prefix = {i: next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p, i in self.id.items()}
        self.sound: dict[int, bool] = {}
        self.parts = Memo(self._part, 500_000)

    def _apart(self) -> np.ndarray:
        """For two neighbouring bytes of a text, whether they are two characters that no piece holds side by side: always a border of pieces.
        What is not ASCII is told by its first byte only and never held to be apart from what follows."""
        apart = np.zeros((256, 256), bool)
        apart[:128, :128] = True
        apart[:128, 192:] = True
        for piece in self.id:
            data = piece.replace(BLANK, " ").encode()
            for a, b in zip(data, data[1:], strict=False):
                apart[a, b] = False
        after = np.zeros(128, bool)  # ASCII behind a last byte of something else
        for piece in self.id:
            flat = piece.replace(BLANK, " ")
            for a, b in zip(flat, flat[1:], strict=False):
                if a > "\x7f" >= b:
                    after[ord(b)] = True
        apart[128:192, :128] = ~after
        return apart

    def token(self, i: int) -> str:
        """The characters of a piece, or of an unknown character, which counts from the model's size."""
        return self.text[i] if i < self.n else chr(i - self.n)

    def merge(self, text: str) -> list[str]:
        """All merges of a short string, the best score first and the leftmost of equals."""
        parts, get = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes(self, before: int, piece: int) -> bool:
        """Whether re-merging two neighbours gives them back; before -1: whether a piece stands for itself."""
        if len(self.sound) >= 3_000_000:
            self.sound.clear()
        parts = [self.token(i) for i in (before, piece) if i >= 0]
        found = self.sound[before * WIDE + piece] = self.merge("".join(parts)) == parts
        return found

    def longest(self, text: str) -> list[int]:
        """For each place the longest piece that begins there, else the unknown character."""
        found = [0] * len(text)
        for at, i in self.automaton.iter(text):  # ends grow, so the last that begins at a place is its longest
            found[at - self.back[i]] = i
        if 0 in found:  # the unknown piece is in no text
            found = [i or self.n + ord(c) for i, c in zip(found, text, strict=True)]
        return found

    def walk(self, text: str) -> list[int]:
        """The pieces of a part by backtracking."""
        n, known, size, longest = len(text), self.sound.get, self.size, self.longest(text)
        out, before, at, failed = [], -1, 0, bytearray(n // 8 + 1)
        piece = longest[0] if n else None
        while at < n:
            while piece is not None:
                end = at + (size[piece] if piece < self.n else 1)
                if not failed[end >> 3] >> (end & 7) & 1:
                    goes = known(before * WIDE + piece)
                    if goes or goes is None and self.goes(before, piece):
                        break
                piece = self.shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no cut into compatible pieces")
                gone = out.pop()
                at -= size[gone] if gone < self.n else 1
                before, piece = out[-1] if out else -1, self.shorter(gone)
            else:
                out.append(piece)
                at, before = end, piece
                piece = longest[at] if at < n else None
        return out

    def shorter(self, piece: int) -> int | None:
        """The longest piece that a piece begins with but itself; its first character, if no piece, counts as one."""
        if piece >= self.n:
            return None
        found, text = self.prefix[piece], self.text[piece]
        return self.n + ord(text[0]) if found is None and len(text) > 1 else found

    def ids_of(self, part: str) -> list[int]:
        """The ids of a part: its pieces, and the bytes of unknown characters."""
        found = self.walk(part.replace(" ", BLANK))
        if max(found) < self.n:
            return found
        return [x for i in found for x in ([i] if i < self.n else map(self.byte_id.__getitem__, chr(i - self.n).encode()))]

    def _part(self, part: str) -> tuple[array, bytes, bytes]:
        """Of a part: ids, the same in decimal with a comma before each, and the bytes they are decoded to."""
        ids = self.ids_of(part)
        return array("I", ids), "".join(map(self.decimal.__getitem__, ids)).encode(), self.said(ids).encode()

    def said(self, ids) -> str:
        """Text of ids, with the blank that stands before every text."""
        if self.other.isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            byte = self.of_byte.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(run.decode("utf-8", "mergelens-each-byte"))
                run = bytearray()
            out.append(self.plain[i])
        return "".join(out) + run.decode("utf-8", "mergelens-each-byte")

    def decode(self, ids, step: int = 32_768) -> str:
        """The text of ids without the blank in front. Steps end before a piece that is no byte, so no character is torn."""
        ids, out, at = list(ids), [], 0
        while at < len(ids):
            end = min(len(ids), at + step)
            while end < len(ids) and ids[end] in self.of_byte:
                end += 1
            out.append(self.said(ids[at:end]))
            at = end
        first = next((i for i in ids if i not in self.silent or self.silent[i]), None)
        text = "".join(out)
        return text[1:] if first is not None and first not in self.silent and first not in self.of_byte and text.startswith(" ") else text

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        coded, values, _, _ = self.batch(pa.array([text or ""], pa.string()))
        return np.frombuffer(b"".join(values[i][0].tobytes() for i in coded.tolist()), "<u4")

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple], np.ndarray, np.ndarray]:
        """Of texts: for each part the number of its value, the distinct values, where each text's parts begin and end."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.string()), BLANK, " ")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        full = sizes > 0
        heads = (offsets[:-1] - offsets[0])[full] + np.arange(int(full.sum()))
        flat = np.full(len(data) + len(heads), 32, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[heads] = False
        flat[inside] = data
        begin = np.zeros(len(flat), bool)
        begin[1:] = self.apart[flat[:-1], flat[1:]]
        begin[heads] = True
        at = np.flatnonzero(begin)
        ends = np.append(at, len(flat)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(flat)).dictionary_encode()
        values = list(map(self.parts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        starts = np.searchsorted(at, heads)
        first = np.zeros(len(sizes), np.int64)
        last = np.zeros(len(sizes), np.int64)
        first[full], last[full] = starts, np.append(starts[1:], len(at))
        return coded.indices.to_numpy(zero_copy_only=False), values, first, last


def joined(values: list[bytes], coded: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values that are asked for, one after another, and where each begins, with the end as last."""
    found = pa.array(values, pa.large_binary()).take(pa.array(coded))
    return memoryview(found.buffers()[2] or b""), np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]


def pieces(model: bytes) -> Pieces:
    return kept(("pieces", hash(model)), lambda: Pieces(model))


def read_model(path: str) -> bytes:
    """A model file of the driver; its bytes go to the executors, which need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (binary, little-endian unsigned 32-bit); null texts have none."""
    docs = docs.drop(ids)
    schema, at = widen(docs, **{ids: "binary"}), docs.columns.index(text)

    def run(batches):
        machine = pieces(model)
        for batch in slices(batches, at):
            coded, values, first, last = machine.batch(batch.column(at))
            data, place = joined([v[0].tobytes() for v in values], coded)
            found = [bytes(data[place[a] : place[b]]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, ids])

    return docs.transform(mapped, run, schema)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids have none."""
    rows = rows.drop(text)
    schema, at = widen(rows, **{text: "string"}), rows.columns.index(ids)

    def run(batches):
        machine = pieces(model)
        for batch in slices(batches, at):
            found = [None if b is None else machine.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return rows.transform(mapped, run, schema)


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, then decoded from the ids, in one pass.

    Each distinct part is decoded from its own ids. Parts hold whole characters, so what each is decoded to can be joined."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        machine = pieces(model)
        for batch in slices(batches, 1):
            coded, values, first, last = machine.batch(batch.column(1))
            upto = np.append(0, np.cumsum(np.array([len(v[0]) for v in values], np.int64)[coded])) if len(coded) else np.zeros(1, np.int64)
            decimal, at = joined([v[1] for v in values], coded)
            said, place = joined([v[2] for v in values], coded)
            bounds = list(zip(first.tolist(), last.tolist(), strict=True))
            ids = [hashlib.sha256(decimal[at[a] + 1 : at[b]] if b > a else b"").hexdigest() for a, b in bounds]
            back = [hashlib.sha256(said[place[a] + 1 : place[b]] if b > a else b"").hexdigest() for a, b in bounds]
            yield batch_of(out, batch.column(0), pa.array(upto[last] - upto[first]), ids, back)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(mapped, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), read_model(public_tokenizers.path("piece_bpe_32k.model")))
