"""Whole texts to ids as the tokenizers library gives them, faster where words can be looked up.

A tokenizer that drops white space and whose split pattern never crosses it encodes a text as its
white-space separated words one after another. In texts of ASCII and Latin-1 letters the split pattern is a matter of byte classes,
so the parts of a whole batch are found at once, and each distinct part goes to the library's model once and is remembered.
In other texts words of such letters do so too, and all other words go through the whole library. Any other
tokenizer file is used on whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import Memo, kept

#: Fixed values of the file format: the split pattern whose parts hold no white space.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that stand for themselves under NFC and whose lower case is one letter.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_WORD = re.compile(f"[!-~{LATIN}]+")
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")
#: str.split() also cuts at these, which the library does not hold for white space.
CONTROLS = re.compile("[\x1c-\x1f]")
#: Classes of bytes in lower-cased texts: white space, letters, digits, all else; C3 begins the two bytes of the Latin-1 letters
#: (and of × and ÷, which are none).
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(9, 14), 32]], CLASS[48:58] = SPACE, DIGIT
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_parts(data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The lower-cased parts of texts that lie in data one after another, where each text's begin (the end as last), and which texts hold
    other letters, so that their parts mean nothing."""
    n = len(data)
    flat = np.append(LOWER[data], np.zeros(3, np.uint8))
    lead = np.flatnonzero(data == 0xC3)
    second = flat[lead + 1]
    flat[lead + 1] = np.where(second < 0x9F, second + 32, second)
    strange = lead[(second == 0x97) | (second == 0xB7)]
    if int((data >= 128).sum()) != 2 * len(lead):
        high = data >= 128
        high[lead] = high[lead + 1] = False
        strange = np.append(strange, np.flatnonzero(high))
    kind = CLASS[flat]
    kind[n:] = SPACE
    first = np.zeros(n + 3, bool)
    first[starts] = True
    begin = kind != SPACE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | first[1:]
    # a part that begins with an apostrophe may take letters after it
    q = np.flatnonzero(begin & (flat == 0x27))
    if len(q):
        q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
        a, b = flat[q + 1], np.where(first[q + 2], 0, flat[q + 2])
        size = np.where(np.isin(a, list(b"stmd")), 2, np.where(((b == 0x65) & ((a == 0x72) | (a == 0x76))) | ((a == 0x6C) & (b == 0x6C)), 3, 0))
        q, size = q[size > 0], size[size > 0]
        begin[q + 1] = False
        begin[q + size] = (kind[q + size] == LETTER) | begin[q + size]
    kept = np.flatnonzero(kind[:n] != SPACE)
    at = np.flatnonzero(begin[:n])
    offsets = np.append(np.flatnonzero(begin[kept]), len(kept)).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat[kept]))
    return parts, np.searchsorted(at, starts), np.unique(np.searchsorted(starts, strange, side="right") - 1)
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        about = json.loads(spec)
        self.wide = max(self.library.get_vocab_size(), 1) > 65_536
        self.kind, self.letter = ("<u4", "I") if self.wide else ("<u2", "H")
        steps = (about.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = [x.get("type") for x in (about.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            normal == ["NFC", "Replace", "Lowercase"]
            and steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in about["added_tokens"])
        )
        self.added = tuple(t["content"] for t in about["added_tokens"])
        self.letters = {k: v for k, v in byte_letters().items() if chr(k) != v}
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.parts = Memo(self._part, 800_000)
        self.words = Memo(self._word, 200_000)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.letter, [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if PLAIN_WORD.fullmatch(word) and not (self.special and self.special.search(word)):
            low = word.lower()
            return self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, PARTS.findall(low)))
        return self._whole(word) if word else b""

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for null."""
        if not text:
            return np.zeros(0, self.kind)
        if not self.by_word:
            return np.frombuffer(self._whole(text), self.kind)
        words = [w for w in SPACES.split(text) if w] if CONTROLS.search(text) else text.split()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), self.kind)


    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin, with the end as last."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        if not self.by_word or not len(texts):
            return joined([self.ids(t) for t in texts.to_pylist()], self.kind)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        parts, starts, strange = byte_parts(data, offsets - offsets[0])
        coded = parts.dictionary_encode()
        found = list(map(self.parts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ids = np.frombuffer(b"".join(found), self.kind)
        n = np.fromiter(map(len, found), np.int32, len(found)) // ids.itemsize
        which = coded.indices.to_numpy()
        count = n[which]
        ends = np.cumsum(count, dtype=np.int64)
        at = np.repeat((np.cumsum(n, dtype=np.int64) - n)[which] - ends + count, count)
        at += np.arange(len(at))
        ids, starts = ids[at], np.append(0, ends)[starts]
        if self.special:
            strange = np.union1d(strange, np.flatnonzero(pc.match_substring_regex(texts, self.special.pattern).to_numpy(zero_copy_only=False)))
        if not len(strange):
            return ids, starts
        each = np.split(ids, starts[1:-1])
        for i in strange.tolist():
            each[i] = self.ids(texts[i].as_py())
        return joined(each, self.kind)

    def closed(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with an id more at each text's end, as unsigned 32-bit integers."""
        ids, starts = self.batch(texts)
        n = np.diff(starts)
        out = np.full(len(ids) + len(n), end, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        return out, starts + np.arange(len(starts))


def joined(each: list[np.ndarray], kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*each, np.zeros(0, kind)]), np.append(0, np.cumsum([len(i) for i in each], dtype=np.int64)).astype(np.int64)


def encoder(spec: str) -> Encoder:
    return kept(("encoder", hash(spec)), lambda: Encoder(spec))


def read_spec(path: str) -> str:
    """A tokenizer file of the driver; its text goes to the executors, which need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
