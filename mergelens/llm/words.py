"""Texts cut into words by classes of bytes, a whole batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

INSIDE, BETWEEN, END = range(3)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def kinds(between, end=()) -> np.ndarray:
    """The class of each byte: part of a word, between words, or the end of a piece."""
    out = np.full(256, INSIDE, np.uint8)
    out[list(between)] = BETWEEN
    out[list(end)] = END
    return out


def cut(texts: pa.Array, kind: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of all texts, A to Z in lower case, one after another; where each text's words begin, with the end as last; and a number
    for each word that grows where a piece or a text ends. Null texts have no words."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    classes = kind[data]
    inside = classes == INSIDE
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    at = np.flatnonzero(begin)
    ends = np.append(np.flatnonzero(begin[inside]), int(inside.sum())).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]]))
    pieces = np.cumsum((classes == END) | first[:-1])[at]
    return words, np.searchsorted(at, offsets), pieces
