"""Words of many texts at once, cut by bytes: a text's words are runs of bytes of kind WORD."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

WORD, GAP, STOP = 0, 1, 2


def kinds(gaps: Iterable[int], stops: Iterable[int] = ()) -> np.ndarray:
    """A kind for each byte: words end at gaps, pieces end at stops, all other bytes are parts of words."""
    table = np.full(256, WORD, np.uint8)
    table[list(gaps)] = GAP
    table[list(stops)] = STOP
    return table


def cut(texts: pa.Array, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words, row of each, whether the next word stands in the same piece of the same row) of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = table[data]
    word = kind == WORD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    ends_at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=ends_at[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(data[word].tobytes()))
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == STOP), starts)
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    return words, row, goes_on
