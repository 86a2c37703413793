"""Outputs per distinct word: work that depends on a word alone is done once per word and batch, then dealt back by Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; words that a Python worker remembers.
SLICE_BYTES, KNOWN_WORDS = 8 << 20, 1_000_000


class WordTable:
    """Columns of outputs by word. `make(words)` gives one Arrow array per column; words beyond the limit are made again."""

    def __init__(self, make: Callable[[list[str]], list[pa.Array]], limit: int = KNOWN_WORDS):
        self.make, self.limit = make, limit
        self.known, self.pool = pa.array([], pa.string()), make([])

    def of(self, words: pa.Array) -> list[pa.Array]:
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(at.is_null())
        pool = self.pool
        if len(fresh):
            pool = [pa.concat_arrays([a, b]) for a, b in zip(self.pool, self.make(fresh.to_pylist()), strict=True)]
            rank = pc.subtract(pc.cumulative_sum(pc.cast(at.is_null(), pa.int32())), 1 - len(self.known))
            at = pc.if_else(at.is_null(), pc.cast(rank, pa.int32()), at)
            if len(self.known) + len(fresh) <= self.limit:
                self.known, self.pool = pa.concat_arrays([self.known, fresh]), pool
        return [column.take(at).take(coded.indices) for column in pool]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def joined(words: pa.Array, lists: pa.ListArray, between: str | bytes) -> pa.Array:
    """One text per list of `lists`, from outputs of the words in them, in order."""
    offsets = lists.offsets
    offsets = pc.subtract(offsets, offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), between)
