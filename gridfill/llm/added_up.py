"""Element-wise sums of long arrays over all tasks, in chunks: a task sends each chunk it touched once, a chunk's copies are
added one by one where they meet. Memory is one chunk, whatever the number of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of a chunk.
CHUNK = 1 << 16
SCHEMA = "name string, chunk bigint, data binary"


def sent(name: str, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the chunks of `totals` that are not all zero."""
    for at in range(0, len(totals), CHUNK):
        part = totals[at : at + CHUNK]
        if part.any():
            packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at // CHUNK], pa.int64()), pa.array([packed], pa.binary())], ["name", "chunk", "data"])


def sent_few(name: str, places: np.ndarray, numbers: np.ndarray, size: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The same for an array of `size` that is zero but for `numbers` at the ascending `places`."""
    chunks = places // CHUNK
    starts = np.flatnonzero(np.diff(chunks, prepend=-1))
    rows: tuple[list, list] = ([], [])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True):
        chunk = int(chunks[a])
        part = np.zeros(min(CHUNK, size - chunk * CHUNK), kind)
        part[places[a:b] - chunk * CHUNK] = numbers[a:b]
        rows[0].append(chunk)
        rows[1].append(pa.compress(part.tobytes(), codec="zstd", asbytes=True))
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0])), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["name", "chunk", "data"])


def summed(parts: DataFrame, size: int, kind: type, finish: Callable[[np.ndarray], bytes], most: int | None = None) -> DataFrame:
    """(name, chunk, data): `finish` of each chunk's sums. `size` is the length of the arrays; sums stop at `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]], pa.int64()), pa.array([finish(total)], pa.binary())], ["name", "chunk", "data"])

        for batch in batches:
            for name, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                length = min(CHUNK, size - chunk * CHUNK)
                part = np.frombuffer(pa.decompress(data, length * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
                if held != (name, chunk):
                    if held:
                        yield row()
                    held, total = (name, chunk), part.astype(np.int64)
                else:
                    total += part
                if most is not None:
                    np.minimum(total, most, out=total)
        if held:
            yield row()

    return parts.repartition("name", "chunk").sortWithinPartitions("name", "chunk").mapInArrow(run, SCHEMA)
