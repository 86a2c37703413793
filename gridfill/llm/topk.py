"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Vectors are dealt to shelves by hash and cut into blocks there; a block holds one sorted list of values per component. For a query,
all lists of a block are read from their best end, a stretch at a time. What was read gives every vector a lower and an upper bound of
its score (a component not read yet lies between the list's end and the place that was reached). Vectors whose upper bound is
below the k-th lower bound are outsiders. When few others are left, or all is read, their scores are resolved and the k best stay.
Queries are sent to every shelf, after its vectors, and pass it a few at a time. Shelves grow with the table, so copies of the queries stay
in proportion to it up to some 8 million vectors of 64 numbers. Nothing is joined, so nothing can be broadcast: Catalyst knows neither how
often a query is sent nor how large its row is. Only k rows per query and task are shuffled.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. Repeated rows
(same id and vector) count once; rows with the query's id are no candidates. Shorter vectors are filled with zeros. Ties go to
the smaller id. Fewer than k candidates give fewer rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfill.session import materialize

#: Vectors of a block and queries that meet it at once; the first stretch and the rows that are resolved at once, as parts of a block.
BLOCK, QUERIES, STRETCHES = 4096, 256, (8, 64)
#: Numbers in a block of wide vectors; shelves while they can still grow; blocks of the largest shelf.
NUMBERS, SHELVES, HELD = 2**18, 64, 32


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), rows that take part only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite)
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v")).distinct()


def _pieces(rows: DataFrame) -> DataFrame:
    """(ids, width, data): up to QUERIES vectors of similar width in a row, as little-endian numbers of 16, 32 or 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            starts, order, at = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable"), 0
            out: tuple[list, ...] = ([], [], [])
            while at < len(order):
                width = int(lengths[order[at]])
                some = order[at : at + max(1, min(QUERIES, NUMBERS // 16 // width))]
                at += len(some)
                there = np.arange(width) < lengths[some][:, None]
                data = np.zeros(there.shape, "<i8")
                data[there] = values[(starts[some][:, None] + np.arange(width))[there]]
                size = next(x for x in (2, 4, 8) if -(2 ** (8 * x - 1)) <= int(data.min()) and int(data.max()) < 2 ** (8 * x - 1))
                for column, x in zip(out, (ids[some].tobytes(), width, data.astype(f"<i{size}").tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["ids", "width", "data"])

    return rows.select("vec_id", "v").mapInArrow(run, "ids binary, width bigint, data binary")


def _stacked(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, data) of pieces together, ids in order."""
    ids = np.concatenate([x for x, _ in pieces])
    data = np.zeros((len(ids), max(x.shape[1] for _, x in pieces)), np.result_type(*(x.dtype for _, x in pieces)))
    at = 0
    for _, x in pieces:
        data[at : at + len(x), : x.shape[1]] = x
        at += len(x)
    order = np.argsort(ids, kind="stable")
    return ids[order], data[order]


class Lists:
    """The sorted lists of a block: places of all rows in each, and the values down to a depth.

    What a depth shows is the same for all queries that read a list from the same end, so bounds of many queries are two
    products: of the query's positive parts with the lists read from the top, and of its negative parts from the bottom.
    """

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        order = np.argsort(data, axis=0, kind="stable")
        self.place = np.empty(data.shape, np.int32)  # from the bottom
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        self.values = np.take_along_axis(data, order, axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper): for [positive, negative] parts of a query, what each row adds at least and at most after `depth`
        rows of every list were read. Unread values lie between the place reached and the list's other end."""
        n, values = len(self.data), self.values
        top, bottom = self.place >= n - depth, self.place < depth
        lower = np.concatenate([np.where(top, self.data, values[0]), np.where(bottom, self.data, values[-1])], axis=1)
        upper = np.concatenate([np.where(top, self.data, values[n - depth]), np.where(bottom, self.data, values[depth - 1])], axis=1)
        return lower.T, upper.T


def best(lists: Lists, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the rows and scores of its k best rows with scores of at least its bar; equal scores in row order.

    `own` marks rows that are no candidates. All lists are read in stretches; a query ends when few rows are left whose upper
    bound reaches the k-th lower bound, and their scores are resolved.
    """
    n = len(lists.data)
    parts = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    out: list = [None] * len(queries)
    open_ = np.arange(len(queries))
    depth = min(n, max(k, n // STRETCHES[0]))
    while len(open_):
        lower, upper = (parts[open_] @ b for b in lists.bounds(depth))
        lower = np.where(own[open_], -np.inf, lower)
        bar = np.maximum(bars[open_], np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)])
        alive = (upper >= bar[:, None]) & ~own[open_]
        done = (alive.sum(axis=1) <= max(4 * k, n // STRETCHES[1])) | (depth == n)
        for i in np.flatnonzero(done):
            q = open_[i]
            rows = np.flatnonzero(alive[i])
            scores = lists.data[rows] @ queries[q]
            rows, scores = rows[scores >= bars[q]], scores[scores >= bars[q]]
            order = np.argsort(-scores, kind="stable")[:k]
            out[q] = rows[order], scores[order]
        open_, depth = open_[~done], min(n, 2 * depth)
    return out


def _numbers(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, f"<i{len(data) // (n * width)}").reshape(n, width)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The smallest kind of number that holds all sums of products exactly."""
    most = a.shape[1] * np.prod([max(float(x.max(initial=0)), -float(x.min(initial=0))) for x in (a, b)])
    return np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.longdouble


class Block:
    """Vectors in the order of their ids; their lists, in the smallest kind of number that the queries so far allowed."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.data = _stacked(pieces)
        self.lists: Lists | None = None

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        asked = np.zeros((len(ids), self.data.shape[1]), queries.dtype)  # what one side lacks is zero
        width = min(asked.shape[1], queries.shape[1])
        asked[:, :width] = queries[:, :width]
        kind = _exact(asked, self.data)
        if self.lists is None or self.lists.data.dtype.itemsize < np.dtype(kind).itemsize:
            self.lists = Lists(self.data.astype(kind))
        return best(self.lists, asked.astype(self.lists.data.dtype), ids[:, None] == self.ids, k, bars)


def _cut(pieces: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Pieces of a block each, wide ones first."""
    some, n = [], 0
    for piece in sorted(pieces, key=lambda x: -x[1].shape[1]):
        if some and n + len(piece[0]) > min(BLOCK, NUMBERS // some[0][1].shape[1]):
            yield some
            some, n = [], 0
        some.append(piece)
        n += len(piece[0])
    if some:
        yield some


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `quantised` that are queries, against all others."""
    rows = materialize(rows)
    n, numbers = rows.select(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = 1 + max(n // BLOCK, numbers // NUMBERS)
    shelves = -(-blocks // max(1, min(HELD, blocks // SHELVES)))
    held = _pieces(rows).select(F.pmod(F.xxhash64("ids"), F.lit(shelves)).cast("int").alias("shelf"), F.lit(False).alias("asks"), "ids", "width", "data")
    # A stated query set against all vectors, shelf by shelf.
    sent = _pieces(rows.filter(is_query)).select(F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))).alias("shelf"), F.lit(True).alias("asks"), "ids", "width", "data")

    def met(blocks: list[Block], pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, queries = _stacked(pieces)
        bars = np.full(len(ids), -np.inf, np.longdouble)  # k-th best score of a query so far: no later block needs less
        found: list = [(block.ids[:0], ids[:0]) for block in blocks[:1] for _ in ids]
        for block in blocks:
            low = bars.astype(float)
            low = np.where(low > bars, np.nextafter(low, -np.inf), low)
            for i, (at, scores) in enumerate(block.best(ids, queries, k, low)):
                if len(at):
                    near, scores = np.concatenate([found[i][0], block.ids[at]]), np.concatenate([found[i][1], scores])
                    order = np.lexsort((near, -scores))[:k]
                    found[i] = near[order], scores[order]
                    if len(order) == k:
                        bars[i] = found[i][1][-1]
        out: tuple[list, ...] = ([], [], [])
        for i, (near, scores) in zip(ids.tolist(), found, strict=bool(blocks)):
            out[0].extend([i] * len(near))
            out[1].extend(near.tolist())
            out[2].extend(int(s) for s in scores)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for _, shelf in groupby(parts, itemgetter(0)):
            blocks: list[Block] = []
            for asks, some in groupby(shelf, itemgetter(1)):
                if not asks:
                    blocks = [Block(x) for x in _cut([_numbers(*x[2:]) for x in some])]
                    continue
                pieces: list[tuple[np.ndarray, np.ndarray]] = []
                for x in some:
                    piece = _numbers(*x[2:])
                    if pieces and sum(len(ids) for ids, _ in pieces) + len(piece[0]) > QUERIES:
                        yield met(blocks, pieces)
                        pieces = []
                    pieces.append(piece)
                yield met(blocks, pieces)

    dealt = held.unionByName(sent).repartitionById(shelves, "shelf").sortWithinPartitions("shelf", "asks")
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
