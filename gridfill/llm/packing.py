"""Best-fit packing of tokenised documents into fixed-length sequences (best-two-fit).

`tokenise` cuts each document's ids into pieces of at most `capacity`; `pack` deals the pieces to partitions by a hash of
(document, piece, ids) and packs each partition in blocks of bounded size. Dealing is even whatever the documents' keys or
sources are; only equal pieces of rows that share an id go together. Each block leaves at most one sequence that is not
well filled, so nothing is lost by not packing globally.

Defined results: a null text is an empty one, its only piece is the end id. Null or repeated ids are kept: every row is
a document of its own. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.llm.words import WordTable, joined, slices

#: Bytes of text for which one partition is planned, bytes of ids that are packed at once, and the most partitions.
PART_BYTES, BLOCK_BYTES, MAX_PARTS = 32 << 20, 64 << 20, 20_000
#: The split of the byte-level pre-tokenizer. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the byte-level pre-tokenizer sees it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


class TextIds:
    """Ids (little-endian unsigned 32-bit) of texts, from the ids of their space-separated pieces.

    The pre-tokenizer gives a space to the word after it and never joins characters across it, so a piece with its space
    has the same ids wherever it stands. Only runs of white space that hold a space are cut by what follows
    them; a text with such a run is encoded as a whole.
    """

    runs = f" [{WHITE}]|[{WHITE}] "

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _by_rank(json.loads(vocabulary))
        self.table = WordTable(lambda words: [pa.array([self.bytes(f" {w}") for w in words], pa.binary())])

    def bytes(self, text: str) -> bytes:
        if not self.ranked or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranked(text)).tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, self.runs).to_pylist()
        lists = pc.split_pattern(pc.if_else(pa.array(whole, pa.bool_()), "", texts), " ")
        rest = pc.list_slice(lists, 1)
        tails = joined(self.table.of(pc.list_flatten(rest))[0], rest, b"").to_pylist()
        firsts = pc.list_element(lists, 0).to_pylist()
        return [self.bytes(t.as_py()) if w else self.bytes(f) + x for t, w, f, x in zip(texts, whole, firsts, tails, strict=True)]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def _by_rank(spec: dict):
    """A faster encoder of short chunks, if ids follow the order of the merges (then both give the same ids), else None."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    ids, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    plain = plain and not (model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout"))
    if not plain or any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte[c] for c in token): i for token, i in ids.items() if token not in special}
    return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_WORKER: dict[int, TextIds] = {}


def _text_ids(vocabulary: str) -> TextIds:
    """One table per Python worker; workers are used again by later tasks."""
    key = hash(vocabulary)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = TextIds(vocabulary)
    return _WORKER[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first, which holds the rest."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): one row per piece, ids as little-endian unsigned 32-bit numbers.

    `vocabulary` is the text of a tokenizers JSON file; it travels as a broadcast of that file's size.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _text_ids(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = ([], [], [], [], [])
            for row, ids in enumerate(table.encode(batch.column(1))):
                ids += end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(out, (row, piece, start, length, ids[4 * start : 4 * (start + length)]), strict=True):
                        column.append(x)
            yield _pieces(batch.column(0), out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def _pieces(keys: pa.Array, out: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = [keys.take(pa.array(out[0], pa.int64())), *(pa.array(x, k) for x, k in zip(out[1:], kinds, strict=True))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])


def two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-two-fit: (sequence, offset) per piece and the number of sequences.

    A sequence is filled greedily, longest piece that fits first. If a gap stays, its smallest piece gives way to the two
    unpacked pieces whose sum comes closest to gap plus that piece, if they fill it more tightly.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    left = np.bincount(lengths, minlength=capacity + 1)
    tail = np.searchsorted(-sizes, -np.arange(capacity + 1), side="right")  # pieces of a length are taken from its end
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))  # longest length at hand up to x
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(v: int) -> None:
        left[v] -= 1
        if not left[v]:
            below[v : np.searchsorted(below, v, side="right")] = below[v - 1]

    def give(v: int) -> None:
        left[v] += 1
        if left[v] == 1:
            below[v : v + np.searchsorted(below[v:], v, side="left")] = v

    made = 0
    while below[capacity]:
        chosen, gap = [], capacity
        while x := int(below[gap]):
            take(x)
            chosen.append(x)
            gap -= x
        if gap and len(chosen) > 1:
            last = chosen[-1]
            room = gap + last
            a = np.flatnonzero(left[: room])
            if len(a):
                b = below[room - a]
                b = np.where((b == a) & (left[a] < 2), below[a - 1], b)  # one piece is not two
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > last:
                    take(int(a[best]))
                    take(int(b[best]))
                    give(last)
                    chosen[-1:] = [int(a[best]), int(b[best])]
        at = 0
        for x in chosen:
            tail[x] -= 1
            bins[tail[x]], offsets[tail[x]] = made, at
            at += x
        made += 1
    place, offset = np.empty_like(bins), np.empty_like(offsets)
    place[order], offset[order] = bins, offsets
    return place, offset, made


def pack(pieces: DataFrame, capacity: int, parts: int) -> DataFrame:
    """`pieces` (doc_id, piece, start, length, ids) with sequence_id and offset, sequences in order.

    One shuffle, dealt by a hash of (doc_id, piece, start, ids), so a hot document or source is spread, and so are rows with
    one id or none. A partition is streamed: only a block of BLOCK_BYTES is held. Rows are sorted first: a task that runs
    again gives the same sequences.
    """
    capacity = int(capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                made, out = _packed(held, capacity, made)
                yield from out
                held, size = [], 0
        if held:
            yield from _packed(held, capacity, made)[1]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.repartition(parts, F.xxhash64("doc_id", "piece", "start", F.crc32("ids"))).sortWithinPartitions("doc_id", "piece", F.crc32("ids"))
    return dealt.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def _packed(held: list[pa.RecordBatch], capacity: int, made: int) -> tuple[int, list[pa.RecordBatch]]:
    table = pa.Table.from_batches(held)
    place, offset, n = two_fit(table.column("length").to_numpy(), capacity)
    table = table.append_column("sequence_id", pa.array(place + made)).append_column("offset", pa.array(offset))
    rows = np.lexsort((offset, place))
    step = max(1, len(rows) // (1 + table.nbytes // (BLOCK_BYTES // 8)))
    return made + n, [b for i in range(0, len(rows), step) for b in table.take(pa.array(rows[i : i + step])).combine_chunks().to_batches()]


def best_fit_packing(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece of every document in its sequence."""
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(MAX_PARTS, 1 + n_bytes // PART_BYTES)
    return pack(tokenise(docs, vocabulary, end_id, capacity, key, text), capacity, parts)
