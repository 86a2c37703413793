"""Byte-pair encoding with word ends, and decoding, by segment trees over adjacent pair ranks.

Every word has a segment tree whose leaves are (rank, position) of its adjacent symbol pairs: the root is the leftmost pair
of lowest rank. A merge updates three leaves and their ancestors, O(log n), until no pair of the word can merge. The
trees of all words of a batch are one array, so each step is a handful of array operations for all of them.

Words are found as the vocabulary's own rules say: special tokens are cut from the raw text, the rest is normalised (NFC, lower
case), white space is dropped and letters, single digits and other runs are separated. All of this is local to a run
without white space, so each distinct run is encoded once per worker and batch (see `words`).

Defined results: a null text is an empty one, with no ids. Each row is encoded by itself; null and repeated keys stay.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridfill.llm.packing import WHITE, byte_letters
from gridfill.llm.words import WordTable, joined, slices

NONE = np.int64(1) << 62
#: Leaves of the trees that are held at once.
LEAVES = 1 << 17


class Merges:
    """The merge rules as sorted pair keys, for look-up of many pairs at once."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0) & (a >= 0), self.ranks[at], -1)


def merge_all(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Words given as one array of symbols and their sizes; the same after all merges, lowest rank first, leftmost first
    among equals."""
    starts = np.cumsum(sizes) - sizes
    widths = np.where(sizes > 1, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 0)
    out, counts = symbols.copy(), sizes.copy()
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        step = max(1, LEAVES // int(width))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            inside = np.arange(width) < sizes[part, None]
            merged = np.full(inside.shape, -1, np.int64)
            merged[inside] = symbols[np.repeat(starts[part], sizes[part]) + np.nonzero(inside)[1]]
            merged = _merge_trees(merged, sizes[part], merges)
            kept = merged >= 0
            counts[part] = n = kept.sum(axis=1)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(starts[part], n) + within] = merged[kept]
    within = np.arange(len(out)) - np.repeat(starts, sizes)
    return out[within < np.repeat(counts, sizes)], counts


def _merge_trees(words: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Rows of symbols, -1 behind a word's end; the same with -1 wherever a symbol was merged into another."""
    n, width = words.shape
    symbol = np.concatenate([words, np.full((n, 1), -1, np.int64)], axis=1)  # one more: what stands after the last symbol
    follow = np.minimum(np.arange(1, width + 2), lengths[:, None])
    follow = np.where(follow >= lengths[:, None], width, follow)
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NONE)
    rank = merges.rank(symbol[:, :-1], symbol[:, 1:])
    tree[:, width:] = np.where(rank >= 0, rank << 32 | np.arange(width), NONE)
    half = width
    while half > 1:  # parents are the lower of two children
        half //= 2
        tree[:, half : 2 * half] = tree[:, 2 * half : 4 * half].reshape(n, half, 2).min(axis=2)

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] < NONE)
    while len(live):
        root = tree[live, 1]
        at = root & 0xFFFFFFFF
        gone = follow[live, at]
        after = follow[live, gone]
        symbol[live, at] = merges.made[root >> 32]
        symbol[live, gone] = -1
        follow[live, at] = after
        before[live, after] = at
        put(live, gone, np.full(len(live), NONE))
        for left, right in ((at, after), (before[live, at], at)):
            known = left >= 0
            rows, left, right = live[known], left[known], right[known]
            rank = merges.rank(symbol[rows, left], np.where(right < width, symbol[rows, right], -1))
            put(rows, left, np.where(rank >= 0, rank << 32 | left, NONE))
        live = live[tree[live, 1] < NONE]
    return symbol[:, :-1]


class WordEndCoder:
    """Encoder and decoder for a tokenizers file of this kind (NFC, lower case, word ends)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix, self.merges = model.get("end_of_word_suffix") or "", Merges(model)
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in letters], np.int64)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.added, self.odd = added, any("<|" not in t for t in added)
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.tokens = pa.array([f" {tokens.get(i, '')}" for i in range(max(tokens) + 1)])
        self.numerals = pa.array([f" {i}" for i in range(len(self.tokens))])
        longest = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest or ["(?!)"])) + ")").split
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.tokenizer, self.byte = Tokenizer.from_str(vocabulary), {c: b for b, c in enumerate(letters)}
        self.table = WordTable(self.columns)

    def words(self, run: str) -> list[str]:
        """Words of a run that has neither white space nor special tokens."""
        if run.isascii():
            return self.pieces(run.lower())
        if any(unicodedata.category(c) == "Cn" for c in run):  # newer than Python's tables: the vocabulary's own rules
            words = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run))
            return [bytes(self.byte[c] for c in w).decode() for w, _ in words]
        # Lower case letter by letter: at the end of a word, too, sigma has its usual form.
        return self.pieces(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())

    def ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs in one array, and how many each has."""
        parts, special = [], []  # words and special tokens of all runs, and the id of each special one
        sizes = np.empty(len(runs), np.int64)
        for i, run in enumerate(runs):
            n = len(parts)
            if "<|" in run or self.odd:
                for part in self.cut(run):
                    if part in self.added:
                        special.append((len(parts), self.added[part]))
                        parts.append(" ")
                    else:
                        parts += self.words(part)
            else:
                parts += self.words(run)
            sizes[i] = len(parts) - n
        coded = [w.encode() for w in parts]
        lengths = np.array([len(w) for w in coded], np.int64)
        code = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[code]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[code[ends]]
        for part, i in special:
            symbols[ends[part]] = i
        flat, counts = merge_all(symbols, lengths, self.merges)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, np.diff(upto)

    def columns(self, runs: list[str]) -> list[pa.Array]:
        """Per run: number of ids, ids and tokens as text with a space before each."""
        if not runs:
            return [pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string())]
        flat, counts = self.ids(runs)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        at = pa.array(flat)
        texts = (pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(at)), "") for names in (self.numerals, self.tokens))
        return [pa.array(counts), *texts]

    def code(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each text: number of ids, ids joined by a space, decoded text. Decoding joins the ids' tokens by a space."""
        texts = pc.replace_substring(texts, "\n", " ")
        if pc.any(pc.match_substring_regex(texts, SPACES), min_count=0).as_py():
            texts = pc.replace_substring_regex(texts, SPACES, " ")
        runs = pc.split_pattern(texts, " ")
        counts, ids, tokens = self.table.of(pc.list_flatten(runs))
        parent = pc.list_parent_indices(runs).to_numpy()
        n = np.bincount(parent, weights=counts.to_numpy(), minlength=len(texts)).astype(np.int64)
        return pa.array(n), *(pc.utf8_slice_codeunits(joined(x, runs, ""), 1) for x in (ids, tokens))


SPACES = "[" + WHITE.replace(" ", "") + "]"
_WORKER: dict[int, WordEndCoder] = {}


def _coder(vocabulary: str) -> WordEndCoder:
    key = hash(vocabulary)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordEndCoder(vocabulary)
    return _WORKER[key]


def with_texts(n: pa.Array, ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    """The outputs themselves."""
    return [n, ids, decoded]


def with_digests(n: pa.Array, ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    """SHA-256 of the outputs, made where they are, so that only digests leave the task."""
    return [n, *(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column]) for column in (ids, decoded))]


def encode_decode(docs: DataFrame, vocabulary: str, finish: Callable = with_texts, names: tuple[str, str] = ("ids", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids in decimal, joined by a space, and the text that they decode to.

    No shuffle. `finish` maps the three output columns of a batch to what is returned, under `names`.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(*coder.code(batch.column(1)))], ["doc_id", "n_tokens", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {names[0]} string, {names[1]} string")
