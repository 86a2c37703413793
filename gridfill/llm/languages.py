"""Language identification by error-correcting output codes: every language has a codeword, every bit of it a binary classifier
over hashed n-grams (two to five bytes, the ends of words included), and the language whose codeword loses least wins.

A bit's classifier weighs an n-gram by the log-odds of meeting it in the languages with that bit set against those without, each language
counting alike. n-grams are counted over the whole texts of all rows to learn from (one part of them, by hash, only calibrates), so
nothing is sampled there; the counts have a fixed size per language. Of the calibrating part, at most ROWS distinct texts (lowest hash) give
each bit its slope and its weight: the worse a bit tells its sides apart, the less its loss counts. A text is
`ambiguous` when its bits differ from the codeword in more places than the code corrects, or when the best
two languages are close. The score is the share of exp(-loss) that the winner has.

Up to LISTED languages the code is exhaustive (each split of the languages is a bit), beyond it codewords are drawn with a large least
distance. Languages are listed on the driver, which also holds the model: 65,536 numbers per bit.

Defined results: `und`, score 0 and ambiguous for a null text, one without a letter, or when there is nothing to learn from. Null languages
teach nothing. One language only is always the answer, with score 1. Texts of equal loss get the first language in
order of name. Repeated rows get a row each and count each time in the n-grams. Other columns are kept by `predicted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.llm import added_up
from gridfill.llm.byte_words import cut, kinds

#: Hashed n-grams, as a power of two; their sizes.
BITS, SIZES = 16, (2, 3, 4, 5)
#: Rows that calibrate; bytes of text cut at once.
ROWS, SLICE = 10_000, 8 << 20
#: Languages up to which the code is exhaustive; bits and draws of a larger code.
LISTED, DRAWN_BITS, DRAWS = 5, 31, 200
#: Least score of a clear answer.
CLEAR = 0.7
UNKNOWN = "und"
#: Words are runs of letters and of bytes outside ASCII.
KINDS = kinds(b for b in range(128) if not chr(b).isalpha())


class Grams:
    """Distinct words of some texts and the hashed n-grams of each."""

    def __init__(self, texts: pa.Array):
        words, self.row, _ = cut(pc.utf8_lower(texts), KINDS)
        coded = words.dictionary_encode()
        self.word, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        text = b" " + b" ".join(x.encode() for x in self.words.to_pylist()) + b" "
        data = np.frombuffer(text, np.uint8)
        blank = data == 32
        owner = np.cumsum(blank) - 1  # the word that a byte belongs to, a blank to the word after it
        places, owners = [], []
        for n in SIZES:
            if len(data) < n:
                continue
            inner = np.zeros(len(data) - n + 1, bool)
            key = np.zeros(len(inner), np.uint64)
            for i in range(n):
                key |= data[i : len(data) - n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
                if 0 < i < n - 1:
                    inner |= blank[i : len(data) - n + 1 + i]
            fits = ~inner & ~(blank[: len(inner)] & blank[n - 1 :])
            key = (key[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            places.append((key >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[: len(inner)][fits])
        self.place = np.concatenate(places) if places else np.empty(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.empty(0, np.int64)

    def letters(self) -> np.ndarray:
        """Whether each word has a letter."""
        return np.fromiter((any(c.isalpha() for c in x) for x in self.words.to_pylist()), bool, len(self.words))

    def counted(self, of_word: np.ndarray) -> np.ndarray:
        """How often each hashed n-gram stands in words that occur so often."""
        return np.bincount(self.place, of_word[self.owner], 1 << BITS)

    def summed(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words x bits: sums of the weights of each word's n-grams, their number)."""
        n = len(self.words)
        total = np.stack([np.bincount(self.owner, w[self.place], n) for w in weights], axis=1) if len(weights) else np.zeros((n, 0))
        return total, np.bincount(self.owner, minlength=n)


def _texts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of about SLICE bytes; a longer text is a run of its own."""
    texts = pc.fill_null(column, "")
    at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE
    starts = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else []
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield int(a), texts.slice(a, b - a)


def code(n: int) -> np.ndarray:
    """n codewords of +1 and -1."""
    if n <= LISTED:
        splits = np.arange(1, 1 << max(0, n - 1))  # the first language is always on the other side
        return np.where((splits[None, :] >> np.arange(n - 1, -1, -1)[:, None]) & 1, 1, -1)
    size = max(DRAWN_BITS, 4 * int(n).bit_length())
    rng, words = np.random.default_rng(n), np.empty((0, size), int)
    for _ in range(n):
        drawn = rng.choice((-1, 1), (DRAWS, size))
        near = (drawn[:, None, :] != words[None]).sum(2).min(1) if len(words) else np.zeros(DRAWS)
        words = np.concatenate([words, drawn[near.argmax()][None]])
    split = np.abs(words.sum(0)) < n  # a bit that is the same for all tells nothing
    return words[:, split]


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x hashed n-grams
    slope: np.ndarray
    trust: np.ndarray

    def margins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits, whether a text has a letter): evidence for each bit, per square root of the number of n-grams."""
        margin, lettered = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts), bool)
        for first, some in _texts(texts):
            g = Grams(some)
            total, n = g.summed(self.weights)
            rows = first + g.row
            size = np.bincount(rows, n[g.word], len(texts))
            for b in range(total.shape[1]):
                margin[:, b] += np.bincount(rows, total[g.word, b], len(texts)) / np.sqrt(np.maximum(size, 1))
            lettered |= np.bincount(rows, g.letters()[g.word], len(texts)) > 0
        return margin, lettered

    def decide(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, ambiguous) by the weighted logistic loss of each codeword."""
        m = margin * self.slope
        ahead, behind = np.logaddexp(0, -m) @ (self.trust * (self.code > 0)).T, np.logaddexp(0, m) @ (self.trust * (self.code < 0)).T
        loss = ahead + behind
        best = loss.argmin(1)
        score = 1 / np.exp(loss.min(1, keepdims=True) - loss).sum(1)
        apart = (self.code[:, None] != self.code[None]).sum(2) + np.eye(len(self.code), dtype=int) * 10**6
        corrects = (min(apart.min(), self.code.shape[1] + 1) - 1) // 2
        wrong = (np.where(margin > 0, 1, -1) != self.code[best]).sum(1)
        return best, score, (score < CLEAR) | (wrong > corrects)


def _counts(rows: DataFrame) -> dict[tuple[str, bool], np.ndarray]:
    """n-gram counts by (language, whether the rows calibrate) of rows (lang, later, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            langs, later = batch.column(0).dictionary_encode(), batch.column(1).to_numpy(zero_copy_only=False)
            group = langs.indices.to_numpy(zero_copy_only=False) * 2 + later
            for first, texts in _texts(batch.column(2)):
                g = Grams(texts)
                groups = group[first : first + len(texts)][g.row]
                for k in np.unique(groups):
                    key = (langs.dictionary[int(k) // 2].as_py(), bool(k % 2))
                    found = g.counted(np.bincount(g.word[groups == k], minlength=len(g.words))).astype(np.int64)
                    totals[key] = totals[key] + found if key in totals else found
        for (lang, late), total in totals.items():
            yield from added_up.sent(f"{int(late)}{lang}", total)

    parts = rows.mapInArrow(run, added_up.SCHEMA)
    out = {}
    for r in added_up.summed(parts, 1 << BITS, np.int64, lambda total: total.tobytes()).toLocalIterator():
        out[r["name"][1:], r["name"][0] == "1"] = np.frombuffer(r["data"], np.int64)  # one chunk holds them all
    return out


def _weights(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """bits x hashed n-grams: log-odds, from languages x n-grams counts."""
    rate = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    return np.stack([np.log(rate[words[:, b] > 0].mean(0) / rate[words[:, b] < 0].mean(0)) for b in range(words.shape[1])]).astype(np.float32) if words.shape[1] else np.zeros((0, 1 << BITS), np.float32)


def learn(docs: DataFrame, calibrates: Column, rows: int = ROWS, text: str = "text", lang: str = "lang") -> Model | None:
    """The model of these rows' languages. Rows for which `calibrates` holds set slopes and trust, and count in the end too."""
    taught = docs.select(F.col(lang).cast("string").alias("lang"), F.coalesce(calibrates, F.lit(False)).alias("later"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("lang is not null")
    counts = _counts(taught)
    names = tuple(sorted({name for name, _ in counts}))
    if not names:
        return None
    words, none = code(len(names)), np.zeros(1 << BITS, np.int64)
    by = {late: np.stack([counts.get((name, late), none) for name in names]) for late in (False, True)}
    bits = words.shape[1]
    first = Model(names, words, _weights(by[False], words), np.ones(bits), np.ones(bits))
    late = taught.filter("later").withColumn("h", F.xxhash64("text"))
    bar = late.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = late.filter(F.col("h") <= F.lit(bar)).groupBy("h").agg(F.min("lang").alias("lang"), F.first("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin, lettered = first.margins(batch.column(1))
            margin = pa.array(list(margin[lettered]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(lettered)), margin], ["lang", "margin"])

    slope, trust = np.ones(bits), np.ones(bits)
    found = sample.mapInArrow(run, "lang string, margin array<double>").toPandas() if bits else pd.DataFrame()
    if len(found):
        margin, truth = np.array(found["margin"].tolist()), words[[names.index(x) for x in found["lang"]]]
        for b in range(bits):
            slope[b] = _slope(margin[:, b] * truth[:, b])
            right = (margin[:, b] * truth[:, b] > 0).sum()
            p = (right + 1) / (len(found) + 2)
            trust[b] = max(0.0, np.log(p / (1 - p)))
        trust = trust / trust.mean() if trust.any() else np.ones(bits)
    return Model(names, words, _weights(by[False] + by[True], words), slope, trust / max(1, bits) * max(1, words.shape[0] - 1))


def _slope(margin: np.ndarray, steps: int = 50, decay: float = 1.0) -> float:
    """Slope of a logistic calibration of margins that are positive where right, by Newton steps in its logarithm; the decay ties it to 1."""
    at = 0.0
    for _ in range(steps):
        z = np.exp(at) * margin
        p = 1 / (1 + np.exp(np.clip(z, -30, 30)))
        g = -(p * z).sum() + decay * at
        h = (p * (1 - p) * z * z).sum() + decay
        step = np.clip(g / h, -1, 1)
        at -= step
        if abs(step) < 1e-9:
            break
    return float(np.exp(np.clip(at, -5, 5)))


def predicted(docs: DataFrame, model: Model | None, into: str = "language", text: str = "text") -> DataFrame:
    """`docs` with a struct (lang, score, ambiguous); row by row, nothing is shuffled. The model is sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value
        for texts in batches:
            n = len(texts)
            lang, score, unclear = pa.array([UNKNOWN] * n), np.zeros(n), np.ones(n, bool)
            if known:
                margin, lettered = known.margins(texts)
                best, share, doubt = known.decide(margin)
                lang = pc.if_else(pa.array(lettered), pa.array(known.names).take(pa.array(best)), UNKNOWN)
                score, unclear = np.where(lettered, share, 0.0), np.where(lettered, doubt, True)
            yield pa.StructArray.from_arrays([lang, pa.array(score), pa.array(unclear)], ["lang", "score", "ambiguous"])

    return docs.withColumn(into, run(text))
