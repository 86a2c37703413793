"""Quality classifier from weak labels.

1. Heuristic labellers vote good (1), bad (-1) or not at all (0) on every document, as column functions.
2. The counts of all vote patterns (at most 3 ** labellers rows) give, by expectation-maximisation, how each labeller votes on good and
   on bad documents, and the probability of "good" for each pattern.
3. A linear scorer over hashed features (shapes of words, of pairs of words, length) is fitted to these probabilities on a bounded
   sample of distinct texts (lowest hash), so it judges by more than the votes. Each of them has weight 1, however many copies
   it has: a text that fills much of the table is no more of the sample than any other.

Defined results: a null text is an empty one. Copies of a row have the same votes and score; each gets a row. An empty table
gives none, and the scorer then calls everything good. Columns other than id and text are ignored, and kept by `scored`.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most distinct texts that the scorer is fitted to, and buckets of its features.
ROWS, BUCKETS = 8_000, 4096
#: Shares of votes that differ by less count as equal.
SLACK = 0.002
#: One word four times in a row or more.
STUTTER = r"(?<!\S)(\S++)(?: \1(?!\S)){3,}+"


def votes(text: Column) -> dict[str, Column]:
    """Each labeller's vote. Thresholds leave a gap in which a labeller does not vote."""
    n_words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")))
    chars = F.greatest(F.lit(1), F.length(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = F.greatest(F.lit(1), F.size(lines))

    def vote(value: Column, good: float | None, bad: float, low_is_good: bool = True) -> Column:
        no = F.lit(0)
        is_bad, is_good = (value > bad, value < good if good is not None else F.lit(False)) if low_is_good else (value < bad, value > good if good is not None else F.lit(False))
        return F.when(is_bad, -1).when(is_good, 1).otherwise(no)

    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "symbols": vote(count(r"[#*$%&<>{}=~^]{2,}") / n_words, 0.02, 0.1),
        "signs": vote(count(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\s]+(?![^\x20\x09-\x0D])") / n_words, 0.05, 0.2),
        "short_words": vote(count(r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?=[,.]?(?:[\x20\x09-\x0D]|$))") / n_words, 0.15, 0.06, low_is_good=False),
        "bars": vote(count(r"\|") / n_words, None, 0.1),
        "capitals": vote(count(r"\p{Lu}") / chars, 0.08, 0.3),
        "shouts": vote(count(r"!!|\?\?") / n_words, None, 0.1),
        "stutter": vote(count(STUTTER), None, 0.5),
        "length": vote(n_words, 40, 3, low_is_good=False),
        "repeats": vote(1 - F.size(F.array_distinct(lines)) / n_lines, None, 0.3),
        "sentences": vote(count(r"\p{L}[.!?](?=[\x20\x09-\x0D]|$)") / n_words, 0.04, 0.008, low_is_good=False),
        "word_length": vote(chars / n_words, 9.0, 12.0),
        "digits": vote(count(r"[0-9]") / chars, 0.03, 0.2),
    }


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each labeller: table[class][labeller][vote + 1], class 1 is good."""

    names: tuple[str, ...]
    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        each = np.arange(len(self.names))
        logs = [np.log(p) + np.log(t[each, patterns + 1]).sum(axis=1) for p, t in zip((1 - self.prior, self.prior), self.table, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    @property
    def accuracies(self) -> dict[str, float]:
        """Of the documents that a labeller votes on, the share on which it is right."""
        right = (1 - self.prior) * self.table[0][:, 0] + self.prior * self.table[1][:, 2]
        wrong = (1 - self.prior) * self.table[0][:, 2] + self.prior * self.table[1][:, 0]
        return dict(zip(self.names, (right / np.maximum(right + wrong, 1e-12)).tolist(), strict=True))


def expectation_maximisation(names: tuple[str, ...], patterns: np.ndarray, counts: np.ndarray, steps: int = 200, smooth: float = 1.0) -> LabelModel:
    """Starts from the number of bad votes: most documents are good, and labellers that find a fault seldom err.

    A labeller may be of no use, but not worse than chance: a good vote is at least as likely on good documents as on bad
    ones, and a bad vote on bad ones. This keeps a group of faults that few labellers see from becoming a kind of good.
    """
    faults = (patterns == -1).sum(axis=1)
    good = np.where(faults == 0, 0.95, np.where(faults == 1, 0.6, 0.05)) if len(patterns) else np.zeros(0)
    model = None
    for _ in range(steps):
        weight = np.stack([counts * (1 - good), counts * good])
        table = np.stack([np.stack([((patterns == v) * w[:, None]).sum(axis=0) for v in (-1, 0, 1)], axis=1) + smooth for w in weight])
        both = table.sum(axis=0) / table.sum(axis=(0, 2))[:, None]
        table /= table.sum(axis=2, keepdims=True)
        useless = (table[0, :, 0] < table[1, :, 0] - SLACK) | (table[0, :, 2] > table[1, :, 2] + SLACK)
        table[:, useless] = both[useless]
        total = weight.sum(axis=1) + smooth
        last, model = model, LabelModel(names, float(total[1] / total.sum()), table)
        good = model.posterior(patterns) if len(patterns) else good
        if last is not None and np.abs(last.table - table).max() < 1e-6:
            break
    return model


def label_model(docs: DataFrame, text: str = "text") -> LabelModel:
    """From the votes on all documents."""
    cast = votes(F.coalesce(F.col(text), F.lit("")))
    names = tuple(cast)
    rows = docs.select(*(c.cast("int").alias(n) for n, c in cast.items())).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, len(names))
    return expectation_maximisation(names, patterns, np.array([r["n"] for r in rows], float))


def shape(text: Column) -> Column:
    """Words as shapes: runs of capitals A, of other letters a, of digits 0, of one sign that sign; lines end in a word of their own,
    and so do runs of one word."""
    for pattern, to in ((STUTTER, "$1 ®"), (r"\n", " ¶ "), (r"\p{Lu}+", "A"), (r"[\p{L}&&[^A]][\p{L}\p{M}&&[^A]]*", "a"), (r"[0-9]+", "0"), (r"([^aA0\s])\1+", "$1$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def features(shaped: str) -> dict[int, float]:
    """Hashed features of a shaped text: shares of words and of pairs, and the size."""
    words = shaped.split()
    n = len(words)
    out: Counter = Counter()
    for kind, counted in (("1", Counter(words)), ("2", Counter(zip(words, words[1:], strict=False)))):
        for w, c in counted.items():
            out[_bucket(kind, w)] += (c / n) ** 0.5
    out[_bucket("n", str(n.bit_length()))] += 1.0
    return out


def _bucket(kind: str, word: str | tuple[str, str]) -> int:
    return zlib.crc32(f"{kind} {word if isinstance(word, str) else ' '.join(word)}".encode()) % BUCKETS


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 5.0

    def score(self, shaped: str) -> float:
        x = self.bias + sum(v * self.weights[b] for b, v in features(shaped).items())
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit_scorer(docs: DataFrame, model: LabelModel, rows: int = ROWS, text: str = "text") -> Scorer:
    """Logistic regression on the posterior labels of at most `rows` distinct texts, each with weight 1.

    The keys of the lowest hashes are found first; only then texts are read, one of each key per task and then one of each.
    """
    keyed = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"))
    lowest = keyed.select("h", "c").distinct().orderBy("h", "c").limit(rows)
    chosen = keyed.join(F.broadcast(lowest), ["h", "c"]).dropDuplicates(["h", "c"])
    cast = votes(F.col("text"))

    @F.pandas_udf("struct<b:array<int>,v:array<double>>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for shaped in batches:
            found = [features(s) for s in shaped]
            yield pd.DataFrame({"b": [list(f) for f in found], "v": [list(f.values()) for f in found]})

    table = chosen.select(hashed(shape(F.col("text"))).alias("f"), F.array(*(c.cast("int") for c in cast.values())).alias("votes"), "h", "c").collect()
    table.sort(key=lambda r: (r["h"], r["c"]))  # sums in one order: the same texts give the same scorer
    if not table:
        return Scorer()
    y = model.posterior(np.array([r["votes"] for r in table], np.int64))
    row = np.repeat(np.arange(len(table)), [len(r["f"]["b"]) for r in table])
    col, val = np.concatenate([r["f"]["b"] for r in table]).astype(np.int64), np.concatenate([r["f"]["v"] for r in table])
    w, bias = np.zeros(BUCKETS), 0.0
    g2, b2 = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(300):  # full-batch adaptive gradient steps
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(table)) + bias, -30, 30)))
        g = np.bincount(col, val * (p - y)[row], BUCKETS) / len(table) + 1e-5 * w
        gb = float((p - y).mean())
        g2, b2 = g2 + g * g, b2 + gb * gb
        w, bias = w - 0.5 * g / np.sqrt(g2), bias - 0.5 * gb / b2**0.5
    return Scorer(w, bias)


def train(docs: DataFrame, rows: int = ROWS, text: str = "text") -> tuple[LabelModel, Scorer]:
    model = label_model(docs, text)
    return model, fit_scorer(docs, model, rows, text)


def scored(docs: DataFrame, scorer: Scorer, into: str = "quality", text: str = "text") -> DataFrame:
    """`docs` with P(good); row by row, nothing is shuffled."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for shaped in batches:
            yield pd.Series([scorer.score(s) for s in shaped], dtype="float64")

    return docs.withColumn(into, run(shape(F.coalesce(F.col(text), F.lit("")))))
