"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding is letter by letter (case, look-alike letters, digits and signs used as letters), so places in the folded and
the lower-cased text agree: a term is matched in the folded one, its ends are judged in the other. Terms inside an exception phrase do
not count. The weights of a text's terms are added, divided by a power of its length in words and turned into a
probability.

`learn` takes the lexicon from the texts of at most `rows` labelled ids (lowest hash), so what is broadcast is bounded. Rows of one
id and one text count once; an id with several texts gives each of them its label. All is counted by Spark: terms and exceptions
per text, strengths on a fixed scale, so what comes to the driver is bounded whatever number of texts an id has.

Defined results: null and empty texts have no terms and the lowest score. Labels of a document given several times
count once, toxic first; null labels and ids do not count. Without labels of both kinds the lexicon is empty and every score
0. Repeated rows and null ids get a row each. Columns other than id and text are ignored, and kept by `scored`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.session import drop, materialize

#: Look-alike letters. Fixed values.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвνοραειкτ", "aeopcyxijsdhkmtbvopaeikt", strict=True))
#: Digits and signs that stand for letters. Fixed values.
LEET = dict(zip("013457@$!|€", "oieastasiie", strict=True))
WIDE = {c: c - 0xFF41 + 97 for c in range(0xFF41, 0xFF5B)} | {c: c - 0xFF21 + 97 for c in range(0xFF21, 0xFF3B)}
FOLD = {ord(a): b for a, b in (LOOKALIKES | LEET).items()} | WIDE
#: Phrases in which a term is harmless, beside those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown")

#: Standard errors that a term's log-odds must be above zero.
SURE = 3.3
#: Least log-odds of a term.
LEAST_WEIGHT = 4.0
#: Most labelled rows, most terms, most exceptions.
ROWS, TERMS, PHRASES = 40_000, 2_000, 2_000
WORDS = re.compile(r"[^\W_][^\s]*[^\W_]|[^\W_]").findall
#: Steps of a unit of log(1 + strength) for which texts are counted to fit the probability.
STEPS = 1_000
#: Letters of a stem. A term that ends in OPEN is a stem: the word may go on.
STEM, OPEN = range(4, 9), "*"


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    bias: float = -20.0
    power: float = 0.25


def fold(text: str) -> tuple[str, str]:
    """Lower-cased text, and the same folded, of the same length."""
    low = text.lower()
    return low, low.translate(FOLD)


class Matcher:
    """Finds terms that begin and end at a word's border, outside exception phrases."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for term in lexicon.weights:
            self._add(term.removesuffix(OPEN), term)
        for phrase in lexicon.exceptions:
            self._add(phrase, None)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _add(self, letters: str, term: str | None) -> None:
        """A string may be a word, a stem and an exception."""
        self.automaton.add_word(letters, [*self.automaton.get(letters, ()), (len(letters), term)])

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, term)."""
        if not len(self.automaton):
            return []
        low, folded = fold(text)
        found, harmless, n = [], [], len(low)
        for last, terms in self.automaton.iter(folded):
            end = last + 1
            for size, term in terms:
                start = end - size
                if (start and low[start - 1].isalnum()) or (end < n and low[end].isalnum() and not (term and term[-1] == OPEN)):
                    continue
                (found if term else harmless).append((start, end, term or ""))
        if harmless:
            # The exception that starts before a term and reaches furthest decides whether one covers it.
            harmless.sort()
            starts, reach = [a for a, *_ in harmless], list(accumulate((b for _, b, _ in harmless), max))
            found = [x for x in found if not ((at := bisect_right(starts, x[0])) and reach[at - 1] >= x[1])]
        return found

    def strength(self, text: str) -> tuple[float, list[str]]:
        """Weight of the terms, normalised by length, and the terms."""
        terms = [t for *_, t in self.find(text)]
        if not terms:
            return 0.0, terms
        weight = sum(self.lexicon.weights[t] for t in terms)
        return weight / (10 + len(text.split())) ** self.lexicon.power, terms


def _sample(docs: DataFrame, labels: DataFrame, rows: int, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of the labelled ids' texts, each text of an id once; the sample of labels is small by its bound, so it is broadcast."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("toxic")).dropna()
    known = known.groupBy("_key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "_key").withColumn("_h", F.xxhash64("text")).withColumn("_c", F.crc32("text"))
    return found.dropDuplicates(["_key", "_h", "_c"]).select("text", "toxic")


def _counted(sample: DataFrame, words_of) -> DataFrame:
    """(w, n_toxic, n_clean): distinct words of each text, added up per batch before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = words_of()
        for batch in batches:
            count: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count.update((w, toxic > 0) for w in find(text))
                count["", toxic > 0] += 1
            words, kinds = zip(*count, strict=True) if count else ((), ())
            n = pa.array(list(count.values()), pa.int64())
            kinds = pa.array(kinds, pa.bool_())
            zero = pa.array(np.zeros(len(n), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pc.if_else(kinds, n, zero), pc.if_else(kinds, zero, n)], ["w", "n_toxic", "n_clean"])

    return sample.mapInArrow(run, "w string, n_toxic bigint, n_clean bigint").groupBy("w").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _folded_words():
    """Words and stems of a text."""

    def find(text: str) -> set[str]:
        words = {w for w in WORDS(fold(text)[1]) if 2 < len(w) < 30}
        return words | {w[:n] + OPEN for w in words for n in STEM if n <= len(w)}

    return find


def _surest(candidates: list[tuple[str, float]], most: int) -> dict[str, float]:
    """The first `most` candidates (surest first), without those that a chosen stem covers already."""
    chosen: dict[str, float] = {}
    for term, weight in candidates:
        letters = term.removesuffix(OPEN)
        if len(chosen) < most and not any(letters[:n] + OPEN in chosen for n in STEM if n <= len(letters)):
            chosen[term] = weight
    return chosen


def _odds(n_toxic: int, n_clean: int) -> tuple:
    """Log-odds ratio of a document with the word being toxic, and how many standard errors it is from zero."""
    t, c = F.col("n_toxic"), F.col("n_clean")
    ratio = F.log((t + 0.5) / (n_toxic - t + 0.5)) - F.log((c + 0.5) / (n_clean - c + 0.5))
    error = F.sqrt(1 / (t + 0.5) + 1 / (n_toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (n_clean - c + 0.5))
    return ratio, ratio / error


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS, phrases: int = PHRASES, exceptions: tuple[str, ...] = EXCEPTIONS,
          key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """The lexicon that these labels support. The `terms` surest words count, and the `phrases` surest exceptions."""
    sample = materialize(_sample(docs, labels, rows, key, text, label))
    words = materialize(_counted(sample, _folded_words))
    total = words.filter(F.col("w") == "").first()
    n_toxic, n_clean = (total["n_toxic"], total["n_clean"]) if total else (0, 0)
    if not n_toxic or not n_clean:
        drop(sample)
        return Lexicon()
    ratio, sure = _odds(n_toxic, n_clean)
    told = words.filter((F.col("w") != "") & (F.col("n_toxic") >= 3)).select("w", ratio.alias("weight"), sure.alias("sure"))
    told = told.filter((F.col("sure") > SURE) & (F.col("weight") > LEAST_WEIGHT)).orderBy(F.desc("sure"), F.length("w"), "w").limit(20 * terms)
    weights = _surest([(r["w"], r["weight"]) for r in told.collect()], terms)
    drop(words)
    lexicon = Lexicon(weights, tuple(exceptions))

    def contexts():
        matcher = Matcher(Lexicon(weights))

        def find(text: str) -> set[str]:
            folded, out = fold(text)[1], set()
            for start, end, term in matcher.find(text):
                before, after = folded[max(0, start - 40) : start].split(), folded[end : end + 40].split()
                if term[-1] == OPEN:
                    continue
                if before and start and folded[start - 1] == " ":
                    out.add(f"{before[-1]} {term}")
                if after and folded[end : end + 1] == " ":
                    out.add(f"{term} {after[0]}")
            return out

        return find

    near = _counted(sample, contexts).filter((F.col("w") != "") & (F.col("n_clean") >= 5))
    ratio, sure = _odds(n_toxic, n_clean)
    near = near.select("w", ratio.alias("weight"), sure.alias("sure")).filter((F.col("weight") < 0) & (F.col("sure") < -2))
    learned = [r["w"] for r in near.orderBy("sure", "w").limit(phrases).collect()]
    lexicon = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *learned])))
    place = F.round(STEPS * F.log1p("s.strength")).cast("long").alias("place")
    table = sample.select(strength(lexicon)("text").alias("s"), (F.col("toxic") > 0).alias("toxic")).groupBy(place, "toxic").agg(F.count(F.lit(1)).alias("n"))
    found = np.array(sorted(map(tuple, table.collect())), float)
    drop(sample)
    slope, bias = _logistic(np.expm1(found[:, 0] / STEPS), found[:, 1], found[:, 2])
    return Lexicon(weights, lexicon.exceptions, slope, bias)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50, decay: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of rows that count n times, by Newton steps, with a small decay so that separable data end."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (n * (p - y)) + decay * w
        h = (a * (n * p * (1 - p))[:, None]).T @ a + np.eye(2) * (decay + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
    return float(w[0]), float(w[1])


def strength(lexicon: Lexicon):
    """A column function of a text: strength, score, terms."""

    @F.pandas_udf("strength double, score double, terms array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for texts in batches:
            found = [matcher.strength(t or "") for t in texts]
            x = [s for s, _ in found]
            score = [1 / (1 + exp(-max(-30.0, min(30.0, lexicon.bias + lexicon.slope * s)))) for s in x]
            yield pd.DataFrame({"strength": x, "score": score, "terms": [t for _, t in found]})

    return run


def scored(docs: DataFrame, lexicon: Lexicon, into: str = "toxicity", text: str = "text") -> DataFrame:
    """`docs` with a struct (strength, score, terms); row by row, nothing is shuffled."""
    return docs.withColumn(into, strength(lexicon)(text))
