"""Collocations by top-order marginalisation: only windows of the longest width are counted, each word leading one, padded where
its piece ends; Spark's ROLLUP then sums successively shorter prefixes, which are the counts of all shorter phrases.

A window is cut before the first word that provably ends a phrase of fewer than `least` occurrences. The proof is a table of counters, in
which every word, pair, triple and window of a language adds to the counter of its hash: a counter below `least` leaves no frequent phrase
in it. A cut window loses rare phrases only, so all counts of `least` and more stay exact whatever the hashes do. The
table has a counter for about eight words of text and at most 2 ** MOST_BITS (64 MB of bits when sent to the tasks); beyond it (some 25 GB of
text) more windows stay whole, which costs shuffle, not exactness. Windows are added up per slice of text, then by Spark before and
after each shuffle, so frequent words, lines and copies arrive as one row per slice.

Defined results: null texts are empty, null languages `und`; a null text of a language adds nothing to its n. Repeated rows count each time.
Languages without candidates have no rows; an empty table gives none. Ties go by the phrase. Columns other than the
two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfill.llm import added_up
from gridfill.llm.byte_words import cut, kinds
from gridfill.llm.words import slices
from gridfill.session import materialize

#: Words of the longest window.
WIDTH = 4
#: Bytes of text cut into words at once.
SLICE = 2 << 20
#: Least and most counters, as powers of two; bytes of text a counter.
LEAST_BITS, MOST_BITS, BYTES_A_COUNTER = 16, 29, 48
#: Pieces end at these bytes, words at spaces and tabs. Fixed values.
KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Counters that a task holds before it sends them.
HELD = 1 << 20
COLUMNS = [f"w{i}" for i in range(1, WIDTH + 1)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Slice:
    """The words of a slice of (lang, text) rows, as numbers of distinct words, with the counters they fall into."""

    def __init__(self, rows: pa.RecordBatch, bits: int):
        texts = pc.ascii_lower(rows.column(1))
        words, row, self.goes_on = cut(texts, KINDS)
        coded, langs = words.dictionary_encode(), rows.column(0).dictionary_encode()
        self.words, self.langs = coded.dictionary, langs.dictionary
        self.word = coded.indices.to_numpy(zero_copy_only=False)
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[row]
        hashes = [np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in a.to_pylist()), np.uint64, len(a)) for seed, a in ((0, self.words), (1, self.langs))]
        shift, word = np.uint64(64 - bits), hashes[0][self.word]
        own = _mixed(word ^ hashes[1][self.lang])
        #: For phrases of 1 to WIDTH words: the counter of the one that each word leads, and whether it stands in one piece.
        self.at, self.there = [], []
        whole = np.ones(len(word), bool)
        for n in range(WIDTH):
            if n:
                whole = whole[:-1] & self.goes_on[n - 1 : len(word) - 1]
                own = _mixed(own[:-1] * np.uint64(3) + word[n:])
            self.at.append((own * np.uint64(0xD6E8FEB86659FD93)) >> shift)
            self.there.append(whole)


def _counters(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """Whether the counters of phrases reach `least`, as packed bits."""
    kind = np.uint8 if least < 256 else np.uint32

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            places, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(places, kind="stable")
            places, numbers = places[order], numbers[order].astype(np.int64)
            first = np.flatnonzero(np.diff(places, prepend=-1))
            yield from added_up.sent_few("", places[first], np.minimum(np.add.reduceat(numbers, first), least), 1 << bits, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                s = Slice(part, bits)
                for at, there in zip(s.at, s.there, strict=True):
                    places, n = np.unique(at[there].astype(np.uint32), return_counts=True)
                    if len(places):
                        held.append((places.astype(np.int64), np.minimum(n, least).astype(kind)))
                if sum(len(x) for x, _ in held) > HELD:
                    yield from added(held)
                    held = []
        yield from added(held)

    parts = rows.mapInArrow(run, added_up.SCHEMA)
    reached = added_up.summed(parts, 1 << bits, kind, lambda total: np.packbits(total >= least).tobytes(), least)
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in reached.toLocalIterator():
        data = np.frombuffer(r["data"], np.uint8)
        out[r["chunk"] * (added_up.CHUNK // 8) :][: len(data)] = data
    return out


def _grouped(keys: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each group of rows that agree in all keys (numbers from 0), and the groups' sizes."""
    group = keys[0].astype(np.int64)
    for key, size in zip(keys[1:], sizes[1:], strict=True):
        group = np.unique(group * size + key, return_inverse=True)[1]
    _, first, n = np.unique(group, return_index=True, return_counts=True)
    return first, n


def windows(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, w1 ... w4, n): the window that each word leads, padded with empty words, and how often it stands there. Its first
    word is empty too where it is rare, so that the rows of a language add up to all its words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BYTES_A_COUNTER).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(_counters(rows, bits, least).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.frombuffer(sent.value, np.uint8)
        frequent = lambda at: (reached[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                s = Slice(part, bits)
                if not len(s.word):
                    continue
                count = len(s.word)
                whole = frequent(s.at[0])
                numbers = [np.where(whole, s.word + 1, 0)]
                link = np.zeros(count, bool)  # this word and the next may be parts of a frequent phrase
                for i in range(1, WIDTH):
                    whole = whole[:-1] & whole[1:] & s.there[i] & frequent(s.at[i])  # so are both phrases that lack an end
                    numbers.append(np.zeros(count, np.int32))
                    numbers[-1][: len(whole)] = np.where(whole, s.word[i:] + 1, 0)
                    if i == 1:
                        link[: len(whole)] = whole
                for some in (link, ~link):
                    at = np.flatnonzero(some)
                    used = [s.lang, *(numbers if some is link else numbers[:1])]
                    found, n = _grouped([k[at] for k in used], [len(s.langs)] + [len(s.words) + 1] * (len(used) - 1))
                    found = at[found]
                    words = [pc.fill_null(s.words.take(pa.array(k[found] - 1, mask=k[found] == 0)), "") for k in numbers]
                    yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(s.lang[found])), *words, pa.array(n, pa.int64())], ["lang", *COLUMNS, "n"])

    return rows.mapInArrow(run, f"lang string, {', '.join(c + ' string' for c in COLUMNS)}, n bigint")


def counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, phrase, f) of the phrases of up to 4 words with f of at least `least`; size 0 has all words of the language."""
    longest = windows(docs, least, text, lang).groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))
    rolled = longest.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("_gone"))
    size = lambda k: (1 << (WIDTH - k)) - 1  # noqa: E731 - the columns after the k-th are rolled up
    whole = F.col("_gone") == size(0)
    for k, c in enumerate(COLUMNS, 1):
        whole = whole | ((F.col("_gone") == size(k)) & (F.col(c) != "") & (F.col("f") >= least))
    kept = rolled.filter(whole)
    n_words = F.coalesce(*[F.when(F.col("_gone") == size(k), F.lit(k)) for k in range(WIDTH + 1)])
    return kept.select("lang", n_words.alias("size"), F.concat_ws(" ", *COLUMNS).alias("phrase"), "f")


def _exact(column: str, digits: int = 20):
    return F.col(column).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, share: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases of 2 to 4 words that occur `least` times or more.

    The score is floor(2000000 * a / (l + r)) at the phrase's lowest cut. Phrases inside a longer one that makes up `share` percent
    of their occurrences are left out.
    """
    found = materialize(counts(docs, least, text, lang))
    part = lambda k, n: F.array_join(F.slice(F.split("phrase", " "), k, n), " ")
    candidates = found.filter(F.col("size") >= 2).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"_first": part(F.lit(1), F.col("k")), "_rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    of = lambda name, into: found.filter(F.col("size") > 0).select("lang", F.col("phrase").alias(name), F.col("f").alias(into))
    cuts = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
    cuts = cuts.withColumns({"_top": F.lit(2000000).cast("decimal(7,0)") * _exact("a"), "_below": _exact("l") + _exact("r")})
    scored = cuts.withColumn("score", F.expr("_top div _below")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r")).alias("_s")).select("lang", "phrase", "_s.score", "_s.a", "_s.l", "_s.r")

    longer = candidates.filter(F.col("size") > 2).withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_n") + 1)))
    longer = longer.groupBy("lang", part(F.col("_at"), F.col("_n")).alias("phrase")).agg(F.max("a").alias("_longer"))
    free = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.col("_longer").isNull() | (_exact("_longer") * F.lit(100).cast("decimal(3,0)") < _exact("a") * F.lit(share).cast("decimal(3,0)")))

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank).filter(F.col("rank") <= most)
    total = found.filter(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
