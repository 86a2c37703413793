"""Exact Jaccard join of word-shingle sets by a size-aware heavy-light split, and the groups that its links make.

Equal sets are one node. Two sets link if 100 * intersection >= threshold * union; sizes then differ by that ratio at most.

Light pairs (both sets up to a size): for each possible pair of sizes the least overlap is a fixed number c. All subsets of size c
are enumerated; sets that share one link, no pair is looked at. Heavy pairs: the hash space is cut into more parts
than linked sets of that size may differ in, so linked sets agree on a whole part that is not empty. The inverted lists have an entry per
part instead of one per shingle: lists of frequent shingles, lines or passages are not scanned. The boundary is the size where
enumerating a set's subsets costs more than its parts and their verification (`boundary`).

Lists are scanned in two steps that together lose no link between components. First every set is verified against the
most central member of its lists. Then only lists that still hold several components are looked at: all pairs from different components
whose overlap is possible by bucket counts (an upper bound) are verified, in blocks, so no list is ever held by one task.

Defined results: a null text has no words, an empty set and no links; its component is its own id. With fewer words than a
shingle has, the whole sequence is the one shingle. Equal rows are linked copies; null ids get the smallest known id of their
component. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from gridfill.llm.components import components
from gridfill.llm.words import WordTable, slices
from gridfill.session import drop, materialize, sweep

#: Growth of the size classes; buckets of the overlap bound; members of a list that one task compares with as many others.
GROWTH, BUCKETS, BLOCK = 1.5, 256, 512
#: Bytes of text cut at once, words that a worker remembers: two workers and their executor share its memory.
SLICE, WORDS = 2 << 20, 200_000
#: What verifying one candidate costs, in keys.
VERIFY = 8
SALT = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of the `size`-word shingles of texts; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size = size
        self.table = WordTable(lambda words: [pa.array([xxhash.xxh3_64_intdigest(w) for w in words], pa.uint64())], WORDS)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.ascii_lower(texts)
        for c in "\t\n\x0b\x0c\r":
            texts = pc.replace_substring(texts, c, " ")
        lists = pc.split_pattern(texts, " ")
        words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        real = pc.greater(pc.binary_length(words), 0)
        parent = parent[real.to_numpy(zero_copy_only=False)]
        h = self.table.of(words.filter(real))[0].to_numpy()
        n = np.bincount(parent, minlength=len(texts))
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - self.size + 1), np.uint64)
            for i in range(self.size):
                rolled += h[i : len(h) - self.size + 1 + i] * SALT[i % 8] * np.uint64(2 * (i // 8) + 1) if len(rolled) else rolled
            rolled = _mix(rolled)
        out, at = [], 0
        for k in n.tolist():
            if k >= self.size:
                out.append(np.unique(rolled[at : at + k - self.size + 1]))
            else:
                out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + k].tobytes(), k)], np.uint64) if k else np.empty(0, np.uint64))
            at += k
        return out


def overlap(a: int, b: int, threshold: int) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return -(-threshold * (a + b) // (100 + threshold))


def largest_partner(n: int, threshold: int) -> int:
    return 100 * n // threshold


@lru_cache(maxsize=None)
def classes(threshold: int) -> list[int]:
    """Lower bounds of the size classes; linked sets are in the same class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(largest_partner(out[-1], threshold) + 1, int(out[-1] * GROWTH)))
    return out


def class_of(n: int, threshold: int) -> int:
    return int(np.searchsorted(classes(threshold), n, side="right")) - 1


def parts_of(most: int, threshold: int) -> tuple[int, int]:
    """(parts, most parts in which linked sets differ) for linked sets of at most `most` elements together."""
    k = (100 - threshold) * most // (100 + threshold)
    return k + 2 + (k // 5 if k < 20 else max(4, k // 10)), k


def families(n: int, threshold: int) -> list[tuple[int, int, int]]:
    """(name, parts, most parts that differ) of each kind of pair that a set of size n can be in: with a set of its class, with
    one across the upper border of its class, with one across the lower border. Sets across a border B have fewer than
    B * (1 + 100 / threshold) elements together, far fewer than two sets of the upper class may have."""
    c, low = class_of(n, threshold), classes(threshold)
    out = [(2 * c, *parts_of(2 * (low[c + 1] - 1), threshold))]
    for border, crossed in ((c + 1, largest_partner(n, threshold) >= low[c + 1]), (c, -(-threshold * n // 100) < low[c])):
        if crossed:
            least = low[border] - 1
            out.append((2 * border + 1, *parts_of(least + largest_partner(least, threshold), threshold)))
    return out


def light_pairs(n: int, upto: int, threshold: int) -> list[tuple[int, int]]:
    """Pairs of sizes (small, large) with n as one of them, both at most `upto`, that may link without being equal."""
    small = range(-(-threshold * n // 100), n)
    pairs = [(a, n) for a in small if a <= upto] + [(n, b) for b in range(n, largest_partner(n, threshold) + 1) if b <= upto]
    return [(a, b) for a, b in pairs if not (a == b and overlap(a, b, threshold) == a)]


@lru_cache(maxsize=None)
def boundary(threshold: int, most: int = 64) -> int:
    """Largest size up to which enumerating subsets costs less than parts and their verification."""
    for n in range(1, most):
        light = sum(comb(n, overlap(a, b, threshold)) for a, b in light_pairs(n, largest_partner(n, threshold), threshold))
        heavy = sum(m for _, m, _ in families(n, threshold)) + VERIFY
        if light > heavy:
            return n - 1
    return most


def subset_keys(h: np.ndarray, upto: int, threshold: int) -> tuple[list[int], list[bool]]:
    """Keys of the subsets of a light set, and whether the set is of the smaller size of the key's pair of sizes."""
    keys, small, n = [], [], len(h)
    for a, b in light_pairs(n, upto, threshold):
        c = overlap(a, b, threshold)
        for chosen in combinations(range(n), c):
            keys.append(xxhash.xxh3_64_intdigest(h[list(chosen)].tobytes(), a << 20 | b))
            small.append(n == a)
    return keys, small


def part_keys(h: np.ndarray, upto: int, threshold: int) -> np.ndarray:
    """Keys of the parts of a set that may have a partner above `upto`: its elements in each part that has any.

    Linked sets agree on at least `parts - differ` parts. A set with fewer empty parts than that shares a key with each of its links.
    One with more goes on with another cut of the hash space, as often as it takes: of two linked sets, the one that ends first shares a
    key of its last cut with the other. So no key says only that a part is empty.
    """
    n = len(h)
    out = []
    if n and largest_partner(n, threshold) > upto:
        for name, m, k in families(n, threshold):
            for turn in range(64):
                dealt = np.sort(_mix(h + np.uint64(turn) * SALT[3])) if turn else h
                part = ((dealt >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ranges of the hash, so each part is a run
                starts = np.flatnonzero(np.diff(part, prepend=np.uint64(m)))
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(_mix(dealt ^ SALT[0]), starts)
                    out.append(_mix(sums ^ _mix((part[starts] | np.uint64(name) << np.uint64(40) | np.uint64(turn) << np.uint64(56)) + SALT[1])))
                if m - len(starts) < m - k:
                    break
            else:
                raise ArithmeticError(f"a set of {n} elements leaves {k} of {m} parts empty in every cut")
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


_WORKER: dict[int, Shingles] = {}


def _shingles(size: int) -> Shingles:
    return _WORKER.setdefault(size, Shingles(size))


def keyed(docs: DataFrame, size: int, threshold: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, n, node, parts, subsets, small) per row: hash of the text, set size, node (hash of the set), keys."""
    upto = boundary(threshold)
    rows = docs.select(col(key).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingles(size)
        for batch in (part for whole in batches for part in slices(whole, 2, SLICE)):
            sets = shingles.of(batch.column(2))
            light = [subset_keys(h, upto, threshold) if 0 < len(h) <= upto else ([], []) for h in sets]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(h) for h in sets], pa.int64()),
                pa.array(_signed([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets])),
                _lists([_signed(part_keys(h, upto, threshold)) for h in sets]),
                _lists([_signed(k) for k, _ in light]),
                pa.array([s for _, s in light], pa.list_(pa.bool_())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "n", "node", "parts", "subsets", "small"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, body bigint, n bigint, node bigint, parts array<bigint>, subsets array<bigint>, small array<boolean>"
    return rows.select("doc_id", F.xxhash64("text").alias("body"), "text").mapInArrow(run, schema)


def light_links(found: DataFrame) -> DataFrame:
    """(a, b): sets that share a subset with the list's first set of the smaller size; they link by the subset alone."""
    rows = found.filter(F.size("subsets") > 0).select("node", F.explode(F.arrays_zip("subsets", "small")).alias("x"))
    rows = rows.select(col("x.subsets").alias("key"), "node", col("x.small").alias("small")).distinct()
    first = rows.groupBy("key").agg(F.min(F.when(col("small"), col("node"))).alias("a"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    first = first.filter(col("a").isNotNull() & (col("lo") < col("hi"))).select("key", "a")
    return rows.join(first, "key").filter(col("node") != col("a")).select("a", col("node").alias("b")).distinct()


def inverted_lists(found: DataFrame) -> DataFrame:
    """(key, node, size): lists with several sets; of lists with the same sets, one."""
    rows = found.select("node", F.explode("parts").alias("key")).repartition("key")  # dealt once, read for both sides
    several = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter(col("lo") < col("hi")).select("key")
    lists = materialize(rows.join(several, "key").select("key", "node").distinct())
    sweep(found.sparkSession)
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "node").bitwiseAND(F.lit((1 << 40) - 1)))
    same = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), part(1).alias("x"), part(2).alias("y"))
    one = same.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    out = materialize(lists.join(one, "key"))
    drop(lists)
    return out


def sets_of(docs: DataFrame, found: DataFrame, nodes: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(node, n, shingles, counts) of the given nodes, from one text of each; counts per bucket bound overlaps."""
    wanted = found.join(nodes, "node").groupBy("node").agg(F.min("body").alias("body"))
    texts = docs.select(F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("body"), F.coalesce(col(text), F.lit("")).alias("text"))
    texts = texts.join(wanted, "body").dropDuplicates(["body"]).select("text", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            sets, nodes = _shingles(size).of(batch.column(0)), batch.column(1).to_pylist()
            # A text with another's hash has a set of its own, which is not the wanted one.
            sets = [h for h, node in zip(sets, nodes, strict=True) if _signed([xxhash.xxh3_64_intdigest(h.tobytes())])[0] == node]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signed([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets])),
                    pa.array([len(h) for h in sets], pa.int64()),
                    pa.array([h.tobytes() for h in sets], pa.binary()),
                    pa.array([counts_of(h) for h in sets], pa.binary()),
                ],
                ["node", "n", "shingles", "counts"],
            )

    return materialize(texts.mapInArrow(run, "node bigint, n bigint, shingles binary, counts binary"))


def counts_of(h: np.ndarray) -> bytes:
    """Shingles per bucket. A count that one byte cannot hold makes the bound void: all counts are then the largest."""
    counts = np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
    return np.full(BUCKETS, 255, np.uint8).tobytes() if counts.max(initial=0) > 254 else counts.astype(np.uint8).tobytes()


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda c: sets.select(col("node").alias(c), col("shingles").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                links[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(links))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a bigint, b bigint")


def cross_pairs(lists: DataFrame, sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """(a, b): sets of one list and different components that may link by size and bucket counts."""
    rows = lists.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(col("lo") < col("hi")).select("key")
    rows = rows.join(mixed, "key").withColumn("blocks", F.ceil(col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), col("blocks") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "label")
    rows = rows.join(sets.select("node", "n", "counts"), "node").select("key", "i", "j", "mine", "node", "label", "n", "counts")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            where = [batch.column(c).to_numpy() for c in range(3)]
            cut = np.flatnonzero((np.diff(where[0]) != 0) | (np.diff(where[1]) != 0) | (np.diff(where[2]) != 0)) + 1
            if held and len(batch) and not all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in range(3)):
                cut = np.concatenate([[0], cut])
            at = 0
            for end in cut.tolist():
                held.append(batch.slice(at, end - at))
                yield _possible(held, threshold)
                held, at = [], end
            held.append(batch.slice(at))
        if held:
            yield _possible(held, threshold)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _possible(held: list[pa.RecordBatch], threshold: int) -> pa.RecordBatch:
    """Pairs of one list and pair of blocks whose largest possible overlap is enough."""
    table = pa.Table.from_batches(held)
    i, j = (table.column(c)[0].as_py() if len(table) else 0 for c in ("i", "j"))
    mine, node, label, n = (table.column(c).to_numpy() for c in ("mine", "node", "label", "n"))
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS)
    left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
    out: tuple[list, list] = ([], [])
    for x in left.tolist():
        ys = right[(label[right] != label[x]) & ((node[right] > node[x]) | (i != j))]
        ys = ys[(100 * n[ys] >= threshold * n[x]) & (100 * n[x] >= threshold * n[ys])]
        if not len(ys):
            continue
        most = np.minimum(counts[ys], counts[x]).sum(axis=1, dtype=np.int64)
        if counts[x, 0] == 255:
            most = np.minimum(n[ys], n[x])
        most = np.where(counts[ys, 0] == 255, np.minimum(n[ys], n[x]), most)
        ys = ys[100 * most >= threshold * (n[ys] + n[x] - most)]
        out[0].extend(np.minimum(node[ys], node[x]).tolist())
        out[1].extend(np.maximum(node[ys], node[x]).tolist())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])


def links(docs: DataFrame, found: DataFrame, light: DataFrame, lists: DataFrame, size: int, threshold: int, text: str = "text") -> DataFrame:
    """(a, b): links between nodes, as many as it takes to connect all that are connected."""
    sets = sets_of(docs, found, lists.select("node").distinct(), size, text)
    sweep(docs.sparkSession)
    weight = lists.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = lists.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("c"))
    star = lists.join(centre, "key").filter(col("node") != col("c.node"))
    # Only a node's most central list: a pair costs two sets to verify, and what this leaves apart is looked at below.
    star = star.groupBy(col("node").alias("a")).agg(F.max("c")["node"].alias("b"))
    first = materialize(verified(star, sets, threshold).unionByName(light))
    sweep(docs.sparkSession)
    more = verified(cross_pairs(lists, sets, components(first), threshold), sets, threshold)
    return materialize(first.unionByName(more))


def grouped(docs: DataFrame, size: int, threshold: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, body, n, node, label) per row that has words; equal labels are one component."""
    with_keys = materialize(keyed(docs, size, threshold, key, text))
    light, lists = materialize(light_links(with_keys)), inverted_lists(with_keys)
    found = materialize(with_keys.select("doc_id", "body", "n", "node"))
    drop(with_keys)  # the keys are most of what is on disk, and only the lists needed them
    sweep(docs.sparkSession)
    labels = components(links(docs, found, light, lists, size, threshold, text)).withColumnRenamed("id", "node")
    nodes = materialize(found.filter(col("n") > 0).select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label")))
    return found.select("doc_id", "body", "n", "node").join(nodes, "node", "left")


def jaccard_groups(docs: DataFrame, size: int = 4, threshold: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: the smallest id of all documents that links reach."""
    rows = materialize(grouped(docs, size, threshold, key, text))
    least = materialize(rows.filter(col("n") > 0).groupBy("label").agg(F.min("doc_id").alias("component_id")))
    out = rows.join(least, "label", "left")
    return out.select("doc_id", col("n").alias("n_shingles"), F.when(col("n") > 0, col("component_id")).otherwise(col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component, its document with the smallest id; documents without words all stay. Columns are those of `docs`."""
    rows = grouped(docs, size, threshold, key, text).filter(col("n") > 0)
    chosen = rows.groupBy("label").agg(F.min(F.struct(col("doc_id").isNull(), "doc_id", "body")).alias("x"))
    name = lambda i, body: F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("none")), body.cast("string"))
    chosen = materialize(chosen.select(name(col("x.doc_id"), col("x.body")).alias("_name")))
    body = F.coalesce(col(text), F.lit(""))
    worded = body.rlike(r"[^\x20\x09-\x0D]")
    named = docs.filter(worded).withColumn("_name", name(col(key), F.xxhash64(body)))
    return named.join(chosen, "_name", "left_semi").dropDuplicates(["_name"]).select(docs.columns).unionByName(docs.filter(~worded))
