"""URL filter: exact membership of hosts in a blocklist by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys. Over the corpus's complete key universe some unlisted keys pass it; they fill
level 1. Listed keys that pass level 1 fill level 2, and so on until nothing passes wrongly. A key of the universe is listed
if the first level that it fails is odd (or, passing all, if the number of levels is odd): exact, without the key lists.

Keys are dealt to shards by hash. A shard's cascade is built in one task from its own keys and is a few bits per key. The
rows to judge travel to their shard's cascade, of which there are more copies the more rows there are, so a hot host is read by many tasks; each task
streams its rows and holds one shard's cascade at a time. Nothing is broadcast or joined and nothing grows on the driver.

Defined results: a null url, or one without "://", has an empty host and path. Repeated rows are judged each. Keys that are
listed but are not in the corpus change nothing. Without listed keys no level exists and nothing is blocked.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys for which one shard is planned, rows for which one more copy of each cascade is planned, least and most copies.
SHARD_KEYS, SALT_ROWS, SALTS = 1 << 16, 1 << 20, (16, 2048)
#: Bits per key of the first and of later levels.
FIRST_BITS, NEXT_BITS = 10, 6


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From there up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Bloom:
    """A Bloom filter over 64-bit hashes; places come from two halves of a mixed hash."""

    def __init__(self, bits: np.ndarray, seed: int, k: int):
        self.bits, self.seed, self.k = bits, seed, k

    @staticmethod
    def of(keys: np.ndarray, per_key: int, seed: int) -> Bloom:
        made = Bloom(np.zeros(max(64, len(keys) * per_key + 63 & ~63), bool), seed, max(1, round(per_key * 0.69)))
        made.bits[made.places(keys).ravel()] = True
        return made

    def places(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (self.seed + 1) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
            return (low[:, None] + np.arange(self.k, dtype=np.uint64) * high[:, None]) % np.uint64(len(self.bits))

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[self.places(keys)].all(axis=1)


def build(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels that tell `listed` from `others` without error."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while len(inside):
        level = Bloom.of(inside, FIRST_BITS if not levels else NEXT_BITS, len(levels))
        levels.append(level)
        inside, outside = outside[level.has(outside)], inside
    return levels


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed."""
    depth = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    for level in levels:
        alive = alive[level.has(keys[alive])]
        depth[alive] += 1
    return depth % 2 == 1


def to_bytes(levels: list[Bloom]) -> bytes:
    return b"".join(struct.pack("<III", x.seed, x.k, len(x.bits)) + np.packbits(x.bits, bitorder="little").tobytes() for x in levels)


def from_bytes(data: bytes) -> list[Bloom]:
    levels, at = [], 0
    while at < len(data):
        seed, k, n = struct.unpack_from("<III", data, at)
        at += 12
        levels.append(Bloom(np.unpackbits(np.frombuffer(data, np.uint8, n // 8, at), bitorder="little").astype(bool), seed, k))
        at += n // 8
    return levels


def cascades(universe: DataFrame, listed: DataFrame, shards: int) -> DataFrame:
    """(shard, cascade): one row per shard. `universe` and `listed` have one column of keys each; equal hashes are one key."""
    hashed = lambda df, flag: df.select(F.xxhash64(F.coalesce(F.col(df.columns[0]), F.lit(""))).alias("h"), F.lit(flag).alias("flag"))
    # flag 1: in the universe, 2: listed. A key in both adds up to 3; copies are gone before they are added.
    keys = hashed(universe, 1).distinct().unionByName(hashed(listed, 2).distinct()).groupBy("h").agg(F.sum("flag").alias("flag"))
    keys = keys.filter(F.col("flag") != 2).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        flag = table.column("flag").to_numpy()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cascade": pa.array([to_bytes(build(np.sort(h[flag == 3]), np.sort(h[flag == 1])))], pa.binary())})

    return keys.groupBy("shard").applyInArrow(run, "shard int, cascade binary")


def blocked(rows: DataFrame, listed: DataFrame, key: str = "host", into: str = "listed") -> DataFrame:
    """`rows` with a boolean: is the key of the row on the list? The universe is the keys of `rows`."""
    universe = rows.select(key)
    n_keys, n_rows = universe.agg(F.approx_count_distinct(key), F.count(F.lit(1))).first()
    shards, salts = 1 + n_keys // SHARD_KEYS, min(SALTS[1], SALTS[0] + n_rows // SALT_ROWS)
    built = cascades(universe, listed, shards)
    names, names_out = rows.columns, [*rows.columns, into]
    h = F.xxhash64(F.coalesce(F.col(key), F.lit("")))
    salt = F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")
    ask = rows.select(F.pmod(h, F.lit(shards)).cast("int").alias("_shard"), salt.alias("_salt"), F.lit(1).alias("_kind"), h.alias("_h"), F.lit(None).cast("binary").alias("_cascade"), F.struct(*names).alias("_row"))
    tell = built.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_h"), F.col("cascade").alias("_cascade"), F.lit(None).cast(ask.schema["_row"].dataType).alias("_row"))
    dealt = ask.unionByName(tell).repartition("_shard", "_salt").sortWithinPartitions("_shard", "_salt", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[Bloom] = []
        for batch in batches:
            kind = batch.column(2).to_numpy()
            answer = np.zeros(len(kind), bool)
            h = batch.column(3).to_numpy().view(np.uint64)
            starts = [*np.flatnonzero(kind == 0).tolist(), len(kind)]
            answer[: starts[0]] = member(levels, h[: starts[0]])
            for a, b in zip(starts, starts[1:], strict=False):
                levels = from_bytes(batch.column(4)[a].as_py())
                answer[a + 1 : b] = member(levels, h[a + 1 : b])
            out = pa.RecordBatch.from_arrays([batch.column(5), pa.array(answer)], ["_row", "_listed"])
            yield out.filter(pc.equal(batch.column(2), 1))

    kind = ask.schema["_row"].dataType.simpleString()
    found = dealt.mapInArrow(run, f"_row {kind}, _listed boolean")
    return found.select("_row.*", F.col("_listed").alias(into)).select(*names_out)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path); null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, listed, verdict): the longest rule decides, else the blocklist of hosts."""
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = blocked(rows, listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
