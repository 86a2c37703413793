"""Chat formatting with collapse of cumulative snapshots, in column functions only.

A log often holds a conversation several times, each time with more turns. The first k turns of a conversation have a rolling
hash: the sum of hashes of (place, role, text), which a running sum gives for every k. A conversation whose full hash is
among the hashes of another's shorter beginnings prefixes it: an anti-join drops it. Of equal conversations one stays.
What stays is rendered in parts of at most `part` turns, so a long conversation is never one row.

Running sums go over blocks of `part` turns first and then over the blocks, so the turns of a hot conversation are never
sorted in one task; both sides of the anti-join have each key once.

Defined results: rows without conversation or turn number are no turns. A null text is empty, a null role is "unknown". Equal rows
count once; different rows of one turn stand in order of role and text. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfill.session import materialize

#: Bits kept of each turn's hash: sums of 2^23 turns still fit 64 bits. Two such sums are compared.
BITS = 40


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "role", "text").bitwiseAND(F.lit((1 << BITS) - 1))


def ordered(turns: DataFrame, part: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, role, text): turns of each conversation, places counted from 0 without gaps."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.dropna(subset=["conv_id", "turn"]).distinct().withColumn("block", F.floor(F.col("turn") / part))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("conv_id", "block", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")) - 1
    return rows.withColumn("within", within).join(sizes, ["conv_id", "block"]).select("conv_id", (F.col("before") + F.col("within")).alias("place"), "role", "text")


def prefixes(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, size, a, b): hashes of the first `size` turns of each conversation, for every size."""
    hashed = turns.select("conv_id", "place", F.floor(F.col("place") / part).alias("block"), _turn_hash(1).alias("a"), _turn_hash(2).alias("b"))
    running = Window.partitionBy("conv_id", "block").orderBy("place")
    inner = hashed.select("conv_id", "block", (F.col("place") + 1).alias("size"), F.sum("a").over(running).alias("a"), F.sum("b").over(running).alias("b"))
    sums = hashed.groupBy("conv_id", "block").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("sa", "sb")))
    joined = inner.join(sums, ["conv_id", "block"])
    return joined.select("conv_id", "size", (F.col("a") + F.col("sa")).alias("a"), (F.col("b") + F.col("sb")).alias("b"))


def maximal(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, size, n_equal): conversations that prefix no longer one, one of each set of equal ones."""
    begun = materialize(prefixes(turns, part))
    begun = begun.join(begun.groupBy("conv_id").agg(F.max("size").alias("last")), "conv_id")
    whole = begun.filter(F.col("size") == F.col("last")).groupBy("size", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    longer = begun.filter(F.col("size") < F.col("last")).select("size", "a", "b").distinct()
    return whole.join(longer, ["size", "a", "b"], "left_anti").select("conv_id", "size", "n_equal")


def render(turns: DataFrame, kept: DataFrame, part: int) -> DataFrame:
    """(conv_id, part, n_turns, text, size, n_equal): role headers and texts of `part` turns at a time."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    rows = turns.select("conv_id", F.floor(F.col("place") / part).cast("int").alias("part"), F.struct("place", line.alias("line")).alias("x"))
    rows = rows.join(kept, "conv_id").groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("x")).alias("x"), F.first("size").alias("size"), F.first("n_equal").alias("n_equal"))
    return rows.select("conv_id", "part", F.size("x").cast("long").alias("n_turns"), F.array_join(F.col("x.line"), "").alias("text"), "size", "n_equal")


def format_chats(turns: DataFrame, part: int = 256, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations, rendered: (conv_id, part, n_turns, text, size, n_equal)."""
    placed = materialize(ordered(turns, part, conv, turn, role, text))
    return render(placed, materialize(maximal(placed, part)), part)
