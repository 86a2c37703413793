"""Quality rules with cross-document line frequency, in column functions only.

A host's boilerplate are the normalised lines that stand in more than `share` of its distinct texts and in more than `least` (four) of
them, so that hosts of any size can lose a line. They are removed; a document that loses most of itself is rejected. A host has at most (lines per text) / share such
lines, so they travel as one short array per host. Rows are judged where they are: only line hashes and counts are shuffled.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own. Exact copies on a host
count as one text. Every row is judged by itself, so repeated rows and null ids stay. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfill.session import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Words in a window whose repetition counts.
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    """Hash of a line without case (A-Z), exact numbers and white space."""
    plain = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(plain, SPACE + "+", " "))
    return F.xxhash64(F.regexp_replace(plain, "[0-9]+", "0"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows are compared by hash inside the row. Only where a hash comes twice, windows are sorted to find their places;
    each intermediate array is a column that is used more than once, which keeps Catalyst from inlining it into lambdas.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words_of(body)).withColumn("_lines", lines_of(body))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))
    out = out.withColumn("_grams", F.when(F.size("_words") >= WINDOW, grams))
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(twice, placed))
    pairs = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    out = out.withColumn("_starts", starts)
    new_words = F.zip_with("_starts", F.slice("_starts", 2, F.size("_starts")), lambda a, b: F.least(F.lit(WINDOW), b - a))  # least skips null
    return (
        out.withColumn("word_chars", F.length(F.regexp_replace(body, SPACE + "+", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(new_words, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def boilerplate(docs: DataFrame, share: float, least: int, host: str = "source", text: str = "text") -> DataFrame:
    """(_host, _common): hashes of each host's lines that stand in too many of its distinct texts."""
    texts = docs.select(F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(text, F.lit("")).alias("_text")).select(
        "_host", F.xxhash64("_text").alias("_id"), F.crc32("_text").alias("_crc"), F.array_distinct(F.transform(lines_of(F.col("_text")), line_hash)).alias("_lines")
    )
    texts = materialize(texts.dropDuplicates(["_host", "_id", "_crc"]))
    sizes = texts.groupBy("_host").agg(F.count(F.lit(1)).alias("n_texts"))
    lines = texts.select("_host", F.explode("_lines").alias("line")).groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n"))
    common = lines.filter(F.col("n") > least).join(sizes, "_host").filter(F.col("n") > share * F.col("n_texts"))
    return materialize(common.groupBy("_host").agg(F.array_sort(F.collect_set("line")).alias("_common")))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_lines", "clean_text", "kept"]


def judge(docs: DataFrame, share: float = 0.05, least: int = 4, depleted: float = 0.2, host: str = "source", text: str = "text") -> DataFrame:
    """`docs` with the counts of `with_counts`, n_common_lines, clean_text (without common lines) and kept.

    kept is false if the base rules fail or less than `depleted` of the characters in lines remain. The table of common lines is
    written first, so Catalyst broadcasts it only if its real size is small, and else splits hot hosts in the join. A column of `docs` that is
    called like a result (RESULTS) gives way to it; all others come back as they are, whatever their names.
    """
    names = [c for c in docs.columns if c not in RESULTS]
    common = boilerplate(docs, share, least, host, text)
    # The row travels as one column beside the work columns.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    text = f"_row.`{text}`"
    body = F.coalesce(F.col(text), F.lit(""))
    out = with_counts(rows.withColumn("_host", F.coalesce(F.col(f"_row.`{host}`"), F.lit(""))), text).join(common, "_host", "left")
    seen = F.transform(F.col("_lines"), lambda line: F.struct(F.length(line).alias("n"), F.array_contains("_common", line_hash(line)).alias("common")))
    out = out.withColumn("_seen", F.when(F.col("_common").isNotNull(), seen))
    chars = lambda which: F.aggregate(which, F.lit(0).cast("long"), lambda n, x: n + x["n"])
    out = out.withColumn("_gone", F.filter("_seen", lambda x: x["common"]))
    n_common = F.coalesce(F.size("_gone"), F.lit(0))
    stays = F.filter(F.split(body, "\n"), lambda line: ~F.array_contains("_common", line_hash(line)))
    poor = (n_common > 0) & (chars(F.col("_seen")) - chars(F.col("_gone")) < depleted * chars(F.col("_seen")))
    out = (
        out.withColumn("n_common_lines", F.when(F.col("_seen").isNull(), 0).otherwise(n_common).cast("long"))
        .withColumn("clean_text", F.when(F.col("n_common_lines") > 0, F.array_join(stays, "\n")).otherwise(F.col(text)))
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce(poor, F.lit(False)))
    )
    # A filter on kept would be pushed below all these columns and carry a copy of each; it stops at a generator.
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], *RESULTS[:-1], F.explode(F.array("kept")).alias("kept"))
