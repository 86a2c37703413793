"""From raw documents to packed training sequences, in stages that are written as Parquet and read again.

All stages but the last return the columns of `documents`. Null texts and ids, empty and very long texts, repeated rows and extra
columns are handled as the operators' modules say; an empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.llm import jaccard, line_rules, queries, toxicity
from gridfill.session import materialize


def _packed(docs: DataFrame, *beside: str) -> DataFrame:
    """The named columns beside one column `row` that holds all others, so that no stage's own columns can clash with them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in beside]
    return docs.select(*beside, (F.struct(*rest) if rest else F.struct(F.lit(None).alias("none"))).alias("row"))


def _unpacked(rows: DataFrame, columns: list[str], *beside: str) -> DataFrame:
    return rows.select(*[F.col(c) if c in beside else F.col("row")[c].alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their host's boilerplate lines; n_chars follows the text."""
    judged = line_rules.judge(_packed(docs, "source", "text")).filter("kept")
    n_chars = F.when(F.col("n_common_lines") > 0, F.length("clean_text").cast("long")).otherwise(F.col("row")["n_chars"])
    judged = judged.withColumn("n_chars", n_chars).withColumn("text", F.col("clean_text"))
    return _unpacked(judged, docs.columns, "source", "text", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled rows, does not call toxic."""
    lexicon = queries.toxic_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.scored(_packed(docs, "text"), lexicon, "found").filter(F.col("found.score") < 0.5)
    return _unpacked(found, docs.columns, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 over five-word shingles connect."""
    return _unpacked(jaccard.one_of_each(_packed(docs, "doc_id", "text"), size=5, threshold=80), docs.columns, "doc_id", "text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences that hold all remaining documents, piece by piece."""
    return queries.packed(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", best_fit_packing),
]
#: Learning, components and tokenisation cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
