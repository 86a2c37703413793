"""License scan by a positional index of licence words, in column functions only.

1. Count, over all documents, in how many each template word stands (its IDF in this corpus).
2. Index the rarest word of each template's mandatory phrase with its place. A copy holds that word in its place, so no copy
   is missed; a template without a phrase has all its words indexed.
3. Look up the indexed words of every document, in place, with the words around each hit that the longest template reaches.
4. A hit at p of a posting at q speaks for a copy of the template at p - q. All words of the template are compared with the
   text in their places; a copy counts if those that agree hold at least `share` of the IDF, and every mandatory phrase
   stands in its place.

Only hits are shuffled, once per distinct text. Postings are as many as the templates' words and travel as literals.

Defined results: a null text is an empty one: no words, no labels, score 0. Repeated rows and null ids get a row each, with
their text's result. Extra columns are ignored. Without documents there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.session import materialize

#: What stands between words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases that alone decide. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial", ("attribution noncommercial",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), GAP), "")


def frequencies(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each of `words` stands; at most one row per word comes to the driver."""
    found = F.array_distinct(F.filter(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: w.isin(words)))
    counted = docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {**dict.fromkeys(words, 0), **{r["w"]: r["n"] for r in counted.collect()}}


def postings(templates: tuple[Template, ...], n: dict[str, int]) -> list[tuple]:
    """(word, template, place): the rarest word of a template's first phrase, or all its words if it has none."""
    out = []
    for t, template in enumerate(templates):
        words = template.text.split()
        places = _places(words, template.phrases[0]) if template.phrases else range(len(words))
        if template.phrases:
            places = [min(places, key=lambda i: (n[words[i]], words[i], i))]
        out += [(words[i], t, i) for i in places]
    return out


def _places(words: list[str], phrase: str) -> range:
    """Where a phrase stands in a template."""
    part = phrase.split()
    start = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
    return range(start, start + len(part))


def weighted(templates: tuple[Template, ...], n: dict[str, int]) -> list[tuple]:
    """(template, label, words, weights, must): the IDF of each word, and whether it belongs to a mandatory phrase."""
    total = max([1, *n.values()])
    out = []
    for t, template in enumerate(templates):
        words = template.text.split()
        must = {i for phrase in template.phrases for i in _places(words, phrase)}
        # Monotone in the IDF and never zero.
        out.append((t, template.label, words, [log(1.0 + total / (1 + n[w])) for w in words], [i in must for i in range(len(words))]))
    return out


def _base(words: Column, phrases: dict[str, str]) -> Column:
    """(place, label) of every base phrase, words counted from 0."""

    def of(phrase: str, label: str) -> Column:
        part = phrase.split()
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.slice(words, i, len(part)) == F.array(*map(F.lit, part)))
        return F.transform(at, lambda i: F.struct((i - 1).cast("long").alias("at"), F.lit(label).alias("label")))

    return F.concat(*(of(*x) for x in phrases.items()))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literals."""
    values = F.array(*(F.struct(*map(F.lit, r)) for r in rows)).cast(f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))
    return spark.range(1).select(F.inline(values))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, share: float = 0.6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) per document.

    matches: (label, at, score) of every verified template copy.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    n = frequencies(docs, vocabulary, text)
    index = postings(templates, n)
    around = max([1, *(len(t.text.split()) for t in templates)]) - 1
    indexed = sorted({p[0] for p in index})

    body = F.coalesce(F.col("_text"), F.lit(""))
    maybe = reduce(or_, (_lower(body).rlike(GAP.join(p.split())) for p in base))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    rows = rows.withColumn("_words", words_of(body))
    # Candidates for a base phrase are those whose letters hold it; the words decide.
    rows = rows.withColumn("_placed", F.when(maybe, F.struct(F.col("_words").alias("w"))))
    places = F.array_sort(F.when(F.col("_placed").isNotNull(), _base(F.col("_placed.w"), base)))
    first = lambda i: F.greatest(F.lit(0), i - around)
    near = lambda i: F.slice("_words", first(i) + 1, i - first(i) + around + 1)
    hits = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("w"), i.alias("p")))), lambda x: x.isNotNull())
    rows = rows.withColumn("_base", places).withColumn("_found", hits)
    facts = materialize(
        rows.select(
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.coalesce(F.col("_base"), F.array().cast("array<struct<at:bigint,label:string>>")).alias("_base"),
            F.when(F.size("_found") > 0, F.struct(F.xxhash64(body).alias("a"), F.crc32(body).alias("b"), F.length(body).alias("n"))).alias("_id"),
            F.transform("_found", lambda x: F.struct(x["w"].alias("w"), x["p"].alias("p"), first(x["p"]).alias("first"), near(x["p"]).alias("near"))).alias("_hits"),
        )
    )

    full = weighted(templates, n)
    table = _rows(spark, [(w, q, *full[t]) for w, t, q in index], "w string, q int, t int, label string, words array<string>, weights array<double>, must array<boolean>")
    at = F.col("p") - F.col("q")
    agree = F.transform("words", lambda word, i: F.coalesce(F.get("near", at + i - F.col("first")) == word, F.lit(False)))
    added = lambda weights: F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    copies = (
        facts.filter(F.col("_id").isNotNull()).select("_id", "_hits").dropDuplicates(["_id"])
        .select("_id", F.explode("_hits").alias("h")).select("_id", "h.*")
        .join(F.broadcast(table), "w")
        .withColumn("agree", agree)
        .filter(F.forall(F.zip_with("agree", "must", lambda a, m: a | ~m), lambda x: x))
        .withColumn("score", added(F.zip_with("agree", "weights", lambda a, x: F.when(a, x).otherwise(0.0))) / added("weights"))
        .filter(F.col("score") >= share)
        .groupBy("_id").agg(F.collect_set(F.struct(at.cast("long").alias("at"), "label", "score", "t")).alias("found"))
        .select("_id", F.array_sort(F.transform("found", lambda m: F.struct(m["at"].alias("at"), m["label"].alias("label"), m["score"].alias("score")))).alias("matches"))
    )
    out = facts.join(materialize(copies), "_id", "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    matches = F.coalesce("matches", F.array().cast("array<struct<at:bigint,label:string,score:double>>"))
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["score"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.when(F.size("_base") > 0, F.col("_base")[0]["at"]).alias("first_word"),
        F.when(F.size("_base") > 0, F.array_max("_base")["at"]).alias("last_word"),
        joined(F.col("_base.label")).alias("base_labels"),
        joined(F.concat(F.col("_base.label"), F.transform(matches, lambda m: m["label"]))).alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(best).alias("score"), matches.alias("matches"),
    )
