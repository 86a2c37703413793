"""Whitening, phrases and languages against brute force, held-out rows, and on odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfill.llm import languages, phrases, queries, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening

def exact_covariance(rows):
    fit = sorted(set(map(tuple, rows)))
    n, d = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    v = [[Fraction(sum(r[i] * r[j] for r in fit) * n - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(x) for x in row] for row in v])


@pytest.mark.parametrize("kind", ["plain", "offset", "graded", "wide"])
def test_whitening_equals_dense_eigenvectors(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)
    if kind == "offset":
        x = x / 50 + 1e6
    elif kind == "graded":
        x = x * 10.0 ** -np.arange(12)[::-1] * 1e5
    elif kind == "wide":
        x = x * 1e9
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = [[int(np.floor(256 * c)) for c in r] for _, r in rows]
    n, s, v = exact_covariance(whole)
    value, vectors = np.linalg.eigh(v)
    value, vectors = value[::-1][:4], vectors[:, ::-1][:, :4]
    found = whitening.whiten(whitening.quantised(df)).collect()
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n}
    by = {(r.vec_id, r.component): r for r in found}
    signs = None
    for (i, _), r in zip(rows, whole, strict=True):
        deviation = sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(r, s, strict=True)])
        expected = centred @ vectors / np.sqrt(value)
        mine = np.array([by[i, k].whitened for k in range(1, 5)])
        if signs is None:
            signs = np.where(mine * expected < 0, -1, 1)
        assert by[i, 1].deviation == (deviation if deviation < 1 << 63 else None)
        assert np.allclose(mine, expected * signs, atol=1e-6)
    assert np.allclose([by[0, k].explained for k in range(1, 5)], value / np.trace(v), rtol=1e-6)
    assert found[0].identity_error < 1e-6


def test_intervals_count_and_separate():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    for values in ([5, 5, 5, 5, 5, 1] + [0.5] * 24, [9, 8, 2, 2 - 1e-9] + [1] * 26, np.linspace(1, 2, 30), [1] + [0] * 29, [1e6, 10, 9.99, 9.98] + [9.97] * 26, [1.0] * 30):
        values = np.sort(np.array(values, float))[::-1]
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        assert whitening.above(v, 1.23) == (values > 1.23).sum()
        e, c = whitening.components(v)
        k = min(4, (values > 1e-9).sum())
        assert len(e) == k and np.allclose(e, values[:k], rtol=1e-9)
        assert np.abs(v @ c - c * e).max() < 1e-12 * values[0] and np.allclose(c.T @ c, np.eye(k), atol=1e-12)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 2.0]), (2, [-0.0, 1.0]), (2, [-0.0, 1.0]), (None, [0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("x", F.lit(1))
    found = whitening.whiten(whitening.quantised(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2), (7, 1), (7, 2)]
    fit = np.array([[256, 512], [0, 256], [128, 0], [0, 0]])
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-12
    assert {r.vec_id: r.deviation for r in found}[1] == ((4 * fit[0] - fit.sum(0)) ** 2).sum()
    for some in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id = 3")):
        assert whitening.whiten(whitening.quantised(some)).collect() == []


# ---------------------------------------------------------------- phrases

def brute_phrases(rows, least, most, share):
    out, f, n = {}, Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    for lang in n:
        cand = {p: c for (x, p), c in f.items() if x == lang and len(p) > 1 and c >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in cand.items()):
                continue
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -score)
    return out


def found_phrases(df, **how):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **how).collect()}


@pytest.mark.parametrize("bits", [None, 4, 8])
def test_phrases_equal_brute_force(spark, monkeypatch, bits):
    if bits:  # so few counters that most windows stay whole: slower, not different
        monkeypatch.setattr(phrases, "LEAST_BITS", bits)
        monkeypatch.setattr(phrases, "MOST_BITS", bits)
    rng = random.Random(5)
    vocabulary = ["The", "oF", "Über", "a", "new", "york", "x y", "日本", "b"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", ", ", "\n", ".", "  "]) for _ in range(rng.randrange(0, 60)))) for _ in range(150)]
    rows += [("en", "a a a a a a a"), ("en", None), (None, None), ("en", ""), ("fr", "..., \n"), ("it", "one two three four five " * 40), ("it", "x")] + [("es", "same line here again")] * 50
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit(1)).withColumn("w1", F.lit("clash")).repartition(6)
    for how in ({"least": 5, "most": 2000, "share": 80}, {"least": 30, "most": 3, "share": 50}):
        assert found_phrases(df, **how) == brute_phrases(rows, **how)
    assert found_phrases(df.limit(0)) == {}


def test_a_long_text_and_cut_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 1000)
    rows = [("en", "to be or not to be, that is " * 20_000), ("en", "to be")] + [("en", f"to be w{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert found_phrases(df) == brute_phrases(rows, 30, 2000, 80)


# ---------------------------------------------------------------- languages

@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 40])
def test_codewords_differ(n):
    words = languages.code(n)
    assert words.shape[0] == n and len({tuple(w) for w in words}) == n
    if n > 1:
        apart = min((a != b).sum() for i, a in enumerate(words) for b in words[:i])
        assert apart >= (2 ** (n - 2) if n <= languages.LISTED else 7)


def test_languages_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.op13_languages(spark, folder).collect()
    assert len(found) == len(truth)
    for lang in set(truth.values()):
        rows = [r for r in found if r.held_out and truth[r.doc_id] == lang]
        right = sum(r.lang_pred == lang for r in rows)
        clear = [r for r in rows if not r.ambiguous]
        print(lang, len(rows), right / len(rows), len(clear) / len(rows), sum(r.lang_pred == lang for r in clear) / max(1, len(clear)), np.mean([r.score for r in rows]))
        assert right >= 0.99 * len(rows)


def test_many_languages_and_odd_rows(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzäöéñß"
    parts = {f"l{k}": ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(25)] for k in range(9)}
    text = lambda k: " ".join("".join(rng.choices(parts[k], k=rng.randrange(1, 3))) for _ in range(30))
    rows = [(i, k, text(k)) for i, k in enumerate(list(parts) * 40)]
    rows += [(1000, None, "only a guess"), (1001, "l1", None), (1002, "l1", ""), (1003, "l1", "12 34 -- 5%"), (None, "l2", text("l2")), (5, "l3", text("l3")), (1004, "l0", text("l0") * 3000), (1005, "l2", "— \U0001f600")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("score", F.lit("clash")).withColumn("h", F.lit(7))
    model = languages.learn(df, F.col("doc_id") % 4 == 1)
    found = languages.predicted(df, model, "found").collect()
    assert len(found) == len(rows) and all(r.score == "clash" and r.h == 7 and 0 <= r.found.score <= 1 for r in found)
    real = [r for r in found if r.lang and (r.doc_id is None or r.doc_id < 1000 or r.doc_id == 1004)]
    assert sum(r.found.lang == r.lang for r in real) >= 0.98 * len(real)
    by = {r.doc_id: r.found for r in found if r.doc_id in range(1000, 1006)}
    assert all(by[i].lang == "und" and by[i].score == 0 and by[i].ambiguous for i in (1001, 1002, 1003, 1005))
    assert by[1000].lang in parts
    one = languages.learn(df.filter("lang = 'l4'"), F.lit(False))
    assert {(r.found.lang, r.found.score) for r in languages.predicted(df.limit(5), one, "found").collect()} == {("l4", 1.0)}
    assert languages.learn(df.filter("lang is null"), F.lit(True)) is None
    assert {r.found.lang for r in languages.predicted(df, None, "found").collect()} == {"und"}
    assert languages.predicted(df.limit(0), model).count() == 0
