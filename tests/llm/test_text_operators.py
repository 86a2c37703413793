"""License scan, toxicity, encoding, packing, quality model and line rules against brute force, and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridfill.llm import bpe, licenses, line_rules, packing, queries, toxicity, weak_labels

SF = "/root/testdata/sf0.001"
ODD = [
    (None, None), (None, "word"), (1, ""), (2, " \t\n\r "), (3, "a a a a a a a a a a a a"), (3, "a a a a a a a a a a a a"),
    (4, "é́ ΣΣ \U0001f600  x　y\x1cz\x85 \U0003d097"), (5, "x" * 60_000), (6, "word " * 20_000), (7, "a\n\n  b   c \n"),
    (8, "<|endoftext|>a<|startoftext|> 12,5 don't"), (9, "Under the MIT-license, under the MIT license; CC BY-NC 4.0"), (10, "line\nline\nother\nline"),
    (11, "one two three four five six one two three four five six seven eight nine ten"),
]
CLASH = ["key", "n", "text_", "node", "label", "words", "ids", "score", "kept", "_words", "_host", "_text", "place", "h"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def license_facts(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_license_base_facts(docs, odd):
    for df in (docs, odd):
        expected = Counter((r.doc_id, *license_facts(r.text)) for r in df.collect())
        assert rows(licenses.scan(df), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected


def test_license_templates_need_their_phrases(spark):
    filler = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"{filler} This work is licensed under the GNU General Public License, version 3. {filler}"), (2, "licensed work version under"), (3, "general public gnu license 3"),
                                (4, "permission is hereby granted free of charge, to any person obtaining a copy of this software")], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert found[1].labels == "gpl-3" and found[1].matches[0].at == 50 and found[1].score == 1.0
    assert found[2].labels == found[3].labels == "" and found[4].labels == "mit"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_license_copies_are_judged_by_all_their_words(spark):
    filler = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"{filler} redistribution or use in source and binary forms with or without modification is permitted {filler}"),
                                (2, f"{filler} permission is hereby granted free of charge to any person who is obtaining a copy of this software {filler}"),
                                (3, f"{filler} source and binary forms {filler}")], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert found[1].labels == "bsd" and found[1].matches[0].at == 40 and 0.6 <= found[1].score < 1  # two words of its four rarest are changed
    assert found[2].labels == "mit" and found[2].matches[0].at == 40  # what follows the new words is out of place
    assert found[3].labels == "" and found[3].score == 0


def line_facts(text):
    w = spaced(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_line_counts(docs, odd):
    for df in (docs, odd):
        expected = Counter((r.doc_id, *line_facts(r.text)) for r in df.collect())
        assert rows(line_rules.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    body = lambda i: " ".join(f"{'abcdefghijkl'[k]}{chr(97 + i % 26)}{'z' * (i // 26)}" for k in range(12))  # noqa: E731  no digits: they count as equal
    data = [(i, "h", f"Subscribe NOW 5 times\n{body(i)}") for i in range(30)] + [(100, "h", "\n".join(["subscribe now  77 times"] * 30 + ["a b c"]) + " d e f g h i j k")]
    data += [(200 + i, "h", f"copied\n{body(99)}") for i in range(30)] + [(300, "other", f"subscribe now 5 times\n{body(300)}")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    found = {r.doc_id: r for r in line_rules.judge(df, share=0.5, least=10, depleted=0.2).collect()}
    assert all(found[i].n_common_lines == 1 and found[i].clean_text == body(i) and found[i].kept for i in range(30))
    assert found[100].n_common_lines == 30 and not found[100].kept
    assert all(found[200 + i].n_common_lines == 0 for i in range(30))  # exact copies are one text
    assert found[300].n_common_lines == 0 and found[300].kept
    assert line_rules.judge(df, 0.5, 10).filter("kept").count() == sum(r.kept for r in found.values())


def test_small_hosts_lose_their_boilerplate(spark):
    data = [(i, "small", f"Cookie notice of this site\n{' '.join(f'w{chr(97 + i)}{chr(97 + k)}' for k in range(14))}") for i in range(10)]
    data += [(100 + i, "tiny", f"Shared by four\n{' '.join(f'v{chr(97 + i)}{chr(97 + k)}' for k in range(14))}") for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumn("kept", F.lit("mine")).withColumn("_words", F.lit(1))
    found = {r.doc_id: r for r in line_rules.judge(df).collect()}
    assert all(found[i].n_common_lines == 1 and "Cookie" not in found[i].clean_text and found[i].kept is True and found[i]["_words"] == 1 for i in range(10))
    assert all(found[100 + i].n_common_lines == 0 for i in range(4))


def test_common_lines_are_found_where_the_sql_is_compared(spark):
    assert queries.op9_line_rules(spark, "/root/testdata/sf0.01").filter("n_common_lines > 0").count() > 0


def test_exceptions_in_a_long_text_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({"trash": 5.0, "clown": 5.0, "can": 4.5}, toxicity.EXCEPTIONS)
    matcher, start = toxicity.Matcher(lexicon), time.time()
    assert matcher.find("trash can " * 100_000 + "trash") == [(1_000_000, 1_000_005, "trash")]
    assert time.time() - start < 5
    assert [t for *_, t in matcher.find("circus clown fish clown trash bin can")] == ["clown", "can"]


def test_bpe_matches_the_library_and_decodes(docs, odd):
    vocabulary = queries._vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(vocabulary)
    for df in (docs, odd):
        found = bpe.encode_decode(df, vocabulary).collect()
        texts = Counter((r.doc_id, r.text or "") for r in df.collect())
        expected = Counter()
        for (i, text), n in texts.items():
            ids = library.encode(text, add_special_tokens=False).ids
            expected[i, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)] += n
        assert Counter(map(tuple, found)) == expected
    digests = bpe.encode_decode(odd, vocabulary, bpe.with_digests, ("a", "b")).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter(tuple(r) for r in digests) == Counter((r.doc_id, r.n_tokens, sha(r.ids), sha(r.decoded)) for r in bpe.encode_decode(odd, vocabulary).collect())


def test_bpe_merges_lowest_rank_then_leftmost():
    merges = bpe.Merges({"vocab": {"a": 0, "b": 1, "ab": 2, "aa": 3, "aab": 4, "aaa": 5}, "merges": [["a", "b"], ["a", "a"], ["a", "ab"], ["aa", "a"]]})

    def plain(word):
        word = list(word)
        rank = {p: (r, m) for p, r, m in [((0, 1), 0, 2), ((0, 0), 1, 3), ((0, 2), 2, 4), ((3, 0), 3, 5)]}
        while pairs := [(rank[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in rank]:
            i = min(pairs)[1]
            word[i : i + 2] = [rank[word[i], word[i + 1]][1]]
        return word

    rng = random.Random(0)
    words = [[rng.choice([0, 0, 1]) for _ in range(rng.randrange(0, 40))] for _ in range(300)]
    flat, counts = bpe.merge_all(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words]), merges)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [plain(w) for w in words]


def test_packing_round_trip(docs, odd):
    vocabulary = queries._vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_str(vocabulary)
    for df in (docs, odd):
        packed = packing.best_fit_packing(df, vocabulary).collect()
        pieces, places = Counter(), defaultdict(list)
        for r in packed:
            ids = np.frombuffer(r.ids, "<u4")
            assert len(ids) == r.length <= 1024
            pieces[r.doc_id, r.piece, r.start, ids.tobytes()] += 1
            places[r.sequence_id].append((r.offset, r.length))
        expected = Counter()
        for r in df.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
                expected[r.doc_id, k, start, ids[start : start + n].tobytes()] += 1
        assert pieces == expected
        for taken in places.values():
            at = 0
            for offset, n in sorted(taken):
                assert offset == at
                at += n
            assert at <= 1024
        total = sum(n for taken in places.values() for _, n in taken)
        assert len(places) <= 1.05 * total / 1024 + 2


@pytest.mark.parametrize("doc_id", [None, 7])
def test_pieces_of_rows_that_share_an_id_are_spread(spark, doc_id):
    rows = [(doc_id, 0, 0, 2, np.array([i, 2], "<u4").tobytes()) for i in range(400)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids binary")
    packed = packing.pack(pieces, 16, 8).collect()
    assert Counter(bytes(r.ids) for r in packed) == Counter(r[4] for r in rows)
    parts = Counter(r.sequence_id >> 32 for r in packed)
    assert len(parts) == 8 and max(parts.values()) < 100


def test_two_fit_beats_greedy_filling():
    lengths = np.array([6, 4, 3, 3, 4])  # greedy: 6+4, 4+3+3; both ways need two sequences of ten
    place, offset, made = packing.two_fit(lengths, 10)
    assert made == 2 and all(lengths[place == b].sum() == 10 for b in range(2))
    place, _, made = packing.two_fit(np.array([7, 2, 2, 1]), 10)
    assert made == 2 and np.array([7, 2, 2, 1])[place == 0].sum() == 10
    assert packing.two_fit(np.array([], np.int64), 10)[2] == 0


def test_chunked_ids_equal_whole_texts():
    vocabulary = queries._vocabulary("byte_bpe_50k.json")
    ids, library, rng = packing.TextIds(vocabulary), Tokenizer.from_str(vocabulary), random.Random(5)
    pool = [0x20] * 4 + [0x9, 0xA, 0xD, 0x1C, 0x85, 0xA0, 0x2003, 0x3000, 0x61, 0x62, 0x27, 0x73, 0x31, 0x2E, 0xE9, 0x301, 0x4E2D, 0x1F600]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["a<|endoftext|> b", "", " "]
    assert ids.encode(pa.array(texts)) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_toxicity_learns_from_the_other_rows_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon = queries.toxic_lexicon(docs, labels)
    held = docs.join(labels, "doc_id").filter(queries.held_out()).filter("lang = 'en'")
    found = toxicity.scored(held, lexicon, "t").select("toxic", F.col("t.score").alias("score")).toPandas()
    assert ((found.score >= 0.5) == (found.toxic == 1)).mean() > 0.97
    changed = labels.withColumn("toxic", F.when(queries.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert queries.toxic_lexicon(docs, changed) == lexicon


def test_toxicity_counts_repeated_rows_once(spark):
    data = [(i, f"you {'moronic' if i % 4 == 0 else 'pleasant'} person {i}", int(i % 4 == 0)) for i in range(400)] + [(400, "a moronic but harmless word", 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    again = df.union(df.filter("doc_id = 400").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(5_000)))))
    expected = toxicity.learn(df.drop("toxic"), df.drop("text"))
    assert expected.weights and expected.slope > 0
    assert toxicity.learn(again.drop("toxic"), df.drop("text")) == expected


def test_toxic_terms_are_folded_and_excused(spark, odd):
    lexicon = toxicity.Lexicon({"trash": 5.0, "idio*": 6.0}, ("trash can",), slope=3.0, bias=-3.0)
    matcher = toxicity.Matcher(lexicon)
    terms = lambda t: [x for *_, x in matcher.find(t)]
    assert terms("TR4SH, 1d10ts and trаsh") == ["trash", "idio*", "trash"]
    assert terms("trash can trashy notidiot") == [] and terms("a trash can of trash") == ["trash"]
    assert matcher.strength("trash")[0] > matcher.strength("trash " + "w " * 500)[0] > 0
    found = toxicity.scored(odd, lexicon, "t").select("doc_id", "t.score", "text", *CLASH)
    assert found.count() == len(ODD) and all(r.score < 0.5 for r in found.collect())
    assert toxicity.learn(odd, spark.createDataFrame([], "doc_id long, toxic int")) == toxicity.Lexicon()


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(len(good)) < 0.3, 0, np.where((rng.random(len(good)) < a) == good, 1, -1)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.expectation_maximisation(("a", "b", "c", "d"), patterns, counts.astype(float))
    assert all(abs(x - a) < 0.06 for x, a in zip(model.accuracies.values(), accuracy))
    assert abs(model.prior - 0.8) < 0.06 and (model.posterior(votes).round() == good).mean() > 0.93


def test_quality_scores(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    _, scorer = weak_labels.train(docs)
    found = weak_labels.scored(docs, scorer, "p").join(labels, "doc_id").select("p", F.col("quality").alias("y")).toPandas()
    rank, ones = found.p.rank(), found.y.sum()
    auc = (rank[found.y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(found) - ones))
    assert auc > 0.95 and (found.p[found.y == 1] >= 0.5).mean() > 0.98
    assert weak_labels.scored(odd, scorer, "p").count() == len(ODD)


def test_copies_do_not_use_up_the_quality_sample(spark, docs):
    texts = docs.select("text").dropna().distinct()
    model = weak_labels.label_model(texts)
    plenty = spark.range(20_000).select(F.concat_ws(" ", F.lit("one text"), "id").alias("text"))
    copied = plenty.orderBy(F.xxhash64("text")).limit(1).select("text")
    assert copied.select(F.xxhash64("text")).first()[0] < texts.agg(F.min(F.xxhash64("text"))).first()[0]  # it is first in the sample
    copies = copied.select("text", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).select("text")
    expected = weak_labels.fit_scorer(texts.union(copied), model)
    found = weak_labels.fit_scorer(texts.union(copies), model)
    assert np.count_nonzero(expected.weights) > 100
    assert np.array_equal(found.weights, expected.weights) and found.bias == expected.bias


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert licenses.scan(none).count() == line_rules.judge(none).count() == 0
    assert bpe.encode_decode(none, queries._vocabulary("word_bpe_49k.json")).count() == 0
    assert packing.best_fit_packing(none, queries._vocabulary("byte_bpe_50k.json")).count() == 0
    _, scorer = weak_labels.train(none)
    assert weak_labels.scored(none, scorer, "p").count() == toxicity.scored(none, toxicity.Lexicon(), "t").count() == 0
