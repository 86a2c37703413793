"""Chats, URL cascade, top-k and the Jaccard join against brute force, and on odd rows; the pipeline stage by stage."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridfill.llm import chats, components, jaccard, queries, topk, url_cascade

SF = "/root/testdata/sf0.001"


def test_snapshots_collapse_to_maximal_conversations(spark):
    talk = {1: "abc", 2: "abcde", 3: "abcde", 4: "abx", 5: "a", 6: "xa", 7: "abc"}
    data = [(c, t, "user" if t % 2 == 0 else "bot", x) for c, turns in talk.items() for t, x in enumerate(turns)]
    data += [(8, 10 * t, "user" if t % 2 == 0 else "bot", x) for t, x in enumerate("abcdef")]  # gaps do not matter
    data += [(9, 0, None, None), (9, 0, None, None), (None, 0, "user", "q"), (10, None, "user", "q"), (11, 0, "user", "a"), (11, 0, "bot", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)).withColumn("size", F.lit(2))
    for part in (2, 256):
        found = defaultdict(str)
        for r in sorted(chats.format_chats(df, part).collect(), key=lambda r: (r.conv_id, r.part)):
            assert r.n_turns <= part
            found[r.conv_id] += r.text
        line = lambda role, x: f"<|im_start|>{role}\n{x}<|im_end|>\n"
        said = lambda turns: "".join(line("user" if t % 2 == 0 else "bot", x) for t, x in enumerate(turns))
        assert dict(found) == {8: said("abcdef"), 4: said("abx"), 6: said("xa"), 9: line("unknown", ""), 11: line("bot", "a") + line("user", "a")}
    assert chats.format_chats(df.filter("conv_id > 99")).count() == 0


def test_equal_conversations_leave_one(spark):
    df = spark.createDataFrame([(c, t, "user", f"t{t}") for c in range(5) for t in range(3)], "conv_id long, turn long, role string, text string")
    (r,) = chats.format_chats(df).collect()
    assert (r.conv_id, r.size, r.n_equal) == (0, 3, 5)


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    for listed, others in ((1000, 20_000), (0, 50), (50, 0), (3000, 300)):
        keys = rng.integers(0, 2**63, listed + others).astype(np.uint64)
        levels = url_cascade.from_bytes(url_cascade.to_bytes(url_cascade.build(keys[:listed], keys[listed:])))
        assert (url_cascade.member(levels, keys) == (np.arange(len(keys)) < listed)).all()


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.NET/en/x?y", "http://a.example.net?/en/", "x://y://z/q", "http://example.com/de/1#f", "http://notexample.com/de/1",
            "http://b.org/fr/", "http://bad.host/p", "http://bad.host/p", "http://good.host#a/b", "http://sub.bad.host/", "http://ü.org/fr\n/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_shard", F.lit(1))
    listed = spark.createDataFrame([("bad.host",), ("unseen.host",), ("bad.host",)], "h string")

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in queries.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        return host, path, best and best[1] + best[2], best[0] if best else "block" if host == "bad.host" else "allow"

    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(df, queries.RULES, listed).collect()}
    assert found == {i: expected(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_cascade.judge(df, [], listed.limit(0)).collect()} == {"allow"}
    assert url_cascade.judge(df.limit(0), queries.RULES, listed).count() == 0


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 20)
    keys = spark.range(400).select(F.concat(F.lit("h"), (F.col("id") % 300).cast("string")).alias("host"), "id")
    found = url_cascade.blocked(keys, keys.filter("id % 7 = 0").select("host"))
    assert {r.host for r in found.collect() if r.listed} == {f"h{i % 300}" for i in range(0, 400, 7)}
    assert found.count() == 400


def test_no_random_access_kernel():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, d = rng.integers(1, 60), rng.integers(1, 6)
        data, query = rng.integers(-5, 6, (n, d)).astype(float), rng.integers(-3, 4, d).astype(float)
        own = rng.random((1, n)) < 0.1
        rows, scores = topk.best(topk.Lists(data), query[None], own, 5, np.array([-np.inf]))[0]
        exact = data @ query
        order = [i for i in np.lexsort((np.arange(n), -exact)) if not own[0, i]][:5]
        assert rows.tolist() == order and scores.tolist() == exact[order].tolist()


def test_top_k_with_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = random.Random(2)
    data = [(i, [rng.choice([-0.5, 0.1, 0.25, 1.0]) for _ in range(4)]) for i in range(120)]
    data += [(200, None), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [float("inf")] * 4), (None, [1.0] * 4), (400, []), (3, data[3][1]), (450, [5.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    valid = {i: [np.floor(256 * np.float32(x).astype(float)) for x in v] + [0.0] * (4 - len(v)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = set()
    for q in valid:
        if q % 50 == 0:
            best = sorted(((-int(np.dot(valid[q], valid[i])), i) for i in valid if i != q))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    found = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in found.collect()} == expected
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(topk.quantised(df.filter("vec_id in (0, 1)").distinct()), F.col("vec_id") % 50 == 0).count() == 1


def brute_top_k(rows, k):
    """Of (id, vector) rows, whose ids may repeat; queries are the ids that 50 divides."""
    width = max(len(v) for _, v in rows)
    padded = [(i, [*v, *[0] * (width - len(v))]) for i, v in rows]
    scores = defaultdict(list)
    for q, a in padded:
        if q % 50 == 0:
            scores[q] += [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in padded if i != q]
    return sorted((q, n + 1, i, -s) for q, found in scores.items() for n, (s, i) in enumerate(sorted(found)[:k]))


def test_top_k_sends_no_queries_to_the_driver(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), (F.col("id") % 11).cast("float")).alias("embedding"))
    found = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0)
    assert found.count() == 40
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # whatever Catalyst takes for small
    try:
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize("most", [3, 2**20, 2**28])
def test_top_k_over_shelves_of_several_blocks(spark, monkeypatch, most):
    for name, value in (("BLOCK", 16), ("QUERIES", 4), ("NUMBERS", 256), ("SHELVES", 2), ("HELD", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(most)
    rows = [(i, [rng.randint(-most, most) for _ in range(rng.choice([1, 5, 6, 40]))]) for i in range(200)]
    rows += [(50, [rng.randint(-most, most) for _ in range(6)]) for _ in range(40)]  # an id of many vectors
    rows += [(i, [rng.randint(-3, 3) for _ in range(6)]) for i in range(200, 300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").distinct().repartition(3)
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, 4)
    assert sorted(map(tuple, found.collect())) == brute_top_k({(i, tuple(v)) for i, v in rows}, 4)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(rows, size, threshold):
    """Index of a group per row; rows without words are groups of their own."""
    sets, lists, parent = [shingles(t, size) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        seen = Counter(j for x in s for j in lists[x])
        for j, both in seen.items():
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                parent[top(i)] = top(j)
        for x in s:
            lists[x].append(i)
    return sets, [top(i) for i in range(len(rows))]


def noisy(seed):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(60)]
    for _ in range(50):
        base = [rng.choice(words) + str(rng.randrange(4)) for _ in range(rng.choice([1, 3, 4, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 25, 40, 90, 200]))]
        for _ in range(rng.choice([1, 2, 3, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(w) // 30])):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [rng.choice(words)]
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(None, None), (1000, ""), (1001, None), (None, rows[5][1]), (2000, rows[7][1]), (2000, rows[7][1]), (1002, "A b\x1cc d"), (1003, "a B\x1cc D")]


@pytest.mark.parametrize(("size", "threshold"), [(4, 85), (5, 80)])
def test_jaccard_groups(spark, size, threshold, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # lists are compared in several pairs of blocks
    rows = noisy(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("body", F.lit("x"))
    sets, group = groups(rows, size, threshold)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    expected = Counter((i, len(s), least.get(g) if s else i) for (i, _), s, g in zip(rows, sets, group, strict=True))
    assert Counter(map(tuple, jaccard.jaccard_groups(df, size, threshold).collect())) == expected
    left = jaccard.one_of_each(df, size, threshold)
    assert left.columns == df.columns
    kept, texts = Counter(r.text for r in left.collect()), defaultdict(set)
    for (_, t), g, s in zip(rows, group, sets, strict=True):
        if s:
            texts[g].add(t)
    assert sum(kept.values()) == len(texts) + 3 and all(sum(kept[t] for t in ts) == 1 for ts in texts.values())
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def disturbed(rng, n, most):
    """A random set of n hashes and one that lacks some and has others."""
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
    return np.unique(a), np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))


@pytest.mark.parametrize("sizes", [(113, 124), (169, 185), (380, 417), (853, 940), (2878, 3160), (3500, 3700)])
def test_parts_cover_linked_pairs_at_class_borders(sizes):
    rng = np.random.default_rng(sizes[0])
    for threshold in (80, 85):
        upto = jaccard.boundary(threshold)
        linked = 0
        for _ in range(60):
            n = int(rng.integers(sizes[0], sizes[1] + 1))
            a, b = disturbed(rng, n, n // 8)
            both = len(np.intersect1d(a, b))
            if 100 * both >= threshold * (len(a) + len(b) - both):
                linked += 1
                x, y = (set(jaccard.part_keys(s, upto, threshold).tolist()) for s in (a, b))
                assert x & y
        assert linked > 10


def test_parts_of_unrelated_sets_share_no_key():
    # A key says what a part holds: sets without a common element have none in common, whatever parts they leave empty.
    rng = np.random.default_rng(0)
    for n in (10, 60, 113, 380, 853, 2878):
        seen = Counter(k for _ in range(40) for k in set(jaccard.part_keys(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), 8, 80).tolist()))
        assert max(seen.values()) == 1


def test_heavy_and_light_parts_cover_every_linked_pair():
    rng = np.random.default_rng(3)
    for threshold in (80, 85):
        upto = jaccard.boundary(threshold)
        for _ in range(400):
            n = int(rng.integers(1, 60))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = int(rng.integers(0, max(1, n // 8) + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both < threshold * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                continue
            x, y = (set(jaccard.part_keys(s, upto, threshold).tolist()) for s in (a, b))
            u, v = (set(jaccard.subset_keys(s, upto, threshold)[0]) if len(s) <= upto else set() for s in (a, b))
            assert x & y or u & v, (len(a), len(b), both)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.id: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(51)}) == 1 and len({found[i] for i in range(100, 130)}) == 1 and found[0] != found[100]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_leave_columns_with_names_of_their_own_alone(spark):
    names = ["kept", "n_words", "_words", "_lines", "_host", "_common", "n_common_lines", "clean_text", "_row", "row", "_tox", "found", "tox", "_name", "node", "body", "label", "key", "x", "parts", "none"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) > 20, name
        assert all(r[c] == f"{i}:{r.doc_id}" for r in found for i, c in enumerate(names)), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "too short", "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3)).withColumn("node", F.lit(1))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == docs.columns and 0 < after.count() < before.count() + (name == "toxicity"), name
        before = after
    rows = [(r.doc_id, r.text) for r in before.collect()]
    sets, group = groups(rows, 5, 80)
    assert len(set(group)) == len(rows)
    (_, pack) = corpus_pipeline.STAGES[-1]
    packed = pack(spark, before, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in rows}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)
