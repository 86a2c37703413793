"""One query per operator of this subpackage, with production parameters, and the SQL that must agree with it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfill.llm import bpe, chats, jaccard, languages, licenses, line_rules, packing, phrases, topk, toxicity, url_cascade, weak_labels, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op2_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(_table(spark, sf_dir, "conversations"), part=256)


OP2_SQL = """
WITH t AS (
  SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS BIGINT) AS place
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
line AS (SELECT conv_id, place, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line, md5(to_json([role, text])) AS h FROM t),
pre AS (SELECT conv_id, place + 1 AS size, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY place)) AS h, max(place + 1) OVER (PARTITION BY conv_id) AS last FROM line),
whole AS (SELECT size, h, min(conv_id) AS conv_id, count(*) AS n_equal FROM pre WHERE size = last GROUP BY size, h),
kept AS (SELECT conv_id, size, n_equal FROM whole WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.size < pre.last AND pre.size = whole.size AND pre.h = whole.h))
SELECT conv_id, CAST(place // 256 AS INTEGER) AS part, count(*) AS n_turns, string_agg(line, '' ORDER BY place) AS text, any_value(size) AS size, any_value(n_equal) AS n_equal
FROM line JOIN kept USING (conv_id) GROUP BY conv_id, place // 256
"""


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.learn(docs, labels.filter(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxic_lexicon(docs, _table(spark, sf_dir, "labels")), "tox")
    predicted = (F.col("tox.score") >= 0.5).cast("int")
    return found.select("doc_id", held_out().alias("held_out"), F.col("tox.score").alias("score"), predicted.alias("predicted"), F.size("tox.terms").alias("n_terms"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, _vocabulary("word_bpe_49k.json"), bpe.with_digests, ("ids_sha256", "decoded_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    return packing.best_fit_packing(docs, _vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    _, scorer = weak_labels.train(docs)
    found = weak_labels.scored(docs, scorer, "score")
    return found.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


#: Rules of the filter. Fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hosts that bear one of these words are listed.
LISTED = "casino|poker|free-bets|adult|pills|payday|warez"


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    hosts = pages.select(url_cascade.host_of(F.col("url")).alias("host")).distinct()
    return url_cascade.judge(pages, RULES, hosts.filter(F.col("host").rlike(LISTED))).drop("listed")


OP7_SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(what, name, start)),
fits AS (
  SELECT page_id, max_by(name || start, length(name || start)) AS rule, max_by(what, length(name || start)) AS what
  FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule,
  coalesce(what, CASE WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits ON p.page_id = fits.page_id
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantised(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_lines"]
    return line_rules.judge(_table(spark, sf_dir, "documents")).select(*names)


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
grams AS (SELECT rid, i, w[i:i+4] AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, unnest(range(5)) AS u(o) GROUP BY rid),
lines AS (SELECT rid, host, text, line,
    regexp_replace(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sizes AS (SELECT host, count(DISTINCT text) AS n_texts FROM d GROUP BY host),
common AS (SELECT host, norm FROM lines JOIN sizes USING (host) GROUP BY host, norm, n_texts HAVING count(DISTINCT text) > 4 AND count(DISTINCT text) > 0.05 * n_texts),
per AS (SELECT rid, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars, count(c.norm) AS n_common, coalesce(sum(length(line)) FILTER (WHERE c.norm IS NOT NULL), 0) AS gone
  FROM lines l LEFT JOIN common c ON c.host = l.host AND c.norm = l.norm GROUP BY rid),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_common, 0) AS n_common_lines, coalesce(n_common > 0 AND chars - gone < 0.2 * chars, false) AS poor
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN per USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT poor AS kept, n_common_lines FROM b
"""


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), size=4, threshold=85)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT rid, w[i:i+3] AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.y FROM reach r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN reach ON reach.a = d.rid JOIN d o ON o.rid = reach.b GROUP BY d.rid, d.doc_id
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.quantised(_table(spark, sf_dir, "embeddings")), most=4)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=30, most=2000, share=80)


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, size, phrase, count(*) AS f
  FROM (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i))
  GROUP BY lang, size, phrase HAVING count(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:size], ' ') AS rest FROM c, unnest(range(1, size)) AS s(k)),
sc AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM sc) WHERE o = 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest(range(2, size)) AS s(k), unnest(range(1, size - k + 2)) AS u(i) GROUP BY 1, 2),
free AS (
  SELECT low.* FROM low LEFT JOIN inside ON inside.lang = low.lang AND inside.phrase = low.phrase
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT best.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
"""


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = languages.learn(docs.filter(~held_out()), F.crc32(F.col("doc_id").cast("string")) % 5 == 4)
    found = languages.predicted(docs, model, "found")
    return found.select("doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.ambiguous").alias("ambiguous"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_chats, op3_toxicity, op4_bpe, op5_packing, op6_weak_labels, op7_url_cascade, op8_top_k, op9_line_rules, op10_jaccard,
                                  op11_whitening, op12_phrases, op13_languages)}
ORACLES = {"op2_chats": OP2_SQL, "op7_url_cascade": OP7_SQL, "op8_top_k": OP8_SQL, "op9_line_rules": OP9_SQL, "op10_jaccard": OP10_SQL, "op12_phrases": OP12_SQL}
