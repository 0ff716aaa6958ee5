"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm import ann, embdup, lmscore, mixing, neardup, packing, substring, toxicity, urlfilter, warc
from edgeloom.llm.common import read

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(read(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.embedding_links(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "log10_score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), context=2048, buckets=16, budget=32_768)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages, URL_RULES).drop("url")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.convert_pages(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_report(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_lm_scores": op3_lm_scores,
    "op4_nearest": op4_nearest,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_url_filter": op8_url_filter,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), per_source AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM per_source
), weighted AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS weight,
         3 * source_size AS cap, sum(source_size) OVER ()::HUGEINT AS words
  FROM ranked
), steps AS (
  SELECT *, words - coalesce(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS left_words,
         sum(weight) OVER (ORDER BY cap / weight::DOUBLE, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS left_weight
  FROM weighted
), lvl AS (
  SELECT left_words::DOUBLE / left_weight::DOUBLE AS level FROM steps
  WHERE cap * left_weight > left_words * weight ORDER BY cap / weight::DOUBLE, source_rank LIMIT 1
), targets AS (
  SELECT source, source_rank, weight::BIGINT AS weight, source_size::BIGINT AS source_size, words::BIGINT AS words,
         CASE WHEN level IS NULL OR cap <= level * weight THEN cap::DOUBLE ELSE level * weight END AS target
  FROM steps LEFT JOIN lvl ON true
), queued AS (
  SELECT s.doc_id, s.size, t.*, sum(s.size) OVER (PARTITION BY source_rank ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), packets AS (
  SELECT *, (done + epoch * source_size)::DOUBLE / weight AS finish FROM queued, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank ROWS UNBOUNDED PRECEDING) AS reached FROM packets
), cut AS (
  SELECT finish AS cf, source_rank AS cr FROM run WHERE reached <= words ORDER BY finish DESC, source_rank DESC LIMIT 1
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 OR cf IS NULL THEN 0 ELSE size * (
         ((done::DOUBLE / weight, source_rank) <= (cf, cr))::INT
         + (((done + source_size)::DOUBLE / weight, source_rank) <= (cf, cr))::INT
         + (((done + 2 * source_size)::DOUBLE / weight, source_rank) <= (cf, cr))::INT) END::BIGINT AS taken
FROM queued LEFT JOIN cut ON true
""",
    "op8_url_filter": r"""
WITH located AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT page_id, host, path, rh || rp AS rule, coalesce(verdict, 'allow') AS verdict
FROM located LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC) = 1
""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b,
         list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y) / (a.norm * b.norm) AS cosine
  FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
), links AS (
  SELECT a, b FROM pairs WHERE cosine >= 0.93 UNION ALL SELECT b, a FROM pairs WHERE cosine >= 0.93
), reach(v, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.v
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
), c AS (
  SELECT v AS vec_id, min(c) AS component_id FROM reach GROUP BY v
)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
""",
    "op3_lm_scores": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), t AS (
  SELECT doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i - 1] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] END AS w1, len(ws) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), n AS (
  SELECT count(*) AS total FROM t
), c AS (
  SELECT *, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY w3, doc_id) AS c1,
         count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY w2, w3, doc_id) AS c2,
         count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY w1, w2, w3, doc_id) AS c3
  FROM t
), h AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM c
), s AS (
  SELECT doc_id, CASE
    WHEN i > 2 AND c3 > 0 THEN log10(c3 / h2::DOUBLE)
    WHEN i > 1 AND c2 > 0 THEN log10(c2 / h1::DOUBLE) + CASE WHEN i > 2 THEN log10(0.4::DOUBLE) ELSE 0 END
    ELSE log10(greatest(c1, 1) / greatest(total - n, 1)::DOUBLE) + CASE WHEN i > 1 THEN log10(0.4::DOUBLE) ELSE 0 END + CASE WHEN i > 2 THEN log10(0.4::DOUBLE) ELSE 0 END
  END AS s FROM h, n
), d AS (
  SELECT doc_id, sum(round_even(s * 1e6, 0)::BIGINT)::BIGINT AS m FROM s GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, round(m / 1e6, 3) AS log10_score FROM w LEFT JOIN d USING (doc_id)
""",
    "op4_nearest": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v
  WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda x, y: x + y) / (a.norm * b.norm) AS score
  FROM ok a JOIN ok b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
) WHERE rank <= 5
""",
    "op5_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), sh AS (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), c AS (
  SELECT doc_id, s, count(*) AS n FROM sh GROUP BY doc_id, s
), t AS (
  SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS o FROM c x JOIN c y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN t p ON p.doc_id = a JOIN t q ON q.doc_id = b WHERE o::DOUBLE / (p.t + q.t - o) >= 0.8
), links AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(v, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, r.c FROM reach r JOIN links ON links.a = r.v
), cls AS (
  SELECT v AS doc_id, min(c) AS class_id FROM reach GROUP BY v
)
SELECT d.doc_id, class_id, class_id = d.doc_id AS kept FROM documents d JOIN cls USING (doc_id)
""",
    "op10_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS lo FROM win) WHERE lo < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM dup, range(0, 50) r(k)
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
