"""Queries that compare rows: exact top-k, ranked search and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.llm import fingerprints, lexical, topk
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op5_fingerprints")
def prints(spark, folder):
    return fingerprints.fingerprint_pairs(table(spark, folder, "documents"))


TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS n FROM whole),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.n = c.n
  WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
    AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op6_topk", TOP_SQL)
def top(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), 10, F.col("id") % 100 == 0)


LEXICAL_SQL = r"""
WITH words AS (
  SELECT doc_id, row, unnest(terms) AS term FROM (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)),
sizes AS (SELECT row, count(*)::BIGINT AS n FROM words GROUP BY row),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
counts AS (SELECT doc_id, row, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT)
    AS w FROM counts, corpus GROUP BY term, docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, row,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT)
      AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), corpus
  GROUP BY item_id, doc_id, row),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
    AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_lexical", LEXICAL_SQL)
def lexical_search(spark, folder):
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10)
