"""The query that links near-equal vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.llm import near_vectors
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table

LEAST = 0.93

NEAR_SQL = f"""
WITH RECURSIVE whole AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}::DOUBLE),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) r ON vec_id = r.a
LEFT JOIN counts ON vec_id = counts.a
"""


@query("op11_near_vectors", NEAR_SQL)
def near(spark, folder):
    found = near_vectors.linked(table(spark, folder, "embeddings"), LEAST)
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
