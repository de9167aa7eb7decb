"""Queries that deal out, mix and clean rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.llm import line_dedup, mixing, sharding
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op1_sharding")
def shards(spark, folder):
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.stratified_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


PLAIN_LINE = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'))"

LINES_SQL = f"""
WITH docs AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
seen AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(lines,
           lambda x: {PLAIN_LINE.format('x')}), lambda x: x <> ''))) AS line FROM docs),
totals AS (SELECT source, count(*) AS all_pages FROM documents GROUP BY source),
common AS (
  SELECT s.source, list(s.line) AS lines FROM (
    SELECT source, line, count(*) AS pages FROM seen GROUP BY source, line
  ) s JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  WHERE pages >= {line_dedup.MIN_PAGES}
    AND pages > CAST({line_dedup.RATIO} AS DOUBLE) * all_pages
  GROUP BY s.source),
kept AS (
  SELECT d.doc_id, d.source, d.text, d.lines, CASE WHEN c.lines IS NULL THEN d.lines ELSE
    list_filter(d.lines, lambda x: NOT list_contains(c.lines, {PLAIN_LINE.format('x')})) END AS rest
  FROM docs d LEFT JOIN common c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, CASE WHEN len(rest) = len(lines) THEN text
    ELSE array_to_string(rest, chr(10)) END AS text,
  CAST(length(CASE WHEN len(rest) = len(lines) THEN text
    ELSE array_to_string(rest, chr(10)) END) AS BIGINT) AS n_chars,
  CAST(coalesce(len(lines) - len(rest), 0) AS INTEGER) AS dropped_lines
FROM kept
"""


@query("op3_line_dedup", LINES_SQL)
def lines(spark, folder):
    docs = table(spark, folder, "documents")
    return line_dedup.drop_boilerplate(docs).select(
        "doc_id", "source", "text", "n_chars", "dropped_lines"
    )


MIX_SQL = f"""
WITH found AS (
  SELECT doc_id, source, count(*) AS times_found,
    coalesce(len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    greatest(coalesce(length(regexp_replace(any_value(text), '[^\\p{{L}} ]+', '', 'g'))
      / greatest(length(any_value(text)), 1), 0), {mixing.LEAST_QUALITY}) AS quality, text
  FROM documents GROUP BY doc_id, source, text),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(':' || doc_id, '')), 1, 12)
    AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE) / quality AS key FROM found),
sizes AS (
  SELECT source, sum(size * times_found)::BIGINT AS source_size,
    ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]
      AS weight FROM found GROUP BY source),
levels AS (
  SELECT source, source_size, weight, 2.0::DOUBLE * source_size AS most,
    ({mixing.SHARE}::DOUBLE * sum(source_size) OVER ()
       - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sizes WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(most, weight * coalesce(
    (SELECT max(level) FROM levels WHERE level * weight <= most), 0)) AS target FROM levels),
placed AS (
  SELECT k.doc_id, k.size, k.times_found, t.source_size, t.target,
    coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS epochs,
    coalesce(sum(k.size * k.times_found) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND before + size * times_found / 2
    <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed, unnest(range(times_found))
"""


@query("op8_mixing", MIX_SQL)
def mix(spark, folder):
    drawn = mixing.draw(table(spark, folder, "documents"))
    return drawn.withColumn(
        "__copy", F.explode(F.array_repeat(F.lit(0), F.col("times_found").cast("int")))
    ).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("times")).cast("bigint").alias("taken"),
    )
