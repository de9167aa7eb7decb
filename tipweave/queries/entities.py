"""Duplicate contacts: exact groups, related names, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.operators import duplicates as dup
from tipweave.queries.registry import query, table
from tipweave.sinks.reports import duplicate_groups, duplicate_lines

ENTRY_NAME = """
  CASE WHEN p_size <= 12 THEN p_name
       WHEN p_size <= 24 THEN p_name || ', ' || lower(p_type)
       WHEN p_size <= 36 THEN p_name || ' (new) ' || p_type
       WHEN p_size <= 44 THEN p_name || ' of ' || lower(p_type) || ' new make'
       ELSE p_name || ' new of ' || p_type || ' make' END
"""
ENTRY_PHONE = """
  CASE WHEN p_type = 'PROMO' AND p_size < 20 THEN '' WHEN p_size < 30 THEN '050' || lpad(CAST(p_partkey AS VARCHAR), 7, '0')
       ELSE '03' || lpad(CAST(p_size AS VARCHAR), 7, '0') END
"""
ENTRY_NOTE = "CASE WHEN p_size < 25 THEN p_type ELSE p_brand || ' ' || p_type END"
ENTRY_EXTRA = "CASE WHEN p_size > 20 THEN lower(p_type) ELSE '' END"


def entries(spark, folder):
    """Parts as contact entries: some share phones, names extend one another."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("seq"),
        F.expr(ENTRY_NAME).alias("name"),
        F.expr(ENTRY_PHONE.replace("AS VARCHAR", "AS STRING")).alias("phone"),
        F.col("p_brand").alias("field"),
        (F.col("p_size") > 40).alias("from_local"),
        F.expr(ENTRY_NOTE).alias("note"),
        F.expr(ENTRY_EXTRA).alias("extra_info"),
    )


KEYED_SQL = f"""
  k AS (SELECT p_partkey AS seq, {ENTRY_NAME} AS name, {ENTRY_PHONE} AS phone, p_brand AS field,
          p_size > 40 AS from_local, {ENTRY_NOTE} AS note, {ENTRY_EXTRA} AS extra_info FROM part),
  e AS (SELECT *, lower(trim(regexp_replace(regexp_replace(name, '[,()]', ' ', 'g'), '\\s+', ' ', 'g'))) AS nm FROM k)
"""

EXTENDED_SQL = f"""
  {KEYED_SQL},
  t AS (SELECT DISTINCT field, nm, phone FROM e WHERE phone <> ''),
  ids AS (SELECT row_number() OVER () AS id, * FROM t),
  nn AS (SELECT DISTINCT field, nm FROM t),
  rel AS (SELECT a.field, a.nm AS s, b.nm AS l FROM nn a JOIN nn b ON a.field = b.field
          WHERE length(a.nm) < length(b.nm) AND contains(a.nm, ' ') AND (starts_with(b.nm, a.nm || ' ')
            OR (length(a.nm) - length(replace(a.nm, ' ', '')) >= 2
                AND regexp_matches(' ' || b.nm || ' ', ' ' || replace(a.nm, ' ', ' (.* )?') || ' ')))),
  edge AS (SELECT x.id AS u, y.id AS v FROM rel JOIN ids x ON x.field = rel.field AND x.nm = s
           JOIN ids y ON y.field = rel.field AND y.nm = l WHERE x.phone <> y.phone),
  both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
  reach AS (SELECT u AS id, least(u, v) AS root FROM both_ways
            UNION SELECT b.v, r.root FROM reach r JOIN both_ways b ON b.u = r.id),
  comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY id),
  member AS (SELECT comp.comp, ids.field, ids.nm, ids.phone FROM comp JOIN ids USING (id)),
  rows_in AS (SELECT m.comp, e.* FROM member m JOIN e ON e.field = m.field AND e.nm = m.nm AND e.phone = m.phone),
  fseq AS (SELECT field, min(seq) AS field_seq FROM e WHERE nm <> '' GROUP BY 1),
  grp AS (SELECT comp, r.field, field_seq, count(DISTINCT phone) AS n_phones, count(DISTINCT nm) AS n_names,
            count(*) AS n_entries, min(seq) AS first_seq,
            string_agg(DISTINCT phone || '~' || nm, '^' ORDER BY phone || '~' || nm) AS fp
          FROM rows_in r JOIN fseq ON fseq.field = r.field GROUP BY ALL),
  uniq AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY field_seq, first_seq) AS rn FROM grp
           WHERE n_phones >= 2 AND n_names >= 2),
  ext AS (SELECT * FROM uniq WHERE rn = 1)
"""


@query(
    "dup_exact",
    f"""
    WITH {KEYED_SQL}
    SELECT field AS norm_field, nm AS norm_name,
      count(DISTINCT CASE WHEN phone <> '' THEN phone END) AS n_phones,
      count(*) AS n_entries, min(seq) AS first_seq
    FROM e WHERE nm <> '' GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN phone <> '' THEN phone END) >= 2
    """,
)
def dup_exact(spark, folder):
    return dup.exact_groups(dup.triples(dup.keyed(entries(spark, folder))))


@query(
    "related_names",
    f"""
    WITH {KEYED_SQL},
    every AS (SELECT DISTINCT field, nm FROM e)
    SELECT a.field AS norm_field, a.nm AS short_name, b.nm AS long_name
    FROM every a JOIN every b ON a.field = b.field
    WHERE length(a.nm) < length(b.nm) AND contains(a.nm, ' ') AND (starts_with(b.nm, a.nm || ' ')
      OR (length(a.nm) - length(replace(a.nm, ' ', '')) >= 2
          AND regexp_matches(' ' || b.nm || ' ', ' ' || replace(a.nm, ' ', ' (.* )?') || ' ')))
    """,
)
def related_names(spark, folder):
    return dup.related_names(dup.triples(dup.keyed(entries(spark, folder))))


@query(
    "dup_extended",
    f"""
    WITH RECURSIVE {EXTENDED_SQL},
    names AS (SELECT DISTINCT comp, nm FROM rows_in),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY nm) AS rn FROM names),
    label AS (SELECT comp, string_agg(nm, ' | ' ORDER BY nm) AS label FROM ranked WHERE rn <= 4 GROUP BY 1)
    SELECT field AS norm_field, n_phones, n_names, CAST(n_entries AS BIGINT) AS n_entries, first_seq,
      label || CASE WHEN n_names > 4 THEN ' | …' ELSE '' END AS label
    FROM ext JOIN label USING (comp)
    """,
)
def dup_extended(spark, folder):
    t = dup.triples(dup.keyed(entries(spark, folder)))
    groups = dup.extended_groups(t, dup.extended_members(t))
    return groups.select("norm_field", "n_phones", "n_names", "n_entries", "first_seq", "label")


MERGE_SQL = f"""
  {EXTENDED_SQL},
  exact AS (SELECT field, nm, min(seq) AS first_seq FROM e WHERE nm <> '' GROUP BY 1, 2
            HAVING count(DISTINCT CASE WHEN phone <> '' THEN phone END) >= 2),
  g AS (SELECT 'x' || field || nm AS gid, 0 AS kind, first_seq AS a, 0 AS b FROM exact
        UNION ALL SELECT 'y' || comp, 1, field_seq, first_seq FROM ext),
  gm AS (SELECT 'x' || e.field || e.nm AS gid, e.* FROM e JOIN exact x ON x.field = e.field AND x.nm = e.nm
         UNION ALL SELECT 'y' || r.comp, r.* EXCLUDE (comp) FROM rows_in r JOIN ext USING (comp)),
  owner AS (SELECT phone, arg_max(gid, (kind, a, b)) AS gid FROM gm JOIN g USING (gid)
            WHERE phone <> '' GROUP BY 1),
  pos AS (SELECT o.gid, min(e.seq) AS seq FROM e JOIN owner o USING (phone) GROUP BY 1),
  ph AS (SELECT DISTINCT gid, phone FROM gm WHERE phone <> ''),
  ph_first AS (SELECT gid, arg_min(phone, (CASE WHEN starts_with(phone, '05') THEN 0 ELSE 1 END, phone)) AS phone
               FROM ph GROUP BY 1),
  note1 AS (SELECT gid, note, min(seq) AS s FROM gm WHERE trim(note) <> '' GROUP BY 1, 2),
  notes AS (SELECT gid, string_agg(note, ' | ' ORDER BY s) AS note FROM note1 GROUP BY 1),
  merged AS (SELECT gid, arg_max(name, (length(name), -seq)) AS name, arg_min(field, seq) AS field,
               bool_or(from_local) AS from_local,
               coalesce(arg_max(extra_info, (length(extra_info), -seq)) FILTER (extra_info <> ''), '') AS extra_info
             FROM gm GROUP BY 1)
"""


@query(
    "dup_merge",
    f"""
    WITH RECURSIVE {MERGE_SQL}
    SELECT seq, name, phone, field, from_local, note, extra_info FROM e
    WHERE phone NOT IN (SELECT phone FROM owner)
    UNION ALL
    SELECT pos.seq, m.name, p.phone, m.field, m.from_local, coalesce(n.note, ''), m.extra_info
    FROM pos JOIN merged m USING (gid) JOIN ph_first p USING (gid) LEFT JOIN notes n USING (gid)
    """,
)
def dup_merge(spark, folder):
    catalogue, _, _ = dup.apply_merge(entries(spark, folder))
    return catalogue.select("seq", "name", "phone", "field", "from_local", "note", "extra_info")


@query(
    "dup_merge_phones",
    f"""
    WITH RECURSIVE {MERGE_SQL}
    SELECT m.name, pos.seq, ph.phone FROM pos JOIN merged m USING (gid) JOIN ph USING (gid)
    """,
)
def dup_merge_phones(spark, folder):
    catalogue, phones, _ = dup.apply_merge(entries(spark, folder))
    merged = catalogue.filter("group_id IS NOT NULL").select("group_id", "name", "seq")
    return merged.join(phones, "group_id").select(
        "name", "seq", F.col("norm_phone").alias("phone")
    )


@query(
    "dup_report_lines",
    f"""
    WITH {KEYED_SQL},
    x AS (SELECT field, nm, count(DISTINCT phone) FILTER (phone <> '') AS n FROM e WHERE nm <> '' GROUP BY 1, 2
          HAVING count(DISTINCT phone) FILTER (phone <> '') >= 2)
    SELECT 'exact' || chr(9) || nm || chr(9) || field || chr(9) || CAST(n AS VARCHAR) AS line FROM x
    UNION ALL
    SELECT DISTINCT_LINE FROM (SELECT '    ' || phone AS DISTINCT_LINE FROM
      (SELECT DISTINCT e.field, e.nm, e.phone FROM e JOIN x ON x.field = e.field AND x.nm = e.nm WHERE phone <> ''))
    """,
)
def dup_report_lines(spark, folder):
    k = dup.triples(dup.keyed(entries(spark, folder)))
    groups = dup.exact_groups(k).withColumn("group_id", F.concat_ws("|", "norm_field", "norm_name"))
    phones = (
        k.filter("norm_phone <> ''")
        .select(F.concat_ws("|", "norm_field", "norm_name").alias("group_id"), "norm_phone")
        .distinct()
    )
    return duplicate_lines(groups, phones, "exact", "norm_name").select("line")


@query(
    "dup_report_groups",
    f"""
    WITH RECURSIVE {EXTENDED_SQL},
    names AS (SELECT DISTINCT comp, nm FROM rows_in),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY nm) AS rn FROM names),
    label AS (SELECT comp, string_agg(nm, ' | ' ORDER BY nm) AS label FROM ranked WHERE rn <= 4 GROUP BY 1)
    SELECT 'exact_name' AS match_kind, nm AS label, field AS norm_field,
      count(DISTINCT CASE WHEN phone <> '' THEN phone END) AS n_phones, count(*) AS n_entries
    FROM e WHERE nm <> '' GROUP BY 2, 3 HAVING count(DISTINCT CASE WHEN phone <> '' THEN phone END) >= 2
    UNION ALL
    SELECT 'extended_prefix_or_subsequence', label || CASE WHEN n_names > 4 THEN ' | …' ELSE '' END, field, n_phones,
      CAST(n_entries AS BIGINT) FROM ext JOIN label USING (comp)
    """,
)
def dup_report_groups(spark, folder):
    t = dup.triples(dup.keyed(entries(spark, folder)))
    extended = dup.extended_groups(t, dup.extended_members(t))
    return duplicate_groups(dup.exact_groups(t), extended)
