"""Whole jobs on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.operators import overlay as ov
from tipweave.operators import search as se
from tipweave.operators import venues as vn
from tipweave.operators.category import fill_empty
from tipweave.operators.messages import MessageRules
from tipweave.operators.verdicts import candidates_to_judge
from tipweave.plans.contacts import ContactRules, build_contacts
from tipweave.plans.venues import build_venues
from tipweave.queries import chat, text, venues
from tipweave.queries.catalogue import CHANGE_SQL, overlay_inputs
from tipweave.queries.registry import any_contains, query, table, values
from tipweave.runtime import fresh_path
from tipweave.sources.cards import contacts
from tipweave.sources.catalogue import with_legacy_column
from tipweave.streaming.changes import current_catalogue, start_changes

KEYWORDS = [r for r in text.KEYWORDS if r.keyword not in ("tion", "er", "en", "a")]
RULE_TABLE = f"r(priority, keyword, label) AS (VALUES {values((r.priority, r.keyword, r.label) for r in KEYWORDS)})"
LOCAL = ["wh", "kei"]


def _flat(column: str) -> str:
    return f"right(trim(regexp_replace(replace({column}, chr(1), ' '), '\\s+', ' ', 'g')), 420)"


@query(
    "contacts_catalogue",
    f"""
    WITH {RULE_TABLE},
    {chat.CONTEXT_SQL},
    a AS (SELECT *, last_value(CASE WHEN {any_contains("body", chat.REQUEST)} THEN body END IGNORE NULLS) OVER (
            PARTITION BY chat_id ORDER BY msg_seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS asked FROM w),
    c AS (SELECT *, coalesce(trim(replace(substr(asked, 1, 200), chr(10), ' ')), '') AS note,
            {any_contains("body", chat.RECOMMEND)} OR {any_contains("before", chat.RECOMMEND)}
              OR {any_contains("after", chat.RECOMMEND)} OR {any_contains("before", chat.REQUEST)} AS include,
            {any_contains("body", LOCAL)} OR {any_contains("before", LOCAL)} OR {any_contains("after", LOCAL)} AS local
          FROM a WHERE role = 'assistant'),
    f AS (SELECT chat_id, min(msg_seq) AS first FROM c WHERE include GROUP BY 1),
    e AS (SELECT c.* FROM c JOIN f ON f.chat_id = c.chat_id AND f.first = c.msg_seq),
    folded AS (SELECT c.chat_id, list_reduce(list(note ORDER BY msg_seq), lambda acc, n:
                 CASE WHEN n = '' OR contains(acc, n) THEN acc ELSE acc || ' | ' || n END) AS folded
               FROM c JOIN f USING (chat_id) WHERE msg_seq >= first GROUP BY 1),
    t AS (SELECT chat_id, 'note' AS kind, lower(substr(note, 1, 420)) AS text FROM e
          UNION ALL SELECT chat_id, 'fold', lower(substr(folded, 1, 420)) FROM folded
          UNION ALL SELECT chat_id, 'before', {_flat("before")} FROM e
          UNION ALL SELECT chat_id, 'after', {_flat("after")} FROM e),
    n AS (SELECT chat_id, kind, label, sum((length(text) - length(replace(text, lower(keyword), ''))) // length(keyword)) AS n,
            min(priority) AS p FROM t, r WHERE contains(text, lower(keyword)) GROUP BY 1, 2, 3),
    vote AS (SELECT chat_id, kind, arg_max(label, (n, -p)) AS label FROM n GROUP BY 1, 2),
    exact AS (SELECT chat_id, kind, arg_min(label, priority) AS label FROM t, r WHERE contains(text, keyword) GROUP BY 1, 2),
    loose AS (SELECT chat_id, kind, arg_min(label, priority) AS label FROM t, r WHERE contains(lower(text), lower(keyword)) GROUP BY 1, 2),
    field AS (SELECT e.chat_id, coalesce(v.label, xb.label, lb.label, xa.label, la.label, '') AS first_field, vf.label AS fold_field
              FROM e LEFT JOIN vote v ON v.chat_id = e.chat_id AND v.kind = 'note'
              LEFT JOIN exact xb ON xb.chat_id = e.chat_id AND xb.kind = 'before'
              LEFT JOIN loose lb ON lb.chat_id = e.chat_id AND lb.kind = 'before'
              LEFT JOIN exact xa ON xa.chat_id = e.chat_id AND xa.kind = 'after'
              LEFT JOIN loose la ON la.chat_id = e.chat_id AND la.kind = 'after'
              LEFT JOIN vote vf ON vf.chat_id = e.chat_id AND vf.kind = 'fold')
    SELECT '05' || lpad(e.chat_id, 8, '0') AS phone, 'P' || e.chat_id AS name, folded AS note, local AS from_local,
      CASE WHEN folded <> e.note THEN coalesce(fold_field, first_field) ELSE first_field END AS field
    FROM e JOIN folded USING (chat_id) JOIN field USING (chat_id)
    """,
)
def contacts_catalogue(spark, folder):
    messages = chat.with_attachments(chat.as_messages(spark, folder))
    cards = messages.filter("sender = 'assistant'").select(
        F.concat(F.lit("cards/Contact "), "chat_id", F.lit("-"), F.col("msg_seq").cast("string"), F.lit(".vcf")).alias("file_path"),
        F.lit(0).alias("card_no"),
        F.concat(F.lit("1. P"), "chat_id").alias("fn"),
        F.concat(F.lit("05"), F.lpad("chat_id", 8, "0")).alias("phone"),
        *[F.lit("").alias(c) for c in ("n_name", "org", "note_vcf", "title_vcf")],
    )
    rules = ContactRules(chat.REQUEST, LOCAL, KEYWORDS, recommend=chat.RECOMMEND)
    entries, _ = build_contacts(messages, contacts(cards), rules)
    return entries.select("phone", "name", "note", "from_local", "field")


VENUE_RULES = vn.VenueRules(
    messages=MessageRules(exclude=("rewh",), strong=("the", "de "), anchors=("e",)),
    names=venues.NAMES,
    patterns=venues.PATTERNS,
    places=vn.PlaceRules(aliases=venues.ALIASES, prefix="in "),
    types=(("heed", "hall"), ("tion", "station")),
)


def _first_values(column: str) -> str:
    """Distinct values of a venue's rows in order of their first row, joined."""
    return f"""(SELECT key, string_agg(v, ' | ' ORDER BY s) AS {column} FROM
      (SELECT key, trim({column}) AS v, min(seq) AS s FROM k WHERE trim({column}) <> '' GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "venues_catalogue",
    f"""
    WITH {venues.ALIAS_SQL},
    m AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq, role AS sender,
            'turn ' || turn AS date_str, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM conversations
          WHERE length(text) >= 10 AND NOT contains(lower(text), 'rewh')
            AND (contains(text, 'the') OR contains(text, 'de ')) AND contains(text, 'e')),
    h AS (SELECT chat_id, msg_seq, canonical, min(place) AS place FROM m JOIN a ON contains(body, alias) GROUP BY 1, 2, 3),
    g AS (SELECT chat_id, msg_seq, arg_min(canonical, (-length(canonical), place)) AS location FROM h GROUP BY 1, 2),
    p AS (
      SELECT *, 1 AS rank, regexp_extract_all(body, 'with ([a-z]{{2,12}})', 1) AS names FROM m
      UNION ALL SELECT *, 2, list_filter(regexp_extract_all(body, 'von ([a-z]{{2,12}})', 1),
        lambda n: NOT starts_with(n, 'ein')) FROM m
      UNION ALL SELECT *, 3, regexp_extract_all(body, '([A-Z][a-z]+) de ', 1) FROM m
      UNION ALL SELECT *, 4, list_filter(regexp_extract_all(body, 'of the ([a-z]+)', 1),
        lambda n: n <> 'and' AND n <> 'of' AND (contains(n, 'e') OR contains(n, 'i'))) FROM m),
    u AS (SELECT * EXCLUDE (names), unnest(names) AS name, generate_subscripts(names, 1) AS spot FROM p),
    caught AS (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_seq, lower(name) ORDER BY rank, spot) AS nth
      FROM u WHERE name <> '' AND NOT {any_contains("lower(name)", ["rewh", "hundert"])}
      AND name NOT IN ('the', 'that') AND NOT starts_with(name, 're') AND NOT starts_with(name, 'qu')
      AND NOT contains(name, 'shth') AND NOT contains(name, 'chen')),
    o AS (SELECT *, row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY rank, spot) AS name_no FROM caught WHERE nth = 1),
    named AS (SELECT * FROM o WHERE length(name) BETWEEN 2 AND 50
      AND NOT {any_contains("lower(name)", ["license", "qué"])} AND lower(name) NOT IN ('und', 'that', 'the')),
    k AS (SELECT CAST(row_number() OVER (ORDER BY chat_id, msg_seq, name_no) - 1 AS BIGINT) AS seq, lower(name) AS key, name,
        'r-' || substr(sha256('scan:' || name || date_str || substr(sender, 1, 20)), 1, 12) AS id,
        CASE WHEN contains(body, 'heed') THEN 'hall' WHEN contains(body, 'tion') THEN 'station' ELSE '' END AS restaurant_type,
        coalesce(location, '') AS location, ' · ' || sender || ' · ' || date_str AS note,
        substr(body, 1, {vn.SNIPPET}) AS extra_info
      FROM named LEFT JOIN g USING (chat_id, msg_seq)),
    v AS (SELECT key, count(*) AS n, min(seq) AS seq, arg_min(name, (length(name), name)) AS display FROM k GROUP BY 1),
    j AS (SELECT v.*, coalesce(t.restaurant_type, '') AS kinds, coalesce(l.location, '') AS places, o.note AS notes, x.extra_info AS extras
      FROM v LEFT JOIN {_first_values("restaurant_type")} t USING (key) LEFT JOIN {_first_values("location")} l USING (key)
      LEFT JOIN {_first_values("note")} o USING (key) LEFT JOIN {_first_values("extra_info")} x USING (key)),
    r AS (SELECT CASE WHEN n = 1 THEN k.id ELSE 'r-' || substr(sha256('merged:' || j.key || display || substr(places, 1, 40)), 1, 12) END AS id,
        CASE WHEN n = 1 THEN k.name ELSE display END AS name,
        replace(CASE WHEN n = 1 THEN k.restaurant_type ELSE substr(kinds, 1, 200) END, ' | ', ' / ') AS restaurant_type,
        CASE WHEN n = 1 THEN k.location ELSE substr(places, 1, 250) END AS location,
        CASE WHEN n = 1 THEN k.note WHEN length(notes) > 400 THEN substr(notes, 1, 400) || '...' ELSE notes END AS note,
        CASE WHEN n = 1 THEN k.extra_info WHEN length(extras) > 600 THEN substr(extras, 1, 600) || '...' ELSE extras END AS extra_info,
        n AS n_merged
      FROM j JOIN k USING (seq))
    SELECT r.*, CASE WHEN r.name IN (SELECT lower(n_name) FROM nation) THEN 'https://example.org' ELSE '' END AS website FROM r
    """,
)
def venues_catalogue(spark, folder):
    """Venues out of all conversations, merged and with websites."""
    messages = chat.as_messages(spark, folder).withColumn("ts", F.lit(None).cast("timestamp"))
    sites = table(spark, folder, "nation").select(
        F.lower("n_name").alias("name"), F.lit("https://example.org").alias("website")
    )
    return build_venues(messages, VENUE_RULES, websites=sites).drop("seq")


@query(
    "judge_candidates",
    """
    WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq,
        list_filter(regexp_extract_all(text, 'with ([a-z]{2,12})', 1), lambda n: NOT starts_with(n, 're')) AS names,
        contains(text, 'heed') AS loose FROM conversations)
    SELECT chat_id, msg_seq, array_to_string(list_transform(list_filter(list_zip(names, range(len(names))),
        lambda z: list_position(names, z[1]) = z[2] + 1), lambda z: z[1]), ',') AS hints, false AS is_loose
    FROM m WHERE len(names) > 0
    UNION ALL SELECT chat_id, msg_seq, '', true FROM m WHERE len(names) = 0 AND loose
    """,
)
def judge_candidates(spark, folder):
    messages = chat.as_messages(spark, folder).select("chat_id", "msg_seq", "body")
    found = F.regexp_extract_all("body", F.lit("with ([a-z]{2,12})"), F.lit(1))
    strict = messages.select(
        "chat_id", "msg_seq", F.posexplode(found).alias("name_no", "name")
    ).filter("name NOT LIKE 're%'")
    loose = messages.filter("body LIKE '%heed%'")
    jobs = candidates_to_judge(messages, strict, loose)
    return jobs.select(
        "chat_id", "msg_seq", F.coalesce(F.array_join("hints", ","), F.lit("")).alias("hints"), "is_loose"
    )


@query(
    "change_stream",
    f"""
    WITH {CHANGE_SQL}
    SELECT name, phone, field, from_local, note FROM merged WHERE NOT is_added
      AND phone IS NOT NULL
    """,
)
def change_stream(spark, folder):
    """The change log as a stream of several batches, which split the changes of a key."""
    base, _, changes = overlay_inputs(spark, folder)
    log = fresh_path(spark, "changes")
    # The log in four files by the hash of a change: each key has changes in several of them.
    changes.repartition(4, "key", "seq").write.parquet(log)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(log)
    root = fresh_path(spark, "snapshots")
    start_changes(stream, root, fresh_path(spark, "snapshots-log")).awaitTermination()
    return current_catalogue(spark, root, base).select(
        "name", "phone", "field", "from_local", "note"
    )


@query(
    "run_statistics",
    """
    SELECT count(*) AS total, count(*) FILTER (p_size < 10) AS was_empty,
      count(*) FILTER (p_size < 10 AND (contains(p_name, 'widget') OR contains(p_name, 'bolt')
        OR contains(p_name, 'red') OR contains(p_name, 'hot'))) AS filled
    FROM part
    """,
)
def run_statistics(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_name").alias("name"),
        F.lit("").alias("note"),
        F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_type")).alias("field"),
        (F.col("p_size") < 10).alias("was_empty"),
    )
    filled = fill_empty(entries, text.NAME_RULES)
    return filled.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("was_empty").alias("was_empty"),
        F.count_if(F.col("was_empty") & (F.col("field") != "")).alias("filled"),
    )


@query(
    "legacy_column",
    "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name ELSE 'old ' || s_nationkey END AS extra_info FROM supplier",
)
def legacy_column(spark, folder):
    rows = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("extra_info"),
        F.concat(F.lit("old "), F.col("s_nationkey").cast("string")).alias("more"),
    )
    return with_legacy_column(rows, "extra_info", "more")


@query(
    "shown_venues",
    """
    SELECT page_id, CASE WHEN length(html) > 300 THEN substr(html, 1, 300) || '…' ELSE html END AS note_shown,
      CASE WHEN length(url) > 500 THEN substr(url, 1, 500) || '…' ELSE url END AS extra_shown
    FROM pages
    """,
)
def shown_venues(spark, folder):
    rows = table(spark, folder, "pages").select(
        "page_id", F.col("html").alias("note"), F.col("url").alias("extra_info")
    )
    return se.show_venues(rows).select("page_id", "note_shown", "extra_shown")


@query(
    "entry_phone_keys",
    """
    SELECT c_custkey, unnest(list_distinct(['05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'),
      right('9725' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 10), '03' || lpad(CAST(c_nationkey AS VARCHAR), 7, '0')])) AS phone_key
    FROM customer
    """,
)
def entry_phone_keys(spark, folder):
    k = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    home = F.concat(F.lit("03-"), F.lpad(F.col("c_nationkey").cast("string"), 7, "0"))
    keys = ov.phone_keys(
        F.concat(F.lit("05"), k), F.concat(F.lit("+972-5"), k), F.array(home, F.lit(""))
    )
    return table(spark, folder, "customer").select("c_custkey", F.explode(keys).alias("phone_key"))
