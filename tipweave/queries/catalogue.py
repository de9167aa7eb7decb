"""Overlay, additions, votes, search, facets, displayed columns, streams, whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.operators import overlay as ov
from tipweave.operators import search as se
from tipweave.operators import votes as vt
from tipweave.queries.registry import query, table
from tipweave.runtime import fresh_path
from tipweave.sinks.catalogue import write_json
from tipweave.sources.catalogue import ENTRY_SCHEMA, read_json
from tipweave.streaming.votes import current_counters, start_counters

# --- overlay ----------------------------------------------------------------------------------

BASE_PHONE = "'05' || lpad(CAST(c_nationkey AS {s}), 2, '0') || lpad(CAST(CAST(floor(abs(c_acctbal)) AS INT) AS {s}), 6, '0')"
CHANGE_SQL = """
  base AS (SELECT c_custkey AS seq, 0 AS src, c_name AS name, {phone} AS phone, c_mktsegment AS field,
             c_acctbal > 5000 AS from_local, 'note ' || c_nationkey AS note, '' AS extra_info FROM customer),
  added AS (SELECT s_suppkey AS seq, 1 AS src, s_name AS name, '05' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
              || lpad(CAST(CAST(floor(abs(s_acctbal)) AS INT) AS VARCHAR), 6, '0') AS phone, 'SUPPLY' AS field,
              false AS from_local, '' AS note, 'new' AS extra_info FROM supplier),
  ch AS (SELECT b.phone AS key, o_orderkey AS seq, o_orderstatus AS status, o_orderpriority AS prio
         FROM orders JOIN base b ON b.seq = o_custkey),
  del AS (SELECT DISTINCT key FROM ch WHERE status = 'P' AND prio = '1-URGENT'),
  field_edit AS (SELECT key, arg_max(CASE WHEN prio = '2-HIGH' THEN '' ELSE prio END, seq) AS v FROM ch
                 WHERE status = 'F' AND prio <> '5-LOW' GROUP BY 1),
  note_edit AS (SELECT key, arg_max('edited ' || seq, seq) AS v FROM ch WHERE status = 'F' AND prio = '5-LOW' GROUP BY 1),
  phone_edit AS (SELECT key, arg_max('059' || lpad(CAST(seq AS VARCHAR), 7, '0'), seq) AS v FROM ch
                 WHERE status = 'O' AND prio = '1-URGENT' GROUP BY 1),
  note AS (SELECT key, arg_max(CASE WHEN prio = '2-HIGH' THEN '' ELSE 'said ' || seq END, seq) AS v FROM ch
           WHERE status = 'O' AND prio IN ('2-HIGH', '3-MEDIUM') GROUP BY 1),
  flag AS (SELECT key, arg_max(prio = '5-LOW', seq) AS v FROM ch WHERE status = 'O' AND prio IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY 1),
  alive AS (SELECT * FROM (SELECT * FROM base UNION ALL SELECT * FROM added) WHERE phone NOT IN (SELECT key FROM del)),
  uniq AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY src, seq) AS rn FROM alive),
  merged AS (
    SELECT u.src, u.seq, coalesce(p.v, u.phone) AS item_key, u.name, coalesce(p.v, u.phone) AS phone,
      CASE WHEN f.key IS NOT NULL THEN f.v ELSE u.field END AS field,
      coalesce(g.v, u.from_local) AS from_local,
      CASE WHEN n.v <> '' THEN n.v WHEN ne.v <> '' THEN ne.v ELSE u.note END AS note, u.extra_info, u.src = 1 AS is_added
    FROM uniq u LEFT JOIN field_edit f ON f.key = u.phone LEFT JOIN note_edit ne ON ne.key = u.phone
    LEFT JOIN phone_edit p ON p.key = u.phone LEFT JOIN note n ON n.key = u.phone LEFT JOIN flag g ON g.key = u.phone
    WHERE rn = 1)
""".replace("{phone}", BASE_PHONE.replace("{s}", "VARCHAR"))


def _change(op: str, column: str = "", value=None):
    return F.struct(
        F.lit(op).alias("op"),
        F.lit(column).alias("column"),
        (F.lit("") if value is None else value).alias("value"),
    )


def overlay_inputs(spark, folder):
    """Customers as the base, suppliers as added rows, orders as the change log."""
    base = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("seq"),
        F.col("c_name").alias("name"),
        F.expr(BASE_PHONE.replace("{s}", "STRING")).alias("phone"),
        F.lit(None).cast("array<string>").alias("phones"),
        F.col("c_mktsegment").alias("field"),
        (F.col("c_acctbal") > 5000).alias("from_local"),
        F.concat(F.lit("note "), F.col("c_nationkey").cast("string")).alias("note"),
        F.lit("").alias("extra_info"),
    )
    added = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.col("s_name").alias("name"),
        F.expr(BASE_PHONE.replace("{s}", "STRING").replace("c_", "s_")).alias("phone"),
        F.lit("SUPPLY").alias("field"),
        F.lit(False).alias("from_local"),
        F.lit("").alias("note"),
        F.lit("new").alias("extra_info"),
    )
    o = table(spark, folder, "orders").join(
        base.select(F.col("seq").alias("o_custkey"), F.col("phone").alias("key")), "o_custkey"
    )
    status, prio, n = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    low = prio == "5-LOW"
    kind = (
        F.when((status == "P") & (prio == "1-URGENT"), _change("delete"))
        .when((status == "F") & low, _change("edit", "note", F.concat(F.lit("edited "), n)))
        .when(status == "F", _change("edit", "field", F.when(prio == "2-HIGH", "").otherwise(prio)))
        .when((status == "O") & (prio == "1-URGENT"), _change("edit", "phone", F.concat(F.lit("059"), F.lpad(n.cast("string"), 7, "0"))))
        .when((status == "O") & (prio == "2-HIGH"), _change("note", "", F.lit("")))
        .when((status == "O") & (prio == "3-MEDIUM"), _change("note", "", F.concat(F.lit("said "), n)))
        .when(status == "O", _change("flag", "", low.cast("string")))
    )
    changes = (
        o.select("key", n.alias("seq"), kind.alias("c"))
        .filter("c IS NOT NULL")
        .select("key", "seq", "c.*", F.lit(None).cast("array<string>").alias("phones"))
    )
    return base, added, changes


@query(
    "overlay_merge",
    f"""
    WITH {CHANGE_SQL}
    SELECT item_key, name, phone, field, from_local, note, extra_info, is_added FROM merged
    """,
)
def overlay_merge(spark, folder):
    return ov.merge_overlay(*overlay_inputs(spark, folder)).select(
        "item_key", "name", "phone", "field", "from_local", "note", "extra_info", "is_added"
    )


@query(
    "stored_entries",
    f"""
    WITH {CHANGE_SQL},
    shown AS (SELECT m.*, CASE WHEN p.v IS NOT NULL THEN p.v WHEN m.is_added THEN m.phone END AS shown
              FROM merged m LEFT JOIN uniq u ON u.src = m.src AND u.seq = m.seq LEFT JOIN phone_edit p ON p.key = u.phone)
    SELECT name, coalesce(shown, phone) AS phone, field, from_local, note, extra_info FROM shown
    """,
)
def stored_entries(spark, folder):
    base, added, changes = overlay_inputs(spark, folder)
    merged = ov.merge_overlay(base, added, ov.with_display_phone(changes))
    return ov.stored_rows(merged).select("name", "phone", "field", "from_local", "note", "extra_info")


@query(
    "changelog_latest",
    """
    WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, event_type,
                 trim(CASE WHEN value < 3 THEN ' ' ELSE props END) AS v FROM events)
    SELECT key, count(*) FILTER (event_type = 'view') > 0 AS has_name,
      arg_max(v, seq) FILTER (event_type = 'view') AS new_name,
      count(*) FILTER (event_type = 'click') > 0 AS has_field,
      arg_max(v, seq) FILTER (event_type = 'click') AS new_field,
      count(*) FILTER (event_type = 'error') > 0 AS has_extra_info,
      arg_max(v, seq) FILTER (event_type = 'error') AS new_extra_info
    FROM c GROUP BY 1
    HAVING count(*) > 0
    """,
)
def changelog_latest(spark, folder):
    e = table(spark, folder, "events")
    column = (
        F.when(F.col("event_type") == "view", "name")
        .when(F.col("event_type") == "click", "field")
        .when(F.col("event_type") == "error", "extra_info")
        .otherwise("unknown")
    )
    changes = e.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("seq"),
        F.lit("edit").alias("op"),
        column.alias("column"),
        F.when(F.col("value") < 3, " ").otherwise(F.col("props")).alias("value"),
        F.lit(None).cast("array<string>").alias("phones"),
    )
    kept = ["name", "field", "extra_info"]
    return ov.latest_edits(changes).select(
        "key", *[f"{p}_{c}" for c in kept for p in ("has", "new")]
    )


@query(
    "add_conflicts",
    """
    WITH cat AS (SELECT DISTINCT unnest(['05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'),
        '05' || lpad(CAST(10 * c_nationkey + 7000 AS VARCHAR), 8, '0')]) AS key FROM customer WHERE c_acctbal > 1000),
    req AS (SELECT o_orderkey AS seq, right('05' || lpad(CAST(7000 + CAST(floor(o_totalprice / 1000) AS INT) AS VARCHAR), 8, '0'), 10) AS k1,
              right('06' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 10) AS k2 FROM orders WHERE o_orderstatus <> 'P'),
    free AS (SELECT * FROM req WHERE k1 NOT IN (SELECT key FROM cat) AND k2 NOT IN (SELECT key FROM cat)),
    firsts AS (SELECT min(seq) AS seq FROM free GROUP BY k1)
    SELECT seq, seq IN (SELECT seq FROM firsts) AS accepted FROM req
    """,
)
def add_conflicts(spark, folder):
    key = lambda n: F.concat(F.lit("05"), F.lpad(n.cast("string"), 8, "0"))
    # Customers with little money have phones that no request has.
    rich = F.col("c_acctbal") > 1000
    far = lambda k: F.when(rich, k).otherwise(F.concat(F.lit("07"), F.substring(k, 3, 8)))
    cat = table(spark, folder, "customer").select(
        far(key(F.col("c_custkey"))).alias("phone"),
        F.lit(None).cast("string").alias("phone_display"),
        F.array(far(key(10 * F.col("c_nationkey") + 7000))).alias("phones"),
    )
    o = table(spark, folder, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") != "P", F.lit("someone")).otherwise("  ").alias("name"),
        key(7000 + F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("phone"),
        F.lit("").alias("phone_display"),
        F.array(
            key(7000 + F.floor(F.col("o_totalprice") / 1000).cast("int")),
            F.concat(F.lit("06"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")),
        ).alias("phones"),
    )
    accepted, refused = ov.accept_additions(ov.prepare_additions(requests), cat)
    return accepted.select("seq", F.lit(True).alias("accepted")).union(
        refused.select("seq", F.lit(False))
    )


@query(
    "venue_changes",
    """
    WITH e AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS seq, l_returnflag, l_linestatus, l_quantity FROM lineitem),
    del AS (SELECT DISTINCT l_suppkey FROM e WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_linestatus = 'F'),
    nm AS (SELECT l_suppkey, arg_max('renamed ' || seq, seq) AS v FROM e WHERE l_returnflag = 'A' AND l_quantity > 40 GROUP BY 1),
    loc AS (SELECT l_suppkey, arg_max(CASE WHEN l_linestatus = 'F' THEN '' ELSE 'street ' || seq END, seq) AS v FROM e
            WHERE l_returnflag = 'N' AND l_quantity > 45 GROUP BY 1)
    SELECT CAST(s_suppkey AS VARCHAR) AS id, coalesce(nm.v, s_name) AS name,
      CASE WHEN loc.l_suppkey IS NOT NULL THEN loc.v ELSE CAST(s_nationkey AS VARCHAR) END AS location
    FROM supplier LEFT JOIN nm ON nm.l_suppkey = s_suppkey LEFT JOIN loc ON loc.l_suppkey = s_suppkey
    WHERE s_suppkey NOT IN (SELECT l_suppkey FROM del)
    UNION ALL SELECT 'n' || n_nationkey, n_name, '' FROM nation
    """,
)
def venue_changes(spark, folder):
    venues = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("location"),
    )
    n = table(spark, folder, "nation")
    added = n.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("location")
    ).unionByName(n.select(F.concat(F.lit("m"), "n_nationkey").alias("id"), F.lit("  ").alias("name"), F.lit("").alias("location")))
    e = table(spark, folder, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    flag, status, q = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    change = (
        F.when((flag == "R") & (q == 50) & (status == "F"), _change("delete"))
        .when((flag == "A") & (q > 40), _change("edit", "name", F.concat(F.lit("renamed "), "seq")))
        .when((flag == "A") & (q > 35), _change("edit", "name", F.lit(" ")))
        .when((flag == "N") & (q > 45), _change("edit", "location", F.when(status == "F", "").otherwise(F.concat(F.lit("street "), "seq"))))
    )
    changes = e.select(
        F.col("l_suppkey").cast("string").alias("key"), "seq", change.alias("c"),
        F.lit(None).cast("array<string>").alias("phones"),
    ).filter("c IS NOT NULL").select("key", "seq", "c.*", "phones")
    return ov.merge_venue_changes(venues, added, changes).select("id", "name", "location")


# --- votes ------------------------------------------------------------------------------------

STATE = "CASE WHEN {v} < 4 THEN 'none' WHEN {v} < 8 THEN 'like' WHEN {v} < 14 THEN 'dislike' WHEN {v} < 20 THEN '' ELSE 'odd' END"
PREV = STATE.replace("{v}", "value")
NEXT = STATE.replace("{v}", "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 5")
VOTE_EVENTS_SQL = f"""
  ev AS (SELECT CAST(user_id AS VARCHAR) AS item_key, event_id AS seq,
           CASE WHEN {PREV} = '' THEN 'none' ELSE {PREV} END AS prev,
           CASE WHEN {NEXT} = '' THEN 'none' ELSE {NEXT} END AS next FROM events),
  ok AS (SELECT * FROM ev WHERE prev <> 'odd' AND next <> 'odd'
         AND item_key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal >= 0)),
  d AS (SELECT item_key, seq, row_number() OVER (PARTITION BY item_key ORDER BY seq) AS rn,
          CAST(next = 'like' AS INT) - CAST(prev = 'like' AS INT) AS dl,
          CAST(next = 'dislike' AS INT) - CAST(prev = 'dislike' AS INT) AS dd FROM ok),
  st AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'old ' ELSE '' END || c_custkey AS item_key, greatest(c_nationkey - 10, 0) AS likes,
           coalesce(CASE WHEN c_acctbal > 2000 THEN CAST(floor(c_acctbal / 1000) AS INT) END, 0) AS dislikes
         FROM customer),
  run(item_key, rn, seq, likes, dislikes) AS (
    SELECT k.item_key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), coalesce(st.likes, 0), coalesce(st.dislikes, 0)
    FROM (SELECT DISTINCT item_key FROM d) k LEFT JOIN st USING (item_key)
    UNION ALL
    SELECT d.item_key, d.rn, d.seq, greatest(0, run.likes + dl), greatest(0, run.dislikes + dd)
    FROM run JOIN d ON d.item_key = run.item_key AND d.rn = run.rn + 1)
"""
FINAL_SQL = f"""
    WITH RECURSIVE {VOTE_EVENTS_SQL},
    last AS (SELECT item_key, arg_max(likes, rn) AS likes, arg_max(dislikes, rn) AS dislikes FROM run
             WHERE item_key IN (SELECT item_key FROM d WHERE dl <> 0 OR dd <> 0) GROUP BY 1)
    SELECT coalesce(st.item_key, last.item_key) AS item_key,
      CAST(coalesce(last.likes, st.likes) AS BIGINT) AS likes, CAST(coalesce(last.dislikes, st.dislikes) AS BIGINT) AS dislikes
    FROM st FULL JOIN last USING (item_key)
"""


def vote_events(events):
    return events.select(
        "event_id",
        "ts",
        F.lit("entry").alias("item_type"),
        F.col("user_id").cast("string").alias("item_key"),
        F.col("event_id").alias("seq"),
        F.expr(PREV).alias("prev"),
        F.expr(NEXT).alias("next"),
    )


def vote_targets(spark, folder):
    # Customers in debt are listed under keys that no event has.
    lead = F.when(F.col("c_acctbal") < 0, "old ").otherwise("")
    return table(spark, folder, "customer").select(
        F.lit("entry").alias("item_type"),
        F.concat(lead, F.col("c_custkey").cast("string")).alias("item_key"),
    )


def stored_votes(spark, folder):
    lead = F.when(F.col("c_mktsegment") == "MACHINERY", "old ").otherwise("")
    return table(spark, folder, "customer").select(
        F.lit("entry").alias("item_type"),
        F.concat(lead, F.col("c_custkey").cast("string")).alias("item_key"),
        (F.col("c_nationkey") - 10).cast("long").alias("likes"),
        F.when(F.col("c_acctbal") > 2000, F.floor(F.col("c_acctbal") / 1000)).alias("dislikes"),
    )


@query("votes_final", FINAL_SQL)
def votes_final(spark, folder):
    events = vt.known_targets(
        vote_events(table(spark, folder, "events")), vote_targets(spark, folder)
    )
    return vt.apply_votes(events, stored_votes(spark, folder)).select("item_key", "likes", "dislikes")


@query(
    "votes_history",
    f"""
    WITH RECURSIVE {VOTE_EVENTS_SQL}
    SELECT item_key, seq, CAST(likes AS BIGINT) AS likes, CAST(dislikes AS BIGINT) AS dislikes FROM run WHERE rn > 0
    """,
)
def votes_history(spark, folder):
    events = vt.known_targets(
        vote_events(table(spark, folder, "events")), vote_targets(spark, folder)
    )
    history = vt.vote_history(events, stored_votes(spark, folder))
    return history.select("item_key", "seq", "likes", "dislikes")


@query("vote_stream", FINAL_SQL)
def vote_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = vt.known_targets(vote_events(stream), vote_targets(spark, folder))
    root = fresh_path(spark, "votes")
    running = start_counters(
        events, root, fresh_path(spark, "votes-log"), initial=stored_votes(spark, folder)
    )
    running.awaitTermination()
    return current_counters(spark, root).select("item_key", "likes", "dislikes")


@query(
    "catalog_with_votes",
    """
    SELECT c_custkey, c_name AS name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN greatest(c_nationkey - 10, 0) ELSE 0 END AS likes,
      CASE WHEN c_mktsegment <> 'MACHINERY' AND c_acctbal > 2000 THEN CAST(floor(c_acctbal / 1000) AS BIGINT) ELSE 0 END AS dislikes
    FROM customer
    """,
)
def catalog_with_votes(spark, folder):
    items = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("item_key"),
        F.col("c_mktsegment").alias("note"),
    )
    served = ov.public_entries(vt.with_votes(items, stored_votes(spark, folder), "entry", "item_key"))
    return served.drop("item_key")


@query(
    "orphan_votes",
    """
    SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'old ' ELSE '' END || c_custkey AS item_key FROM customer
    WHERE c_mktsegment = 'MACHINERY' OR c_custkey NOT IN (SELECT s_suppkey FROM supplier)
    """,
)
def orphan_votes(spark, folder):
    items = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("item_key"))
    return vt.orphan_votes(stored_votes(spark, folder), items, "entry", "item_key").select("item_key")


# --- reading ----------------------------------------------------------------------------------


def document_entries(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat_ws(" ", F.lit("Doc"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("").alias("phone"),
        F.when(F.col("lang") == "es", " ").otherwise(F.col("lang")).alias("field"),
        F.col("source").alias("extra_info"),
        F.col("text").alias("note"),
    )


@query(
    "catalog_search",
    """
    SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower('Doc ' || doc_id || ' ' || ' ' || lang || ' ' || source || ' ' || text), 'src1 the')
      OR (lang = 'es' AND contains(lower('Doc ' || doc_id || '    ' || source || ' ' || text), 'mente'))
    """,
)
def catalog_search(spark, folder):
    entries = document_entries(spark, folder)
    english = se.search(entries, " SRC1 The", "en")
    none = se.search(entries, "Mente", "__no_field__")
    return english.select("doc_id").union(none.select("doc_id"))


@query(
    "card_search",
    """
    WITH h AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || url || ' ' || html, '\\s+', ' ', 'g'))) AS hay FROM pages)
    SELECT page_id FROM h WHERE contains(hay, 'the and') OR contains(hay, 'ing of the')
    """,
)
def card_search(spark, folder):
    cards = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"),
        F.col("url").alias("location"),
        F.col("html").alias("note"),
    )
    found = [
        se.search(cards, q, columns=se.CARD_COLUMNS, category_column="restaurant_type", fold=True)
        for q in ("The   and", "ing of\nthe")
    ]
    return found[0].select("page_id").union(found[1].select("page_id")).distinct()


@query(
    "search_counts",
    "SELECT count(*) FILTER (contains(lower(text), 'heed')) AS shown, count(*) AS total FROM documents",
)
def search_counts(spark, folder):
    entries = table(spark, folder, "documents")
    return se.shown_of_total(entries, F.contains(F.lower("text"), F.lit("heed")))


@query(
    "catalog_facets",
    """
    SELECT 'type' AS facet, p_type AS value, count(*) AS n FROM part GROUP BY 2
    UNION ALL SELECT 'segment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 2
    """,
)
def catalog_facets(spark, folder):
    types = se.facets(table(spark, folder, "part").withColumn("p_type", F.concat(F.lit(" "), "p_type")), "p_type")
    segments = se.facets(
        table(spark, folder, "customer").withColumn(
            "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment"))
        ),
        "c_mktsegment",
    )
    return types.withColumn("facet", F.lit("type")).unionByName(segments.withColumn("facet", F.lit("segment")))


@query(
    "category_list",
    """
    SELECT DISTINCT p_brand AS value, 0 AS place FROM part UNION ALL SELECT 'other', 1
    """,
)
def category_list(spark, folder):
    return se.category_list(table(spark, folder, "part"), "other", "p_brand")


@query(
    "shown_contacts",
    """
    SELECT c_custkey, CASE WHEN c_acctbal > 1000 THEN '050-' || c_custkey || ' · ' || '03-' || c_custkey ELSE '050-' || c_custkey END AS phones_shown,
      CASE WHEN c_acctbal > 1000 THEN '+97250' || c_custkey || ' +9723' || c_custkey ELSE '+97250' || c_custkey END AS phone_links,
      CASE WHEN length(note) > 400 THEN substr(note, 1, 400) || '…' ELSE note END AS note_shown
    FROM (SELECT *, repeat(c_name || ' ', c_nationkey) AS note FROM customer)
    """,
)
def shown_contacts(spark, folder):
    c = table(spark, folder, "customer")
    mobile = F.concat(F.lit("050-"), F.col("c_custkey").cast("string"))
    home = F.concat(F.lit("03-"), F.col("c_custkey").cast("string"))
    entries = c.select(
        "c_custkey",
        mobile.alias("phone"),
        F.when(F.col("c_acctbal") > 1000, F.array(mobile, home)).alias("phones"),
        F.expr("repeat(concat(c_name, ' '), c_nationkey)").alias("note"),
    )
    return se.show_contacts(entries).select("c_custkey", "phones_shown", "phone_links", "note_shown")


@query(
    "json_roundtrip",
    """
    SELECT c_name AS name, '050' || c_custkey AS phone, c_mktsegment AS field, c_acctbal > 0 AS from_local FROM customer
    """,
)
def json_roundtrip(spark, folder):
    entries = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"),
        F.concat(F.lit("050"), F.col("c_custkey").cast("string")).alias("phone"),
        F.col("c_mktsegment").alias("field"),
        (F.col("c_acctbal") > 0).alias("local_flag"),
    )
    path = fresh_path(spark, "json")
    write_json(entries, path)
    read = read_json(
        spark, path, ENTRY_SCHEMA, {"local_flag": "from_local"}, one_per_line=True
    )
    return read.select("name", "phone", "field", "from_local")
