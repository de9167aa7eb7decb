"""Names and places as a judge returns them, senders, edit marks, texts of a web search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.functions import text as tx
from tipweave.operators import category as cat
from tipweave.operators import evidence as ev
from tipweave.operators import names as nm
from tipweave.operators.messages import MessageRules
from tipweave.operators.venues import SNIPPET, PlaceRules, VenueRules, place_near_name
from tipweave.operators.verdicts import rows_with_fallback, verified_rows
from tipweave.queries.registry import query, table
from tipweave.queries.text import SUB_RULES, SUB_SQL, _parts_as_entries
from tipweave.rules import hebrew
from tipweave.sinks import reports
from tipweave.sources.chat import stitch

WORD = "([a-z]{4,})"


@query(
    "loose_names",
    """
    WITH w AS (SELECT *, regexp_extract(text, '([a-z]{4,})', 1) AS word,
        lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM conversations),
    n AS (SELECT *, CASE turn % 5 WHEN 0 THEN ' Hall  ' || word WHEN 1 THEN 'Pizza' WHEN 2 THEN word || ' FM'
        WHEN 3 THEN 'no' || conv_id || 'no' ELSE '' END AS name FROM w)
    SELECT conv_id, turn, turn % 5 = 4 OR (turn % 5 = 0 AND (contains(body, 'hall') OR word <> ''))
        OR (turn % 5 = 1 AND contains(body, 'pizza')) OR (turn % 5 = 2 AND word <> '')
        OR (turn % 5 = 3 AND contains(body, name)) AS evident,
      role = 'user' AND (turn % 5 = 0 AND (contains(body, 'hall') OR word <> '') OR turn % 5 = 3 AND contains(body, name)) AS ok
    FROM n
    """,
)
def loose_names(spark, folder):
    """Names a judge found in messages without a pattern: evidence, cuisines, stations, requests."""
    word = F.regexp_extract("text", WORD, 1)
    kind = F.col("turn") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit(" Hall  "), word))
        .when(kind == 1, "Pizza")
        .when(kind == 2, F.concat(word, F.lit(" FM")))
        .when(kind == 3, F.concat(F.lit("no"), F.col("conv_id").cast("string"), F.lit("no")))
        .otherwise("")
    )
    rules = nm.NameRules(generic_cuisine=("PIZZA",))
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        nm.has_evidence(name, F.col("text")).alias("evident"),
        nm.loose_candidate_ok(name, F.col("text"), F.col("role") != "user", rules).alias("ok"),
    )


@query(
    "generic_labels",
    """
    SELECT p_partkey, lower(p_type) IN ('small', 'promo') OR starts_with(p_name, 'red ') OR p_size = 7 AS is_generic FROM part
    """,
)
def generic_labels(spark, folder):
    """Answers that only say what kind of place it is."""
    name = F.when(F.col("p_size") == 7, " ‏ ").when(
        F.upper("p_type").isin("SMALL", "PROMO"), F.concat(F.lit(" "), F.initcap("p_type"))
    ).otherwise(F.initcap("p_name"))
    rules = nm.NameRules(generic_labels=("small", "promo"), label_patterns=("^red\\b",))
    return table(spark, folder, "part").select(
        "p_partkey", nm.is_generic_label(name, rules).alias("is_generic")
    )


@query(
    "foreign_scripts",
    """
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'קפה' WHEN 1 THEN 'קפה' WHEN 2 THEN 'קפה בר' WHEN 3 THEN 'קפה בר'
        ELSE c_name END AS scrubbed,
      'בר-' || c_nationkey AS unified, c_nationkey % 3 = 1 AS foreign_letters
    FROM customer
    """,
)
def foreign_scripts(spark, folder):
    """Stray letters of another script in a name, spellings, letters the source does not have."""
    c, kind = table(spark, folder, "customer"), F.col("c_custkey") % 5
    stray = F.lower(F.substring("c_mktsegment", 1, 5))
    name = (
        F.when(kind == 0, F.concat(stray, F.lit("קפה")))
        .when(kind == 1, F.concat(F.lit("קפה "), stray))
        .when(kind == 2, F.concat(F.lit("קפה "), stray, F.lit("  בר")))
        .when(kind == 3, F.concat(F.lit("קפה"), stray, F.lit("בר")))
        .otherwise(F.col("c_name"))
    )
    nation = F.col("c_nationkey").cast("string")
    source = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("店 "), nation)).otherwise(nation)
    given = F.when(F.col("c_nationkey") % 3 < 2, F.lit("店 a")).otherwise(F.lit("a"))
    return c.select(
        "c_custkey",
        nm.scrub_foreign_letters(name, *hebrew.VENUES.scrub).alias("scrubbed"),
        tx.unify_spelling(F.concat(F.lit("באר־"), nation), {"באר": "בר", "־": "-"}).alias("unified"),
        nm.foreign_script_not_in_source(given, source).alias("foreign_letters"),
    )


@query(
    "near_places",
    r"""
    WITH n AS (SELECT conv_id, turn, regexp_replace(text, '[^a-z ]', ' ', 'g') AS body FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ''
      WHEN regexp_matches(body, 'tion.{0,20}the|the.{0,20}tion') THEN 'the'
      WHEN regexp_matches(body, 'ment.{0,40}que|que.{0,40}ment') THEN 'que' ELSE '' END AS place
    FROM n
    """,
)
def near_places(spark, folder):
    rules = PlaceRules(near_name=(("tion", "the", 20), ("ment", "que", 40)))
    body = F.regexp_replace("text", "[^a-z ]", " ")
    name = F.when(F.col("turn") % 2 == 0, "hall").otherwise("ment of tion")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", place_near_name(body, name, rules).alias("place")
    )


@query(
    "evidence_queries",
    """
    SELECT p_partkey, left(concat_ws(' ', p_name, nullif(CASE WHEN p_size < 20 THEN '' ELSE repeat(p_type, p_size) END, ''),
      'review'), 240) AS query FROM part
    """,
)
def evidence_queries(spark, folder):
    """The text asked of a web search: name, place and fixed words, without what is blank."""
    place = F.when(F.col("p_size") < 20, "  ").otherwise(F.expr("repeat(p_type, p_size)"))
    return table(spark, folder, "part").select(
        "p_partkey",
        ev.query_text(F.concat(F.lit(" "), "p_name"), place, ("review",)).alias("query"),
    )


@query(
    "raw_messages",
    """
    WITH w AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_seq FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS chat_id, msg_seq,
      CASE WHEN msg_seq = 0 THEN '' ELSE role || ' ' || turn END AS sender,
      CASE WHEN msg_seq > 0 THEN '3/4/2021, 9:0' || turn % 10 END AS date_str,
      CASE WHEN msg_seq = 0 THEN 'preamble ' || turn WHEN turn % 7 = 6 THEN '' WHEN turn % 3 = 1
        THEN 'said ' || turn || chr(10) || chr(10) || '  more ' || role ELSE 'said ' || turn END AS body
    FROM w
    """,
)
def raw_messages(spark, folder):
    """Lines to messages in the raw form: preamble, blank lines and empty bodies stay; senders have marks."""
    c = table(spark, folder, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).withColumn("is_first", F.lit(True))
    turn = F.col("turn").cast("string")
    head = F.concat(
        F.lit("3/4/2021, 9:0"), (F.col("turn") % 10).cast("string"), F.lit(" - ‫ ‎"),
        "role", F.lit(" "), turn, F.lit("‬: "),
    )
    said = F.concat(head, F.lit("said "), turn)
    texts = (
        F.when(F.col("is_first"), F.array(F.concat(F.lit("preamble "), turn)))
        .when(F.col("turn") % 7 == 6, F.array(head))
        .when(F.col("turn") % 3 == 1, F.array(said, F.lit(""), F.concat(F.lit("  more "), "role")))
        .otherwise(F.array(said))
    )
    lines = c.join(first, ["conv_id", "turn"], "left").select(
        F.col("conv_id").cast("string").alias("chat_id"),
        F.floor(F.col("turn") / 8).cast("long").alias("block"),
        F.col("turn").alias("line_id"),
        F.posexplode(texts).alias("part", "line"),
    )
    return stitch(lines, compact=False, keep_preamble=True).select(
        "chat_id", "msg_seq", "sender", "date_str", "body"
    )


@query(
    "edited_messages",
    """
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN word || ' ' || role WHEN 1 THEN word ELSE role END AS body
    FROM (SELECT *, 'w' || regexp_extract(text, '([a-z]{4,})', 1) AS word FROM conversations)
    """,
)
def edited_messages(spark, folder):
    word = F.concat(F.lit("w"), F.regexp_extract("text", WORD, 1))
    kind = F.col("turn") % 3
    body = (
        F.when(kind == 0, F.concat(word, F.lit(f"  {tx.EDIT_MARKERS[0].upper()} "), "role"))
        .when(kind == 1, F.concat(word, F.lit(tx.EDIT_MARKERS[1])))
        .otherwise(F.concat(F.lit(tx.EDIT_MARKERS[2] + "‏"), "role"))
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", tx.drop_edit_markers(body).alias("body")
    )


@query("sub_label_refresh", SUB_SQL.replace("AS sub_label", "AS extra_info"))
def sub_label_refresh(spark, folder):
    """Sub-labels of a stored catalogue made anew, whatever it had."""
    stored = _parts_as_entries(spark, folder).withColumn("extra_info", F.lit("old"))
    return cat.refresh_sub_labels(stored, SUB_RULES).select("p_partkey", "extra_info")


@query(
    "entry_stubs",
    """
    SELECT 'Doc ' || doc_id AS name, '' AS phone, CASE WHEN lang = 'es' THEN '' ELSE lang END AS field,
      doc_id % 2 = 0 AS from_local, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE coalesce(text, '') END AS note_preview
    FROM documents
    """,
)
def entry_stubs(spark, folder):
    rows = table(spark, folder, "documents").select(
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"),
        F.lit("").alias("phone"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("field"),
        (F.col("doc_id") % 2 == 0).alias("from_local"),
        F.col("text").alias("note"),
    )
    return reports.entry_stub(rows)


JUDGE_RULES = VenueRules(
    messages=MessageRules(
        request=("wo ",), strong=("heed",), commerce_patterns=("(?:tion|ment)",),
        tribute_pairs=(("que", "les"),),
    ),
    names=nm.NameRules(reject_phrases=("elle",), generic_labels=("dans",), generic_cuisine=("Chen",)),
    patterns=(),
    types=(("heed", "hall"), ("tion", "station")),
)
JUDGED_SQL = """
  c AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq, role AS sender, 'turn ' || turn AS date_str,
      text AS body, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS folded, turn % 2 = 1 AS is_loose,
      regexp_extract(text, '([a-z]{4,})', 1) AS word FROM conversations),
  n AS (SELECT *, 0 AS name_no, word AS name, '' AS place, 'open' AS extra, 'café' AS kind FROM c
            WHERE msg_seq % 5 <> 4 AND word <> ''
        UNION ALL SELECT *, CASE WHEN word = '' THEN 0 ELSE 1 END, 'Hall ' || chat_id, 'by ' || sender, '', '' FROM c
            WHERE msg_seq % 5 <> 4),
  v AS (SELECT chat_id, msg_seq, name_no, name, sender, date_str,
      'r-' || substr(sha256('llm2:' || name || date_str || substr(sender, 1, 20)), 1, 12) AS id,
      CASE WHEN kind <> '' THEN kind WHEN contains(body, 'heed') THEN 'hall' WHEN contains(body, 'tion') THEN 'station' ELSE '' END AS restaurant_type,
      place AS location, 'model · ' || sender || ' · ' || date_str AS note,
      CASE WHEN extra <> '' THEN extra ELSE substr(body, 1, {snippet}) END AS extra_info
    FROM n WHERE NOT contains(lower(name), 'elle') AND lower(name) <> 'dans' AND length(name) BETWEEN 2 AND 50
      AND (NOT is_loose OR (NOT contains(folded, 'wo ') AND NOT (contains(folded, 'que') AND contains(folded, 'les'))
        AND (contains(folded, 'tion') OR contains(folded, 'ment')) AND lower(name) <> 'chen'
        AND NOT (suffix(folded, '?') AND NOT contains(body, 'heed'))
        AND (name = word OR contains(lower(folded), 'hall') OR (length(chat_id) >= 3 AND contains(lower(folded), chat_id))))))
"""
JUDGED_SQL = JUDGED_SQL.replace("{snippet}", str(SNIPPET))


def judged_messages(spark, folder):
    """Messages with the venues a judge named: a word of the text, and a hall nobody mentions."""
    c = table(spark, folder, "conversations")
    word = F.regexp_extract("text", WORD, 1)
    venues = F.filter(
        F.array(
            F.struct(
                word.alias("name"), F.lit("").alias("location"), F.lit("café").alias("restaurant_type"),
                F.lit("open").alias("extra_info"),
            ),
            F.struct(
                F.concat_ws(" ", F.lit(" Hall"), F.col("conv_id").cast("string")).alias("name"),
                F.concat(F.lit("by "), "role").alias("location"),
                F.lit("").alias("restaurant_type"), F.lit("").alias("extra_info"),
            ),
        ),
        lambda v: v["name"] != "",
    )
    answer = F.when(
        F.col("turn") % 5 != 4,
        F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(venues.alias("venues"))), F.lit("\n```")),
    ).otherwise("none")
    return c.select(
        F.col("conv_id").cast("string").alias("chat_id"),
        F.col("turn").alias("msg_seq"),
        F.col("role").alias("sender"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("date_str"),
        F.col("text").alias("body"),
        (F.col("turn") % 2 == 1).alias("is_loose"),
        answer.alias("answer"),
    )


VENUE_COLUMNS = (
    "chat_id", "msg_seq", "name_no", "id", "name", "restaurant_type", "location", "note", "extra_info",
)


@query(
    "verified_venues",
    f"WITH {JUDGED_SQL} SELECT chat_id, msg_seq, name_no, id, name, restaurant_type, location, note, extra_info FROM v",
)
def verified_venues(spark, folder):
    """Names a judge returned, cleaned, checked again and filled from the message."""
    return verified_rows(judged_messages(spark, folder), JUDGE_RULES, "model").select(*VENUE_COLUMNS)


@query(
    "venues_with_fallback",
    f"""
    WITH {JUDGED_SQL}
    SELECT chat_id, msg_seq, name_no, name FROM v WHERE msg_seq % 3 <> 0
    UNION ALL SELECT chat_id, msg_seq, 0, 'rule ' || sender FROM c WHERE msg_seq % 3 = 0 AND is_loose
    """,
)
def venues_with_fallback(spark, folder):
    """Where the judge failed, the rows that the rules found take the place of its answer."""
    judged = judged_messages(spark, folder)
    strict = judged.filter("is_loose").select(
        "chat_id", "msg_seq", F.lit(0).alias("name_no"), F.concat(F.lit("rule "), "sender").alias("name")
    )
    answers = judged.select(
        "chat_id", "msg_seq", F.when(F.col("msg_seq") % 3 == 0, "no answer").alias("error")
    )
    verified = verified_rows(judged, JUDGE_RULES, "model")
    return rows_with_fallback(verified, strict, answers).select("chat_id", "msg_seq", "name_no", "name")
