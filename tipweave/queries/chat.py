"""Message structuring, mentions and their context, gate, note fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipweave.functions.phrases import contains_any
from tipweave.functions.text import cap, strip
from tipweave.operators import mentions as m
from tipweave.operators import messages as msg
from tipweave.operators.dictionary import first_label
from tipweave.operators.notes import fold_notes, note_texts
from tipweave.operators.sequence import with_frames
from tipweave.queries.registry import any_contains, query, table
from tipweave.queries.text import KEYWORDS, RULE_TABLE
from tipweave.runtime import fresh_path
from tipweave.sources.cards import contacts, lookup, parse_cards, read_cards
from tipweave.sources.chat import read_chat, since_year
from tipweave.sinks.cards import card_text

REQUEST = ("from", "which", "are ")
RECOMMEND = (" best", "ingly", "heed")


def export_lines(turns: DataFrame) -> DataFrame:
    """Conversation turns as lines of a chat export: a header, then the text as it is."""
    day = F.date_format(F.expr("date_add(DATE'2020-01-01', int(conv_id % 3650))"), "d/M/yyyy")
    head = F.concat(day, F.lit(", "), (F.col("turn") % 24).cast("string"), F.lit(":05 - "))
    sender = F.concat_ws(" ", "role", "conv_id", "turn")
    return turns.select("conv_id", "turn", F.concat(head, sender, F.lit(": "), "text").alias("value"))


def export_chat(spark: SparkSession, turns: DataFrame, name: str) -> str:
    """Write turns as chat files, each a sorted range of turns."""
    path = fresh_path(spark, name)
    lines = export_lines(turns).repartitionByRange("conv_id", "turn")
    lines.sortWithinPartitions("conv_id", "turn").select("value").write.text(path)
    return path


def as_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as messages of one chat each; turns are dense already."""
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("chat_id"),
        F.col("turn").alias("msg_seq"),
        F.col("role").alias("sender"),
        F.concat_ws(" ", F.lit("turn"), F.col("turn").cast("string")).alias("date_str"),
        F.col("text").alias("body"),
    )


def with_attachments(messages: DataFrame) -> DataFrame:
    """Assistant turns carry a contact card."""
    mark = F.concat(
        F.lit("\n"), F.lit("Contact "), "chat_id", F.lit("-"), F.col("msg_seq").cast("string"),
        F.lit(".vcf (file attached)"),
    )
    return messages.withColumn(
        "body", F.when(F.col("sender") == "assistant", F.concat("body", mark)).otherwise(F.col("body"))
    )


@query(
    "chat_parse_roundtrip",
    """
    SELECT conv_id, turn, role,
           strftime(DATE '2020-01-01' + CAST(conv_id % 3650 AS INTEGER), '%-d/%-m/%Y') || ' '
             || CAST(turn % 24 AS VARCHAR) || ':05' AS date_str,
           array_to_string(list_filter(list_transform(string_split(text, chr(10)),
             lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10)) AS body
    FROM conversations
    """,
)
def chat_parse_roundtrip(spark, folder):
    path = export_chat(spark, table(spark, folder, "conversations"), "chat")
    parsed = read_chat(spark, path)
    part = F.split("sender", " ")
    return parsed.select(
        part[1].cast("long").alias("conv_id"),
        part[2].cast("long").alias("turn"),
        part[0].alias("role"),
        "date_str",
        "body",
    )


@query(
    "chat_year_filter",
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1
    """,
)
def chat_year_filter(spark, folder):
    o = table(spark, folder, "orders")
    messages = o.select(
        "o_orderkey",
        F.try_to_timestamp(
            F.date_format("o_orderdate", "d/M/yyyy H:mm"), F.lit("d/M/yyyy H:mm")
        ).alias("ts"),
    )
    kept = since_year(messages, 1997)
    return kept.groupBy(F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum")
    )


def customer_cards(spark, folder) -> DataFrame:
    c = table(spark, folder, "customer")
    mobile = F.concat(F.lit("+972 5"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    home = F.concat(F.lit("03-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    phones = F.when(F.col("c_acctbal") < 0, F.array(home, mobile)).otherwise(F.array(mobile, home))
    return c.select(
        "c_custkey",
        F.col("c_name").alias("name"),
        phones.alias("phones"),
        F.concat_ws(";", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("field"),
        F.concat(F.lit("segment, nation\n"), "c_mktsegment").alias("extra"),
    )


@query(
    "card_export",
    r"""
    WITH c AS (
      SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal,
             '+9725' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS mobile,
             '+03' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS home FROM customer)
    SELECT c_custkey,
      'BEGIN:VCARD' || chr(13) || chr(10) || 'VERSION:3.0' || chr(13) || chr(10)
      || 'FN:' || c_name || chr(13) || chr(10) || 'N:;' || c_name || ';;;' || chr(13) || chr(10)
      || CASE WHEN c_acctbal < 0
           THEN 'TEL;TYPE=VOICE:' || home || chr(13) || chr(10) || 'TEL;TYPE=CELL,PREF:' || mobile
           ELSE 'TEL;TYPE=CELL,PREF:' || mobile || chr(13) || chr(10) || 'TEL;TYPE=VOICE:' || home END
      || chr(13) || chr(10) || 'TITLE:' || c_mktsegment || '\;' || CAST(c_nationkey AS VARCHAR)
      || chr(13) || chr(10) || 'X-EXTRA-INFO:segment\, nation\n' || c_mktsegment
      || chr(13) || chr(10) || 'END:VCARD' AS card
    FROM c
    """,
)
def card_export(spark, folder):
    return customer_cards(spark, folder).select(
        "c_custkey",
        card_text(F.col("name"), F.col("phones"), F.col("field"), F.col("extra")).alias("card"),
    )


@query(
    "card_parse_roundtrip",
    r"""
    SELECT c_name AS name,
           CASE WHEN c_acctbal < 0 THEN '03' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')
                ELSE '05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
           c_mktsegment || '\;' || CAST(c_nationkey AS VARCHAR) AS title_vcf,
           'Seller; ' || c_mktsegment AS org
    FROM customer
    """,
)
def card_parse_roundtrip(spark, folder):
    cards = customer_cards(spark, folder)
    numbered = F.concat(F.substring("c_name", 10, 99), F.lit(". "), "c_name")
    text = card_text(F.col("name"), F.col("phones"), F.col("field"), F.col("extra"))
    org = F.concat(F.lit("\r\nORG:Seller; "), F.substring_index("field", ";", 1), F.lit("\r\nTITLE:"))
    lines = cards.withColumn("c_name", F.col("name")).select(
        F.replace(
            F.replace(text, F.concat(F.lit("FN:"), "c_name"), F.concat(F.lit("FN:"), numbered)),
            F.lit("\r\nTITLE:"),
            org,
        ).alias("value")
    )
    path = fresh_path(spark, "cards")
    lines.write.option("maxRecordsPerFile", 10_000).option("lineSep", "\r\n").text(path)
    files = (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    )
    return contacts(parse_cards(files)).select("name", "phone", "title_vcf", "org")


CONTEXT_SQL = """
  m AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq, role,
          CASE WHEN role = 'assistant' THEN text || chr(10) || 'Contact ' || CAST(conv_id AS VARCHAR)
               || '-' || CAST(turn AS VARCHAR) || '.vcf (file attached)' ELSE text END AS body
        FROM conversations),
  w AS (SELECT *,
          coalesce(string_agg(body, chr(1)) OVER (PARTITION BY chat_id ORDER BY msg_seq
            ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(body, chr(1)) OVER (PARTITION BY chat_id ORDER BY msg_seq
            ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after
        FROM m)
"""


def _seen(spark, folder) -> DataFrame:
    messages = with_attachments(as_messages(spark, folder))
    return m.with_context(m.find_mentions(messages), messages)


@query(
    "mention_context",
    f"""
    WITH {CONTEXT_SQL}
    SELECT chat_id, msg_seq, 'Contact ' || chat_id || '-' || CAST(msg_seq AS VARCHAR) || '.vcf' AS vcf_name,
           md5(before) AS before_md5, md5(after) AS after_md5, length(before) AS before_chars
    FROM w WHERE role = 'assistant'
    """,
)
def mention_context(spark, folder):
    before = F.array_join(m.bodies(F.col("ctx_before")), "\u0001")
    after = F.array_join(m.bodies(F.col("ctx_after")), "\u0001")
    return _seen(spark, folder).select(
        "chat_id",
        "msg_seq",
        "vcf_name",
        F.md5(before.cast("binary")).alias("before_md5"),
        F.md5(after.cast("binary")).alias("after_md5"),
        F.length(before).cast("long").alias("before_chars"),
    )


@query(
    "context_rendering",
    """
    WITH m AS (SELECT conv_id, turn, role, trim(replace(text, chr(10), ' ')) AS t FROM conversations),
    l AS (SELECT conv_id, turn, '- [turn ' || CAST(turn AS VARCHAR) || '] ' || role || ': ' ||
            CASE WHEN length(t) > 400 THEN substr(t, 1, 397) || '...' ELSE t END AS line FROM m)
    SELECT c.chat_id, c.msg_seq, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.turn), '')) AS shown_md5
    FROM (SELECT CAST(conv_id AS VARCHAR) AS chat_id, conv_id, turn AS msg_seq FROM conversations
          WHERE role = 'assistant') c
    LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn BETWEEN c.msg_seq - 5 AND c.msg_seq - 1
    GROUP BY 1, 2
    """,
)
def context_rendering(spark, folder):
    messages = as_messages(spark, folder)
    mentions = m.find_mentions(with_attachments(messages))
    seen = m.with_context(mentions, messages)
    shown = m.render_context(F.col("ctx_before"))
    return seen.select("chat_id", "msg_seq", F.md5(shown.cast("binary")).alias("shown_md5"))


@query(
    "nearest_request",
    f"""
    WITH r AS (
      SELECT conv_id, turn, text,
        last_value(CASE WHEN {any_contains("text", REQUEST)} THEN text END IGNORE NULLS) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS asked
      FROM conversations),
    n AS (SELECT conv_id, turn, trim(concat_ws(' | ', substr(text, 1, 150),
            replace(substr(asked, 1, 200), chr(10), ' ')), ' ' || chr(10)) AS note FROM r)
    SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq,
           CASE WHEN length(note) > 350 THEN substr(note, 1, 350) || '...' ELSE note END AS note
    FROM n
    """,
)
def nearest_request(spark, folder):
    asks = F.when(contains_any(F.col("body"), REQUEST), F.col("body"))
    framed = with_frames(
        as_messages(spark, folder),
        ["chat_id"],
        "msg_seq",
        {"asked": (-5, -1, lambda w: F.last(asks, ignorenulls=True).over(w))},
    )
    own = F.substring("body", 1, m.NOTE_MESSAGE)
    asked = F.replace(F.substring("asked", 1, m.NOTE_REQUEST), F.lit("\n"), F.lit(" "))
    note = strip(F.concat_ws(" | ", own, asked))
    return framed.select("chat_id", "msg_seq", cap(note, m.NOTE_LENGTH, "...").alias("note"))


@query(
    "rule_gate",
    f"""
    WITH {CONTEXT_SQL}
    SELECT chat_id || '#' || CAST(msg_seq AS VARCHAR) || '#0' AS mention_id,
      ({any_contains("body", RECOMMEND)} OR {any_contains("before", RECOMMEND)}
        OR {any_contains("after", RECOMMEND)} OR {any_contains("before", REQUEST)}) AS include,
      CASE WHEN {any_contains("body", RECOMMEND)} THEN 'recommended in the message'
           WHEN {any_contains("before", RECOMMEND)} OR {any_contains("after", RECOMMEND)}
             THEN 'recommended near the message'
           WHEN {any_contains("before", REQUEST)} THEN 'answers a request'
           ELSE 'no recommendation or request' END AS reason
    FROM w WHERE role = 'assistant'
    """,
)
def rule_gate(spark, folder):
    return m.rule_gate(_seen(spark, folder), RECOMMEND, REQUEST).select(
        "mention_id", "include", "reason"
    )


@query(
    "local_mentions",
    f"""
    WITH {CONTEXT_SQL}
    SELECT chat_id, msg_seq, ({any_contains("body", ["wh", "kei"])} OR {any_contains("before", ["wh", "kei"])}
      OR {any_contains("after", ["wh", "kei"])}) AS from_local
    FROM w WHERE role = 'assistant'
    """,
)
def local_mentions(spark, folder):
    ctx = [F.col("ctx_before"), F.col("ctx_after")]
    return _seen(spark, folder).select(
        "chat_id", "msg_seq", m.mentions_place(F.col("body"), ctx, ["wh", "kei"]).alias("from_local")
    )


@query(
    "mention_contact_join",
    """
    SELECT o_orderkey, c_name AS name, '05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0
    """,
)
def mention_contact_join(spark, folder):
    c = table(spark, folder, "customer")
    # Cards of customers in debt lie under names that no order mentions.
    lead = F.when(F.col("c_acctbal") < 0, "cards/old ").otherwise("cards/")
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", ".vcf.vcf").otherwise(".VCF")
    cards = c.select(
        F.concat(lead, "c_name", suffix).alias("file_path"),
        F.lit(0).alias("card_no"),
        F.col("c_name").alias("fn"),
        F.lit("").alias("n_name"),
        F.concat(F.lit("05"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
        *[F.lit("").alias(x) for x in ("org", "note_vcf", "title_vcf")],
    )
    mentions = table(spark, folder, "orders").select(
        "o_orderkey",
        F.format_string("Customer#%09d.vcf", "o_custkey").alias("vcf_name"),
    )
    found = m.with_contacts(mentions, lookup(contacts(cards)))
    return m.valid_candidates(found).select("o_orderkey", "name", "phone")


FOLD_NOTE = "CASE WHEN value < 5 THEN event_type ELSE event_type || ' ' || props END"


@query(
    "note_fold",
    f"""
    WITH e AS (SELECT user_id, event_id, {FOLD_NOTE} AS note FROM events)
    SELECT user_id,
      list_reduce(list(note ORDER BY event_id),
        lambda acc, n: CASE WHEN contains(acc, n) THEN acc ELSE acc || ' | ' || n END) AS note
    FROM e GROUP BY user_id
    """,
)
def note_fold(spark, folder):
    e = table(spark, folder, "events").select(
        "user_id",
        F.lit(0).alias("chat_id"),
        F.col("event_id").alias("msg_seq"),
        F.lit(0).alias("pos"),
        F.expr(FOLD_NOTE).alias("note"),
    )
    order = ["chat_id", "msg_seq", "pos"]
    first = e.groupBy("user_id").agg(
        F.min(F.struct(*order)).alias("o"), F.min_by("note", F.struct(*order)).alias("note")
    ).select("user_id", "o.*", "note")
    later = e.join(
        first.select("user_id", F.col("msg_seq").alias("_first")), "user_id"
    ).filter("msg_seq > _first")
    kept = fold_notes(first, later, "user_id", order, "note")
    return note_texts(kept, "user_id", order, "note")


RULES = msg.MessageRules(
    exclude=("rewh", "KEITBE", "ouiou"),
    off_topic=("anth",),
    off_topic_pairs=(("thea", "ndin"), ("reau", "vien")),
    polite_signs=(r"%%%",),
    polite_word="please",
    request=("please", "which", "are on"),
    strong=(" best", "ingly", "hther"),
    anchors=("heed", "tion ", "lich"),
    anchor_patterns=(r"\bder\s",),
    venue_patterns=(r"\bthat [a-z]+nd\b",),
    named_topic=(r"\bthe\s",),
    loose_topic=(r"\bof\s", r"\bde\s"),
    gossip=("is it", "for the"),
    area_patterns=(r"\bthe\s.{1,120}\bin\b",),
    opening_day="was",
    opening_words=("on", "by"),
    where_word="are",
    praise=("est ",),
    food=("ing ", "ment"),
    commerce_patterns=(r"\bto\s", r"\bles\s"),
    tribute_pairs=(("and", "ere"),),
)


def _asked(messages: DataFrame) -> DataFrame:
    """User turns end as a question."""
    return messages.withColumn(
        "body", F.when(F.col("sender") == "user", F.concat("body", F.lit("?"))).otherwise(F.col("body"))
    )


def _flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


MESSAGE_SQL = f"""
  b AS (SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq,
          CASE WHEN role = 'user' THEN text || '?' ELSE text END AS body FROM conversations),
  f AS (SELECT *, {_flat("body")} AS flat FROM b),
  s AS (SELECT *, {any_contains("body", RULES.strong)} AS strong,
               contains(body, '?') AS asks FROM f)
"""


@query(
    "message_filter_audit",
    f"""
    WITH {MESSAGE_SQL}
    SELECT chat_id, msg_seq, CASE
      WHEN {any_contains("lower(body)", [x.lower() for x in RULES.exclude])} THEN 'excluded'
      WHEN {any_contains("lower(flat)", RULES.off_topic)} OR (contains(flat, 'thea') AND contains(flat, 'ndin'))
        OR (contains(flat, 'reau') AND contains(flat, 'vien')) THEN 'off_topic'
      WHEN {any_contains(_flat("replace(flat, '%%%', ' please ')"), RULES.request)} THEN 'request'
      WHEN NOT strong AND asks AND contains(flat, 'are') AND
        (regexp_matches(flat, '\\bof\\s') OR regexp_matches(flat, '\\bde\\s')) THEN 'where'
      WHEN NOT strong AND asks AND regexp_matches(flat, '\\bthe\\s')
        AND {any_contains("flat", RULES.gossip)} THEN 'opinion'
      WHEN NOT strong AND asks AND regexp_matches(flat, '\\bthe\\s.{{1,120}}\\bin\\b') THEN 'area'
      WHEN NOT strong AND asks AND contains(flat, 'was') AND {any_contains("flat", RULES.opening_words)}
        AND (regexp_matches(flat, '\\bof\\s') OR regexp_matches(flat, '\\bde\\s')) THEN 'opening'
      WHEN NOT strong AND ends_with(flat, '?') THEN 'question'
      ELSE 'kept' END AS reason
    FROM s
    """,
)
def message_filter_audit(spark, folder):
    messages = _asked(as_messages(spark, folder))
    return messages.select(
        "chat_id",
        "msg_seq",
        F.coalesce(msg.reject_reason(F.col("body"), RULES), F.lit("kept")).alias("reason"),
    )


@query(
    "message_context_flags",
    f"""
    WITH {MESSAGE_SQL},
    v AS (SELECT *, regexp_matches(body, '\\bthat [a-z]+nd\\b') AS venue,
            {any_contains("body", RULES.anchors)} OR regexp_matches(body, '\\bder\\s') AS anchored FROM s)
    SELECT chat_id, msg_seq, venue OR (strong AND anchored) AS qualifies,
      venue OR anchored OR (contains(body, 'est ') AND {any_contains("body", RULES.food)}) AS loose,
      venue OR regexp_matches(flat, '\\bto\\s') OR regexp_matches(flat, '\\bles\\s') AS commerce,
      contains(flat, 'and') AND contains(flat, 'ere') AS tribute
    FROM v
    """,
)
def message_context_flags(spark, folder):
    body = F.col("body")
    return _asked(as_messages(spark, folder)).select(
        "chat_id",
        "msg_seq",
        msg.qualifies(body, RULES).alias("qualifies"),
        msg.loose_context(body, RULES, permissive=True).alias("loose"),
        msg.commerce_cue(body, RULES).alias("commerce"),
        msg.is_tribute(body, RULES).alias("tribute"),
    )


@query(
    "recommendation_topics",
    f"""
    WITH {RULE_TABLE},
    m AS (SELECT row_number() OVER () AS id, text FROM conversations
          WHERE NOT {any_contains("lower(text)", [x.lower() for x in RULES.exclude])}),
    exact AS (SELECT id, arg_min(label, priority) AS label FROM m, r WHERE contains(text, keyword) GROUP BY 1),
    loose AS (SELECT id, arg_min(label, priority) AS label FROM m, r
              WHERE contains(lower(text), lower(keyword)) GROUP BY 1),
    l AS (SELECT coalesce(e.label, o.label, '') AS label, {any_contains("text", RULES.strong)} AS recommends,
            length(text) AS chars
          FROM m LEFT JOIN exact e USING (id) LEFT JOIN loose o USING (id))
    SELECT label, recommends, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM l GROUP BY 1, 2
    """,
)
def recommendation_topics(spark, folder):
    """From export text to topics: stitch messages, drop excluded ones, label and count."""
    path = export_chat(spark, table(spark, folder, "conversations"), "chat")
    kept = read_chat(spark, path).filter(~msg.excluded(F.col("body"), RULES))
    labelled = kept.select(
        first_label(F.col("body"), KEYWORDS).alias("label"),
        msg.recommends(F.col("body"), RULES).alias("recommends"),
        F.length("body").alias("chars"),
    )
    return labelled.groupBy("label", "recommends").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").cast("long").alias("chars")
    )


@query(
    "note_fold_big",
    """
    SELECT o_orderpriority, 'first | ' || string_agg('note ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), ' | '
      ORDER BY o_orderkey) AS note
    FROM orders GROUP BY 1
    """,
)
def note_fold_big(spark, folder):
    """Contacts with some thousand different notes each."""
    o = table(spark, folder, "orders").select(
        "o_orderpriority",
        F.lit(0).alias("chat_id"),
        F.col("o_orderkey").alias("msg_seq"),
        F.lit(0).alias("pos"),
        F.concat(F.lit("note "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("note"),
    )
    order = ["chat_id", "msg_seq", "pos"]
    first = o.select("o_orderpriority").distinct().select(
        "o_orderpriority",
        F.lit(0).alias("chat_id"),
        F.lit(-1).cast("long").alias("msg_seq"),
        F.lit(0).alias("pos"),
        F.lit("first").alias("note"),
    )
    kept = fold_notes(first, o, "o_orderpriority", order, "note")
    return note_texts(kept, "o_orderpriority", order, "note")


FOLD_MARKED = """concat('k', o_custkey % 40,
  CASE WHEN o_orderkey % 3 > 0 THEN concat(' | k', o_orderkey % 37) ELSE '' END)"""


@query(
    "note_fold_marked",
    f"""
    WITH n AS (
      SELECT o_orderpriority AS contact, o_orderkey, {FOLD_MARKED} AS note FROM orders
      UNION ALL
      SELECT concat('customer ', o_custkey), o_orderkey, {FOLD_MARKED} FROM orders)
    SELECT contact, list_reduce(list(note ORDER BY o_orderkey),
      lambda acc, n: CASE WHEN contains(acc, n) THEN acc ELSE acc || ' | ' || n END) AS note
    FROM n GROUP BY contact
    """,
)
def note_fold_marked(spark, folder):
    """Notes that hold the separator, of contacts with few and with very many notes."""
    orders = table(spark, folder, "orders").select(
        "o_orderpriority", F.concat(F.lit("customer "), "o_custkey").alias("customer"),
        F.lit(0).alias("chat_id"), F.col("o_orderkey").alias("msg_seq"), F.lit(0).alias("pos"),
        F.expr(FOLD_MARKED).alias("note"),
    )
    order = ["chat_id", "msg_seq", "pos"]
    contact = F.explode(F.array("o_orderpriority", "customer")).alias("contact")
    notes = orders.select(contact, *order, "note")
    place = F.struct(*order)
    first = notes.groupBy("contact").agg(F.min(place).alias("o"), F.min_by("note", place).alias("note"))
    starts = first.select("contact", F.col("o.msg_seq").alias("_first"))
    later = notes.join(starts, "contact").filter("msg_seq > _first")
    kept = fold_notes(first.select("contact", "o.*", "note"), later, "contact", order, "note")
    return note_texts(kept, "contact", order, "note")
