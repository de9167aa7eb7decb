"""Scalar expressions, dictionaries, categories, mining, verdict texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.functions import phone as ph
from tipweave.functions import text as tx
from tipweave.operators import category as cat
from tipweave.operators import mining
from tipweave.operators.dictionary import (
    Rule,
    first_label,
    label_rows,
    match_by_grams,
    voted_label,
)
from tipweave.operators.verdicts import read_venues, read_verdict, with_verdicts
from tipweave.queries.registry import query, table, values
from tipweave.sinks import reports

KEYWORDS = [
    Rule(i, word, label)
    for i, (word, label) in enumerate(
        [
            ("rewh", "noise"), ("%%%", "noise"), ("@mail", "contact"), ("http", "contact"),
            ("License", "legal"), ("Copyright", "legal"), ("keitung", "german"), ("schaft", "german"),
            ("ungen", "german"), ("lichkeit", "german"), ("eauou", "french"), ("èmentre", "french"),
            ("elleê", "french"), ("ción", "spanish"), ("mente", "spanish"), ("ando", "spanish"),
            ("tionere", "english"), ("hather", "english"), ("ingth", "english"), ("nessheed", "english"),
            ("THEED", "english"), ("Und", "german"), ("heed", "english"), ("ment", "french"),
            ("dad", "spanish"), ("sch", "german"), ("tion", "latin"), ("er", "common"),
            ("en", "common"), ("a", "letter"),
        ],
        start=1,
    )
]
RULES_SQL = values((r.priority, r.keyword, r.label) for r in KEYWORDS)
RULE_TABLE = f"r(priority, keyword, label) AS (VALUES {RULES_SQL})"


def _format_phone(key: str, segment: str):
    k = F.lpad(F.col(key).cast("string"), 8, "0")
    return (
        F.when(F.col(segment) == "AUTOMOBILE", F.concat(F.lit("05"), k))
        .when(F.col(segment) == "BUILDING", F.concat(F.lit("+972 5"), F.substring(k, 1, 3), F.lit("-"), F.substring(k, 4, 5)))
        .when(F.col(segment) == "FURNITURE", F.concat(F.lit("5"), k))
        .when(F.col(segment) == "HOUSEHOLD", F.concat(F.lit("+1 (20) "), k))
        .otherwise(F.concat(F.lit("03-"), F.substring(k, 2, 7)))
    )


PHONE_SQL = """
  p AS (SELECT *, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS k FROM customer),
  q AS (SELECT *, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '05' || k
      WHEN 'BUILDING' THEN '+972 5' || substr(k, 1, 3) || '-' || substr(k, 4, 5)
      WHEN 'FURNITURE' THEN '5' || k WHEN 'HOUSEHOLD' THEN '+1 (20) ' || k
      ELSE '03-' || substr(k, 2, 7) END AS raw FROM p),
  d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM q),
  t AS (SELECT *, CASE WHEN starts_with(digits, '972') THEN '0' || substr(digits, 4) ELSE digits END AS trunk FROM d),
  n AS (SELECT *, CASE WHEN length(trunk) = 9 AND substr(trunk, 1, 1) BETWEEN '2' AND '9' THEN '0' || trunk
      ELSE trunk END AS national FROM t),
  v AS (SELECT *, regexp_matches(national, '^(05[0-9]{8}|0[23489][0-9]{8}|07[234679][0-9]{7}|0[23489][0-9]{7})$') AS valid FROM n)
"""


def phones(spark, folder):
    return table(spark, folder, "customer").withColumn(
        "raw", _format_phone("c_custkey", "c_mktsegment")
    )


@query(
    "phone_keys",
    f"""
    WITH {PHONE_SQL}
    SELECT c_custkey, national, right(digits, 10) AS last10,
      CASE WHEN starts_with(raw, '+') THEN '+' || digits ELSE '+' || digits END AS intl,
      valid AS is_valid,
      regexp_matches(digits, '^(972|0)?5[0-9]{{8,}}$') AS is_mobile
    FROM v
    """,
)
def phone_keys(spark, folder):
    raw = F.col("raw")
    return phones(spark, folder).select(
        "c_custkey",
        ph.national(raw).alias("national"),
        ph.last10(raw).alias("last10"),
        ph.international(raw).alias("intl"),
        ph.is_valid(raw).alias("is_valid"),
        ph.is_mobile(raw).alias("is_mobile"),
    )


@query(
    "rejected_phones",
    f"""
    WITH {PHONE_SQL}
    SELECT national AS phone, min(c_name) AS name FROM v WHERE NOT valid GROUP BY 1
    """,
)
def rejected_phones(spark, folder):
    contacts = phones(spark, folder).select(
        ph.national(F.col("raw")).alias("phone"),
        F.col("c_name").alias("name"),
        F.col("c_name").alias("vcf_filename"),
    )
    return reports.rejected_phones(contacts).select("phone", "name")


@query(
    "category_first_match",
    f"""
    WITH {RULE_TABLE},
    exact AS (SELECT doc_id, arg_min(label, priority) AS label FROM documents, r
              WHERE contains(text, keyword) GROUP BY 1),
    loose AS (SELECT doc_id, arg_min(label, priority) AS label FROM documents, r
              WHERE contains(lower(text), lower(keyword)) GROUP BY 1)
    SELECT d.doc_id, coalesce(e.label, l.label, '') AS label
    FROM documents d LEFT JOIN exact e USING (doc_id) LEFT JOIN loose l USING (doc_id)
    """,
)
def category_first_match(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", first_label(F.col("text"), KEYWORDS).alias("label")
    )


VOTE_SQL = f"""
    WITH {RULE_TABLE},
    n AS (SELECT doc_id, label, sum((length(t) - length(replace(t, k, ''))) // length(k)) AS n,
                 min(priority) AS first
          FROM (SELECT doc_id, lower(text) AS t, lower(keyword) AS k, label, priority FROM documents, r)
          WHERE contains(t, k) GROUP BY 1, 2),
    w AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM n)
    SELECT d.doc_id, coalesce(w.label, '') AS label FROM documents d
    LEFT JOIN w ON w.doc_id = d.doc_id AND rn = 1
"""


@query("category_vote", VOTE_SQL)
def category_vote(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", voted_label(F.col("text"), KEYWORDS).alias("label")
    )


@query(
    "dictionary_matches",
    """
    WITH k AS (SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' ')) AS keyword
               FROM benchmark),
    c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
    SELECT conv_id, turn, keyword, (length(t) - length(replace(t, keyword, ''))) // length(keyword) AS n
    FROM c JOIN k ON contains(t, keyword) WHERE keyword <> ''
    """,
)
def dictionary_matches(spark, folder):
    """A dictionary that grows with the data: every word of the benchmark texts."""
    bare = F.regexp_replace(F.lower("text"), "[^a-z ]", " ")
    rules = (
        table(spark, folder, "benchmark")
        .select(F.explode(F.split(bare, " ")).alias("keyword"))
        .filter("keyword <> ''")
        .distinct()
        .select(F.lit(0).alias("priority"), "keyword", F.col("keyword").alias("label"))
    )
    texts = table(spark, folder, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), F.lower("text").alias("t")
    )
    return match_by_grams(texts, "id", "t", rules).select("id.conv_id", "id.turn", "keyword", "n")


@query(
    "rule_table_labels",
    """
    WITH r AS (SELECT n_nationkey AS priority, substr(c.text, 1, 0) || lower(n_name) AS keyword, n_name AS label
               FROM nation, (SELECT '' AS text) c),
    u AS (SELECT url, page_id, lower(url) AS t FROM pages)
    SELECT page_id, coalesce((SELECT arg_min(label, priority) FROM r WHERE contains(t, keyword)), '') AS label
    FROM u
    """,
)
def rule_table_labels(spark, folder):
    """Labels from a rule table read from storage; its size decides how it is matched."""
    rules = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("priority"),
        F.lower("n_name").alias("keyword"),
        F.col("n_name").alias("label"),
    )
    pages = table(spark, folder, "pages").select("page_id", "url")
    return label_rows(pages, "page_id", "url", rules, "first").select("page_id", "label")


NAME_RULES = [Rule(1, "widget", "device"), Rule(2, "bolt", "fastener"), Rule(3, "red", "colour"), Rule(4, "HOT", "heat")]
GUARDS = [cat.Guard("colour", ("ring", "plate")), cat.Guard("heat", ("gear",), None)]


@query(
    "category_cascade",
    """
    WITH s AS (SELECT *, lower(p_brand) AS b FROM part),
    l AS (SELECT p_partkey, p_name, p_type, CASE
        WHEN contains(p_name, 'widget') THEN 'device' WHEN contains(p_name, 'bolt') THEN 'fastener'
        WHEN contains(p_name, 'red') THEN 'colour' WHEN contains(p_name, 'hot') THEN 'heat'
        WHEN contains(p_type, 'SMALL') OR contains(p_type, 'LARGE') THEN 'sized'
        WHEN contains(b, 'brand#1') THEN 'first' ELSE '' END AS label FROM s)
    SELECT p_partkey, CASE
      WHEN label = 'colour' AND NOT (contains(p_name, 'ring') OR contains(p_name, 'plate')) THEN ''
      WHEN label = 'heat' AND NOT contains(p_name, 'gear') THEN '' ELSE label END AS label
    FROM l
    """,
)
def category_cascade(spark, folder):
    sized = [Rule(1, "SMALL", "sized"), Rule(2, "large", "sized")]
    brand = [Rule(1, "brand#1", "first")]
    label = cat.cascade(
        [
            cat.from_text(F.col("p_name"), NAME_RULES),
            cat.from_text(F.col("p_type"), sized),
            cat.from_note(F.col("p_brand"), brand),
        ]
    )
    return table(spark, folder, "part").select(
        "p_partkey", cat.guarded(label, F.col("p_name"), F.col("p_type"), GUARDS).alias("label")
    )


SUB_RULES = [
    cat.SubRule("SMALL", 1, "name", ("ring",), "rings"),
    cat.SubRule("SMALL", 2, "note", ("brand#1", "hot"), "hot first"),
    cat.SubRule("LARGE", 1, "note", ("brand#2",), ""),
    cat.SubRule("LARGE", 2, "note", ("bolt",), "bolts", ("red",)),
    cat.SubRule("LARGE", 3, "raw", ("gear",), "gears"),
    cat.SubRule("PROMO", 1, "raw", ("brand#25",), "last brand"),
]
SUB_SQL = """
    WITH s AS (SELECT *, p_name || ' ' || lower(p_brand) AS note FROM part)
    SELECT p_partkey, CASE p_type
      WHEN 'SMALL' THEN CASE WHEN contains(p_name, 'ring') THEN 'rings'
        WHEN contains(note, 'brand#1') AND contains(note, 'hot') THEN 'hot first' ELSE '' END
      WHEN 'LARGE' THEN CASE WHEN contains(note, 'brand#2') THEN ''
        WHEN contains(note, 'bolt') AND NOT contains(note, 'red') THEN 'bolts'
        WHEN contains(note, 'gear') THEN 'gears' ELSE '' END
      WHEN 'PROMO' THEN CASE WHEN contains(note, 'brand#25') THEN 'last brand' ELSE '' END
      ELSE '' END AS sub_label FROM s
"""


def _parts_as_entries(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.lower("p_brand").alias("note"),
        F.col("p_type").alias("field"),
        "p_size",
    )


@query("sub_label", SUB_SQL)
def sub_label(spark, folder):
    return _parts_as_entries(spark, folder).select(
        "p_partkey",
        cat.sub_label(F.col("name"), F.col("note"), F.col("field"), SUB_RULES).alias("sub_label"),
    )


@query("sub_label_join", SUB_SQL)
def sub_label_join(spark, folder):
    rules = spark.createDataFrame(
        [(r.category, r.priority, r.scope, list(r.all_of), list(r.none_of), r.label) for r in SUB_RULES],
        "category string, priority int, scope string, all_of array<string>, none_of array<string>, label string",
    )
    return cat.match_sub_rules(_parts_as_entries(spark, folder), "p_partkey", rules).select(
        "p_partkey", "sub_label"
    )


NORM_RULES = [
    cat.NormRule("Metal", ("name", "field"), ("ring", "plate", "PROMO")),
    cat.NormRule("Warm", ("name",), ("hot",), ("gear",)),
    cat.NormRule("Small goods", ("field",), ("SMALL", "MEDIUM")),
    cat.NormRule("Bolted", ("name", "field", "note"), (" bolt", cat.START + "bolt "), ("Metal", "brand#13")),
    cat.NormRule("Tail", ("field",), ("m" + cat.END,), ("Warm",)),
    cat.NormRule("Widgets", ("name",), ("widget",), unless_name_says=True),
    cat.NormRule("Hotwire", ("field",), unless=(("DARD", "STAN"), ("ECON", "ZZ"))),
]


@query(
    "category_normalise",
    """
    WITH a AS (SELECT p_partkey, p_name, lower(p_brand) AS note, CASE
        WHEN p_size > 45 THEN ' NULL ' WHEN p_size > 40 THEN chr(128512) WHEN p_size > 38 THEN NULL
        ELSE p_type END AS f0 FROM part),
    b AS (SELECT *, CASE WHEN f0 IS NULL OR lower(trim(f0)) = 'null' OR f0 = chr(128512) THEN '' ELSE f0 END AS f1 FROM a),
    c AS (SELECT *, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'plate') OR contains(f1, 'ring')
        OR contains(f1, 'plate') OR contains(f1, 'PROMO') THEN 'Metal' ELSE f1 END AS f2 FROM b),
    d AS (SELECT *, CASE WHEN contains(p_name, 'hot') AND NOT contains(p_name || ' ' || f2, 'gear') THEN 'Warm' ELSE f2 END AS f3 FROM c),
    e AS (SELECT *, CASE WHEN contains(f3, 'SMALL') OR contains(f3, 'MEDIUM') THEN 'Small goods' ELSE f3 END AS f4 FROM d),
    f AS (SELECT *, CASE WHEN regexp_matches(p_name, '(^|\\s)bolt(\\s|$)') AND NOT contains(p_name || ' ' || f4, 'Metal')
        AND NOT contains(p_name || ' ' || f4, 'brand#13') THEN 'Bolted' ELSE f4 END AS f5 FROM e),
    g AS (SELECT *, CASE WHEN ends_with(f5, 'm') AND NOT contains(f5, 'Warm') THEN 'Tail' ELSE f5 END AS f6 FROM f),
    h AS (SELECT *, CASE WHEN contains(p_name, 'widget') AND NOT contains(p_name, 'red') THEN 'Widgets'
      ELSE f6 END AS f7 FROM g)
    SELECT p_partkey, CASE WHEN contains(f7, 'ECON') THEN 'Hotwire' ELSE f7 END AS field FROM h
    """,
)
def category_normalise(spark, folder):
    entries = _parts_as_entries(spark, folder)
    raw = (
        F.when(F.col("p_size") > 45, " NULL ")
        .when(F.col("p_size") > 40, "\U0001f600")
        .when(F.col("p_size") > 38, None)
        .otherwise(F.col("field"))
    )
    clean = entries.withColumn("field", cat.drop_emoji_only(cat.drop_null_words(raw)))
    named = [Rule(1, "red", "Colour")]
    return cat.normalise(clean, NORM_RULES, named).select("p_partkey", "field")


@query(
    "fill_empty_category",
    """
    SELECT p_partkey, CASE WHEN p_size >= 10 THEN p_type WHEN contains(p_name, 'widget') THEN 'device'
      WHEN contains(p_name, 'bolt') THEN 'fastener' WHEN contains(p_name, 'red') THEN 'colour'
      WHEN contains(p_name, 'hot') THEN 'heat' ELSE '' END AS field
    FROM part
    """,
)
def fill_empty_category(spark, folder):
    entries = _parts_as_entries(spark, folder).withColumn(
        "field", F.when(F.col("p_size") < 10, " ").otherwise(F.col("field"))
    )
    return cat.fill_empty(entries, NAME_RULES).select("p_partkey", "field")


@query(
    "rule_audit",
    """
    WITH w AS (SELECT p_name, p_type, min(p_partkey) AS priority FROM part GROUP BY 1, 2),
    k AS (SELECT priority, CASE WHEN p_type = 'SMALL' THEN split_part(p_name, ' ', 1) ELSE p_name END AS keyword,
                 p_type AS label FROM w)
    SELECT a.priority, a.keyword, a.label, min(b.priority) AS by_priority
    FROM k a JOIN k b ON b.priority < a.priority AND contains(a.keyword, b.keyword)
    GROUP BY ALL
    """,
)
def rule_audit(spark, folder):
    ranked = (
        table(spark, folder, "part")
        .groupBy("p_name", "p_type")
        .agg(F.min("p_partkey").alias("priority"))
    )
    rules = ranked.select(
        "priority",
        F.when(F.col("p_type") == "SMALL", F.substring_index("p_name", " ", 1))
        .otherwise(F.col("p_name"))
        .alias("keyword"),
        F.col("p_type").alias("label"),
    )
    return cat.shadowed_rules(rules).select("priority", "keyword", "label", "by_priority")


PATTERNS = [
    ("ing[a-z]+ed", "english"),
    ("[a-z]+schaft|ung[a-z]+", "german"),
    ("eau[a-z]*", "french"),
    ("[a-z]*dad", "spanish"),
    ("th[aeiou][a-z]+", "english"),
]


@query(
    "keyword_mining",
    """
    WITH u AS (SELECT text FROM documents ANTI JOIN labels USING (doc_id)),
    h AS (SELECT CASE WHEN regexp_matches(text, '(?i)ing[a-z]+ed') THEN regexp_extract(text, '(?i)(ing[a-z]+ed)', 1)
        WHEN regexp_matches(text, '(?i)[a-z]+schaft|ung[a-z]+') THEN regexp_extract(text, '(?i)([a-z]+schaft|ung[a-z]+)', 1)
        WHEN regexp_matches(text, '(?i)eau[a-z]*') THEN regexp_extract(text, '(?i)(eau[a-z]*)', 1)
        WHEN regexp_matches(text, '(?i)[a-z]*dad') THEN regexp_extract(text, '(?i)([a-z]*dad)', 1)
        WHEN regexp_matches(text, '(?i)th[aeiou][a-z]+') THEN regexp_extract(text, '(?i)(th[aeiou][a-z]+)', 1) END AS p,
      CASE WHEN regexp_matches(text, '(?i)ing[a-z]+ed') THEN 'english'
        WHEN regexp_matches(text, '(?i)[a-z]+schaft|ung[a-z]+') THEN 'german'
        WHEN regexp_matches(text, '(?i)eau[a-z]*') THEN 'french'
        WHEN regexp_matches(text, '(?i)[a-z]*dad') THEN 'spanish' ELSE 'english' END AS field FROM u)
    SELECT substr(trim(p), 1, 50) AS phrase, field, count(*) AS n FROM h WHERE p IS NOT NULL
    GROUP BY 1, 2 ORDER BY n DESC, phrase, field LIMIT 80
    """,
)
def keyword_mining(spark, folder):
    documents = table(spark, folder, "documents")
    unlabelled = documents.join(table(spark, folder, "labels"), "doc_id", "left_anti")
    return mining.suggested_keywords(unlabelled, PATTERNS, "text")


@query(
    "phrase_counters",
    """
    SELECT phrase, n FROM (
      SELECT unnest(['hot things', 'rings', 'small or promo', 'no gears']) AS phrase,
             unnest([count(*) FILTER (contains(p_name, 'hot')),
                     count(*) FILTER (contains(p_name, 'ring') AND NOT contains(p_name, 'red')),
                     count(*) FILTER (contains(p_type, 'SMALL') OR contains(p_type, 'PROMO')),
                     count(*) FILTER (contains(p_name, 'gear') AND contains(p_name, 'zzz'))]) AS n
      FROM part) WHERE n > 0
    """,
)
def phrase_counters(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_name").alias("name"), F.col("p_type").alias("note")
    )
    counters = [
        ("hot things", [[("name", "hot")]]),
        ("rings", [[("name", "ring")]], [("name", "red")]),
        ("small or promo", [[("note", "SMALL"), ("note", "PROMO")]]),
        ("no gears", [[("name", "gear")], [("name", "zzz")]]),
    ]
    return mining.phrase_counts(entries, counters)


@query(
    "empty_category_report",
    """
    SELECT p_name AS name, substr(p_brand || ' ' || p_type, 1, 350) AS note FROM part WHERE p_size < 10
    """,
)
def empty_category_report(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_brand", "p_type").alias("note"),
        F.when(F.col("p_size") < 10, "  ").otherwise(F.col("p_type")).alias("field"),
    )
    return reports.without_category(entries)


def answers(spark, folder):
    """Answers around the event properties: clean, fenced, in prose, unquoted, empty.

    In the objects ``include`` is a truth value, a number, a text (of which only the empty one is
    false, as the text "false" is not) or null.
    """
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", r"(\d+)", 1)
    yes = F.when(F.col("value") < 10, "true").otherwise("false")
    low, kind = F.col("value") < 10, F.col("event_id") % 5
    include = (
        F.when(kind == 0, yes)
        .when(kind == 1, F.when(low, "1").otherwise("0"))
        .when(kind == 2, F.when(low, '"yes"').otherwise('""'))
        .when(kind == 3, '"false"')
        .otherwise("null")
    )
    obj = F.concat(
        F.lit('{"include": '), include, F.lit(', "field": "f'), k, F.lit('", "reason": "kind '),
        "event_type", F.lit('"}'),
    )
    raw = (
        F.when(F.col("event_type") == "view", obj)
        .when(F.col("event_type") == "click", F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```\nDone.")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("I think "), obj, F.lit(" fits.")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("include: "), yes, F.lit(', "reason": "a \\"b\\" '), k, F.lit('"')))
        .otherwise(F.lit(" "))
    )
    return e.select("event_id", "event_type", raw.alias("raw"), k.alias("k"))


@query(
    "verdict_parse",
    r"""
    WITH judged AS (
      SELECT *, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN value < 10
        WHEN event_id % 5 < 3 THEN value < 10 ELSE event_id % 5 = 3 END AS include FROM events)
    SELECT event_id, include,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' OR NOT include THEN ''
           ELSE 'f' || regexp_extract(props, '([0-9]+)', 1) END AS field,
      CASE WHEN event_type = 'error' THEN NULL
           WHEN event_type = 'signup' THEN 'a "b" ' || regexp_extract(props, '([0-9]+)', 1)
           ELSE 'kind ' || event_type END AS reason,
      CASE WHEN event_type = 'error' THEN 'empty answer' END AS error
    FROM judged
    """,
)
def verdict_parse(spark, folder):
    return answers(spark, folder).select("event_id", read_verdict(F.col("raw")).alias("v")).select(
        "event_id", "v.*"
    )


@query(
    "venue_answers",
    """
    SELECT event_id, 0 AS pos, 'Place ' || user_id AS name, event_type AS location FROM events
    WHERE event_type IN ('view', 'click')
    UNION ALL
    SELECT event_id, 1, 'Second', '' FROM events WHERE event_type = 'click'
    """,
)
def venue_answers(spark, folder):
    e = table(spark, folder, "events")
    one = F.concat(
        F.lit('{"venues": [{"name": " Place '), F.col("user_id").cast("string"),
        F.lit('", "location": "'), "event_type", F.lit('"}'),
    )
    raw = (
        F.when(F.col("event_type") == "view", F.concat(one, F.lit(', {"name": " "}]}')))
        .when(F.col("event_type") == "click", F.concat(F.lit("ok "), one, F.lit(', {"name": "Second"}]} end')))
        .otherwise(F.lit("no venues"))
    )
    return e.select("event_id", F.posexplode(read_venues(raw)).alias("pos", "v")).select(
        "event_id", "pos", "v.name", "v.location"
    )


@query(
    "folded_names",
    """
    WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT page_id, lower(trim(regexp_replace(regexp_replace(title, '[-–—.,;:!?"''״׳()\\[\\]{}|/\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))) AS folded,
      trim(regexp_replace(title, '^[^\\p{L}]+', '')) AS from_letter,
      length(title) AS n
    FROM t
    """,
)
def folded_names(spark, folder):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select(
        "page_id",
        tx.fold_name(title).alias("folded"),
        tx.name_from_first_letter(title).alias("from_letter"),
        F.length(title).cast("long").alias("n"),
    )


@query(
    "keyword_report",
    """
    WITH h AS (SELECT CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'gear') THEN 'gear' END AS phrase,
                 CASE WHEN contains(p_name, 'ring') THEN 'metal' ELSE 'machine' END AS field FROM part),
    n AS (SELECT phrase, field, count(*) AS n FROM h WHERE phrase IS NOT NULL GROUP BY 1, 2)
    SELECT printf('  %4d  ''%s'' -> %s', n, phrase, field) AS line FROM n
    UNION ALL SELECT printf('  %4d  %s', count(*), 'red') FROM part WHERE contains(p_name, 'red')
    """,
)
def keyword_report(spark, folder):
    entries = _parts_as_entries(spark, folder)
    suggested = mining.suggested_keywords(entries, [("ring", "metal"), ("gear", "machine")], "name")
    phrases = mining.phrase_counts(entries, [("red", [[("name", "red")]])])
    return reports.suggestion_lines(suggested, phrases).select("line")


@query(
    "judged_mentions",
    r"""
    WITH judged AS (
      SELECT event_id, props, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN value < 10
        WHEN event_id % 5 < 3 THEN value < 10 ELSE event_id % 5 = 3 END AS include, event_type FROM events)
    SELECT o_orderkey AS mention_id, coalesce(include, false) AS include,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' OR NOT include THEN ''
           ELSE 'f' || regexp_extract(props, '([0-9]+)', 1) END AS judged_field,
      CASE WHEN event_type = 'error' THEN 'empty answer' END AS error
    FROM orders LEFT JOIN judged ON event_id = o_orderkey
    """,
)
def judged_mentions(spark, folder):
    """Mentions with the answers of a judge; those it never saw are not included."""
    mentions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("mention_id"))
    read = answers(spark, folder).select(
        F.col("event_id").alias("mention_id"), read_verdict(F.col("raw")).alias("v")
    )
    judged = with_verdicts(mentions, read.select("mention_id", "v.*"))
    return judged.select("mention_id", "include", "judged_field", "error")


@query(
    "dictionary_guarded",
    """
    SELECT o_orderkey, 'k' || o_custkey AS keyword, CAST(1 AS BIGINT) AS n
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 20
    UNION ALL
    SELECT o_orderkey, 'k' || c_custkey, 2
    FROM orders JOIN customer ON c_nationkey >= 20
      AND starts_with('k' || o_custkey, 'k' || c_custkey)
    """,
)
def dictionary_guarded(spark, folder):
    """Keywords that count where their guard matches, and plain ones, matched by letter runs."""
    texts = table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat_ws("", F.lit("k"), "o_custkey", F.lit(" k"), "o_custkey", F.lit("z")).alias("t"),
    )
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    rules = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("priority"),
        key.alias("keyword"),
        F.lit("label").alias("label"),
        F.when(F.col("c_nationkey") < 20, F.concat(key, F.lit("(?![0-9z])"))).alias("guard"),
    )
    return match_by_grams(texts, "o_orderkey", "t", rules).select("o_orderkey", "keyword", "n")
