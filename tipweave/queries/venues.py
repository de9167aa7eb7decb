"""Venue names, plausibility, places, merge, websites, evidence, bulletin and seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.functions.ids import evidence_key
from tipweave.functions.text import fold_spaces
from tipweave.operators import evidence as ev
from tipweave.operators import names as nm
from tipweave.operators import venues as vn
from tipweave.operators.dictionary import longest_alias
from tipweave.queries.registry import any_contains, query, table, values
from tipweave.sources.bulletin import bulletin_items as read_bulletin
from tipweave.sources.bulletin import seed_since

NAMES = nm.NameRules(
    chat_patterns=(r"ing of ",),
    chat_phrases=("rewh", "HUNDERT"),
    lead_patterns=(r"^The ",),
    sentence_patterns=(r"^(?:is|and|of)\s",),
    reject_phrases=("license", "qué"),
    generic_exact=("red ring", "hot gear"),
    solo_words=("und", "that", "the"),
    descriptor_leads=("small",),
    place_prefix="b",
    category_words=("hot", "By"),
    category_followers=("the", "of"),
    junk_exact=("the", "that"),
    junk_prefixes=("re", "qu"),
    junk_phrases=("shth", "chen"),
    tail_patterns=(r"\d\d-",),
)
PATTERNS = (
    vn.NamePattern(r"with ([a-z]{2,12})"),
    vn.NamePattern(r"von ([a-z]{2,12})", not_starting=("ein",)),
    vn.NamePattern(r"([A-Z][a-z]+) de "),
    vn.NamePattern(r"of the ([a-z]+)", first_not=("and", "of"), needs=("e", "i")),
)


@query(
    "venue_candidates",
    f"""
    WITH m AS (
      SELECT doc_id, 1 AS rank, regexp_extract_all(text, 'with ([a-z]{{2,12}})', 1) AS names FROM documents
      UNION ALL SELECT doc_id, 2, list_filter(regexp_extract_all(text, 'von ([a-z]{{2,12}})', 1),
        lambda n: NOT starts_with(n, 'ein')) FROM documents
      UNION ALL SELECT doc_id, 3, regexp_extract_all(text, '([A-Z][a-z]+) de ', 1) FROM documents
      UNION ALL SELECT doc_id, 4, list_filter(regexp_extract_all(text, 'of the ([a-z]+)', 1),
        lambda n: n <> 'and' AND n <> 'of' AND (contains(n, 'e') OR contains(n, 'i'))) FROM documents),
    u AS (SELECT doc_id, rank, unnest(names) AS name, generate_subscripts(names, 1) AS spot FROM m),
    ok AS (SELECT *, lower(name) AS k FROM u WHERE name <> ''
      AND NOT {any_contains("lower(name)", ["rewh", "hundert"])}
      AND name NOT IN ('the', 'that') AND NOT starts_with(name, 're') AND NOT starts_with(name, 'qu')
      AND NOT contains(name, 'shth') AND NOT contains(name, 'chen')),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY rank, spot) AS rn FROM ok)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rank, spot) - 1 AS INTEGER) AS pos, name
    FROM f WHERE rn = 1
    """,
)
def venue_candidates(spark, folder):
    found = vn.extract_names(F.col("text"), PATTERNS, NAMES)
    return table(spark, folder, "documents").select("doc_id", F.posexplode(found).alias("pos", "name"))


ALL_NAMES_SQL = """
  n AS (SELECT DISTINCT name FROM (
    SELECT p_name AS name FROM part UNION ALL
    SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages UNION ALL
    SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) FROM pages UNION ALL
    SELECT unnest(string_split(text, chr(10))) FROM benchmark)),
  s AS (SELECT name, trim(regexp_replace(regexp_replace(trim(trim(name), ' "''״׳-–—'),
          '^[*\\s]*\\*\\s*|\\s*\\*[*\\s]*$', '', 'g'), '\\s+', ' ', 'g')) AS s FROM n),
  w AS (SELECT *, list_filter(string_split(s, ' '), lambda x: x <> '') AS parts FROM s)
"""


def all_names(spark, folder):
    html = table(spark, folder, "pages")
    part = table(spark, folder, "part").select(F.col("p_name").alias("name"))
    titles = html.select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    links = html.select(F.explode(link_names("html")).alias("name"))
    lines = table(spark, folder, "benchmark").select(F.explode(F.split("text", "\n")).alias("name"))
    return part.union(titles).union(links).union(lines).distinct()


def link_names(html: str):
    return F.regexp_extract_all(html, F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))


@query(
    "name_plausible",
    f"""
    WITH {ALL_NAMES_SQL}
    SELECT name, CASE
      WHEN length(s) < 2 THEN 'too_short'
      WHEN regexp_matches(s, 'ing of ') OR contains(lower(s), 'rewh') OR contains(lower(s), 'hundert') THEN 'chat_junk'
      WHEN length(s) > CASE WHEN contains(s, ' — ') OR contains(s, ' / ') THEN 76 ELSE 50 END THEN 'too_long'
      WHEN regexp_matches(s, '^[\\s()?*/.:;!,]+') THEN 'bad_start'
      WHEN starts_with(s, 'The ') THEN 'leading_place'
      WHEN regexp_matches(s, '^(is|and|of)\\s') THEN 'sentence'
      WHEN contains(s, '?') AND NOT (contains(s, ' — ') OR contains(s, ' / ')) THEN 'question'
      WHEN contains(lower(s), 'license') OR contains(lower(s), 'qué') THEN 'phrase'
      WHEN lower(s) IN ('red ring', 'hot gear') THEN 'generic'
      WHEN lower(s) IN ('und', 'that', 'the') THEN 'solo_word'
      WHEN len(parts) > CASE WHEN contains(s, ' — ') OR contains(s, ' / ') THEN 12 ELSE 7 END THEN 'too_many_words'
      WHEN len(parts) >= 2 AND parts[1] = 'small' AND starts_with(parts[2], 'b') THEN 'descriptor'
      WHEN NOT (contains(s, ' — ') OR contains(s, ' / ')) AND parts[1] IN ('hot', 'By')
        AND (len(parts) >= 5 OR (len(parts) >= 3 AND parts[2] IN ('the', 'of'))) THEN 'category_phrase'
      WHEN regexp_matches(s, '^\\([^)]*\\)\\s*$') AND length(s) < 40 THEN 'only_parenthesis'
      WHEN regexp_matches(s, '[0-9][0-9]-') THEN 'event'
      ELSE 'plausible' END AS verdict
    FROM w
    """,
)
def name_plausible(spark, folder):
    return all_names(spark, folder).select(
        "name",
        F.coalesce(nm.reject_rule(F.col("name"), NAMES), F.lit("plausible")).alias("verdict"),
    )


@query(
    "name_evidence",
    """
    WITH l AS (SELECT page_id, trim(regexp_replace(unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)), '\\s+', ' ', 'g')) AS name,
                 lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))) AS title FROM pages),
    d AS (SELECT DISTINCT * FROM l)
    SELECT page_id, name, contains(title, lower(name)) OR len(list_filter(
        regexp_extract_all(lower(name), '([a-z0-9]+)', 1),
        lambda t: length(t) >= 3 AND contains(title, t))) > 0 AS evident
    FROM d
    """,
)
def name_evidence(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.explode(link_names("html")).alias("raw"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )
    named = pages.select("page_id", fold_spaces(F.col("raw")).alias("name"), "title").distinct()
    return named.select(
        "page_id", "name", nm.has_evidence(F.col("name"), F.col("title")).alias("evident")
    )


ALIASES = [
    ("North Harbour", "thea"), ("North Harbour", "eauou"), ("Hill", "lichkeit"), ("Old Market", "hand"),
    ("Green Valley", "ción"), ("Green Valley", "mente"), ("Far Station", "schaft"), ("Mill", "rewh"),
]
ALIAS_SQL = f"a(place, canonical, alias) AS (VALUES {values((i, c, a) for i, (c, a) in enumerate(ALIASES))})"


@query(
    "location_guess",
    f"""
    WITH {ALIAS_SQL},
    h AS (SELECT doc_id, canonical, min(place) AS place FROM documents JOIN a ON contains(text, alias) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(canonical) DESC, place) AS rn FROM h)
    SELECT d.doc_id, coalesce(r.canonical, '') AS location
    FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rn = 1
    """,
)
def location_guess(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", longest_alias(F.col("text"), ALIASES).alias("location")
    )


SHORT = [("nation", "nat."), ("segment", "seg"), ("nation", "natn"), ("customer", "customer")]


@query(
    "location_expand",
    """
    WITH l AS (SELECT c_custkey, 'nat. ' || c_nationkey || ' | seg ' || c_mktsegment || ' |  natn ' ||
                 c_nationkey || '| SEGMENT ' || c_mktsegment || ' | ' AS loc FROM customer)
    SELECT c_custkey, 'nation ' || regexp_extract(loc, '([0-9]+)', 1) || ' | segment ' ||
      regexp_extract(loc, 'seg ([A-Z]+)', 1) AS location FROM l
    """,
)
def location_expand(spark, folder):
    loc = F.concat(
        F.lit("nat. "), "c_nationkey", F.lit(" | seg "), "c_mktsegment", F.lit(" |  natn "),
        "c_nationkey", F.lit("| SEGMENT "), "c_mktsegment", F.lit(" | "),
    )
    return table(spark, folder, "customer").select(
        "c_custkey", vn.expand_place(loc, SHORT).alias("location")
    )


PLACES = vn.PlaceRules(
    aliases=[("Harbour", "ring"), ("Harbour Town", "plate"), ("Mill", "gear")],
    prefix="in ",
    settlement=(r"(?U)^(.{2,50}?)\s+at village\s+(.{2,80})$", "Village"),
)


@query(
    "name_place_split",
    """
    WITH s AS (SELECT p_partkey, CASE WHEN p_size < 30 THEN replace(p_name, ' ', ' in ')
        ELSE p_name || ' at village ' || p_type || ' - ' || p_brand END AS raw FROM part)
    SELECT p_partkey, CASE WHEN ends_with(raw, ' in ring') OR ends_with(raw, ' in plate') OR ends_with(raw, ' in gear')
        THEN split_part(raw, ' in ', 1) WHEN contains(raw, ' at village ') THEN split_part(raw, ' at village ', 1)
        ELSE raw END AS name,
      CASE WHEN ends_with(raw, ' in ring') THEN 'Harbour' WHEN ends_with(raw, ' in plate') THEN 'Harbour Town'
        WHEN ends_with(raw, ' in gear') THEN 'Mill'
        WHEN contains(raw, ' at village ') THEN 'Village ' || split_part(split_part(raw, ' at village ', 2), ' - ', 1)
        ELSE '' END AS location
    FROM s
    """,
)
def name_place_split(spark, folder):
    raw = F.when(F.col("p_size") < 30, F.replace("p_name", F.lit(" "), F.lit(" in "))).otherwise(
        F.concat("p_name", F.lit(" at village "), "p_type", F.lit(" - "), "p_brand")
    )
    return table(spark, folder, "part").select(
        "p_partkey", vn.split_place(raw, PLACES).alias("s")
    ).select("p_partkey", "s.name", "s.location")


VENUE_SQL = """
  v AS (SELECT p_partkey AS seq, 'p' || p_partkey AS id,
      CASE WHEN p_size < 15 THEN replace(p_name, ' ', ' – ') WHEN p_size < 25 THEN upper(p_name)
           WHEN p_size < 30 THEN p_name || ' (' || lower(p_type) || ')' ELSE p_name || ' ' || p_type END AS name,
      p_type AS restaurant_type,
      CASE WHEN p_size > 25 AND p_size < 28 THEN '' WHEN p_size > 40 THEN lower(p_brand) ELSE p_brand END AS location,
      'note ' || p_size AS note, 'more ' || p_type || ' ' || p_size AS extra_info
    FROM part),
  n AS (SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', ''), '[-–]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS mn,
      lower(trim(location)) AS lc FROM v),
  k AS (SELECT *, CASE WHEN starts_with(name, 'hot ') THEN 'hot' ELSE mn END AS key FROM n),
  f AS (SELECT key, count(DISTINCT mn) = 1 AS one, bool_or(lc = '') AS blank FROM k GROUP BY 1),
  p AS (SELECT k.*, CASE WHEN one OR blank THEN '' ELSE lc END AS part FROM k JOIN f USING (key))
"""


def _joined(column: str) -> str:
    return f"""(SELECT key, part, string_agg(v, ' | ' ORDER BY s) AS {column} FROM
      (SELECT key, part, {column} AS v, min(seq) AS s FROM p WHERE {column} <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(
    "venue_merge",
    f"""
    WITH {VENUE_SQL},
    g AS (SELECT key, part, count(*) AS n, min(seq) AS seq,
            arg_min(name, (CASE WHEN regexp_matches(name, '\\([^)]+\\)\\s*$') THEN 10 ELSE 0 END, length(name), name)) AS display
          FROM p GROUP BY 1, 2),
    j AS (SELECT g.*, restaurant_type, coalesce(location, '') AS location, note, extra_info FROM g
          JOIN {_joined("restaurant_type")} USING (key, part) LEFT JOIN {_joined("location")} USING (key, part)
          JOIN {_joined("note")} USING (key, part) JOIN {_joined("extra_info")} USING (key, part))
    SELECT j.seq, CASE WHEN n = 1 THEN v.id ELSE 'r-' || substr(sha256('merged:' || key || display || substr(j.location, 1, 40)), 1, 12) END AS id,
      CASE WHEN n = 1 THEN v.name ELSE display END AS name,
      CASE WHEN n = 1 THEN v.restaurant_type ELSE substr(j.restaurant_type, 1, 200) END AS restaurant_type,
      CASE WHEN n = 1 THEN v.location ELSE substr(j.location, 1, 250) END AS location,
      CASE WHEN n = 1 THEN v.note WHEN length(j.note) > 400 THEN substr(j.note, 1, 400) || '...' ELSE j.note END AS note,
      CASE WHEN n = 1 THEN v.extra_info WHEN length(j.extra_info) > 600 THEN substr(j.extra_info, 1, 600) || '...' ELSE j.extra_info END AS extra_info,
      n AS n_merged
    FROM j JOIN v USING (seq)
    """,
)
def venue_merge(spark, folder):
    rows = table(spark, folder, "part").selectExpr(
        "p_partkey AS seq",
        "concat('p', p_partkey) AS id",
        """CASE WHEN p_size < 15 THEN replace(p_name, ' ', ' – ') WHEN p_size < 25 THEN upper(p_name)
           WHEN p_size < 30 THEN p_name || ' (' || lower(p_type) || ')'
           ELSE p_name || ' ' || p_type END AS name""",
        "p_type AS restaurant_type",
        """CASE WHEN p_size > 25 AND p_size < 28 THEN '' WHEN p_size > 40 THEN lower(p_brand)
           ELSE p_brand END AS location""",
        "concat('note ', p_size) AS note",
        "concat('more ', p_type, ' ', p_size) AS extra_info",
    )
    return vn.merge_rows(rows, "seq", brands=[("^hot ", "hot")])


@query(
    "venue_type_clean",
    """
    SELECT p_partkey, CASE WHEN p_size < 20 THEN p_name ELSE p_name || ' / ' || lower(p_type) END AS kind FROM part
    """,
)
def venue_type_clean(spark, folder):
    raw = F.when(
        F.col("p_size") < 20, F.concat(F.lit("strictly "), "p_name", F.lit(" | strict, "))
    ).otherwise(F.concat("p_name", F.lit("  / strict "), F.lower("p_type")))
    kind = vn.clean_type(raw, [r"\s*strictly\s*", r"^\s*strict\s+|\s+strict\s*$", r"^strict,?$"])
    return table(spark, folder, "part").select("p_partkey", kind.alias("kind"))


def _venues(spark, folder):
    return table(spark, folder, "supplier").select(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 2000, "https://old.example.org").alias("website"),
    )


def _websites(spark, folder):
    c = table(spark, folder, "customer")
    shown = F.when(F.col("c_acctbal") > 3000, "Supplier").otherwise("Shop")
    return c.select(
        F.replace("c_name", F.lit("Customer"), shown).alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "")
        .otherwise(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.org")))
        .alias("website"),
    )


SITES_SQL = """
  site AS (SELECT replace(c_name, 'Customer', CASE WHEN c_acctbal > 3000 THEN 'Supplier' ELSE 'Shop' END)
             AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN ''
             ELSE 'https://' || lower(c_mktsegment) || '.example.org' END AS website
           FROM customer)
"""


@query(
    "website_enrich",
    f"""
    WITH {SITES_SQL}
    SELECT s_suppkey, s_name AS name, CASE WHEN site.name IS NOT NULL THEN site.website
      WHEN s_acctbal < 2000 THEN 'https://old.example.org' ELSE '' END AS website
    FROM supplier LEFT JOIN site ON site.name = s_name
    """,
)
def website_enrich(spark, folder):
    return vn.with_websites(_venues(spark, folder), _websites(spark, folder)).select(
        "s_suppkey", "name", "website"
    )


@query(
    "website_audit",
    f"""
    WITH {SITES_SQL}
    SELECT s_name AS name, 'unknown' AS finding FROM supplier WHERE s_name NOT IN (SELECT name FROM site)
    UNION ALL SELECT name, 'stale' FROM site WHERE name NOT IN (SELECT s_name FROM supplier)
    """,
)
def website_audit(spark, folder):
    return vn.website_audit(_venues(spark, folder), _websites(spark, folder))


LINKS_SQL = """
  l AS (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS name,
          regexp_extract(url, '//([^/]+)', 1) AS location,
          regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
  t AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '\\([^)]*\\)', ' ', 'g'),
            '[^\\p{L}\\p{N}_\\s-]', ' ', 'g')), '\\s+'),
          lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'or')) AS tokens FROM l)
"""


def _links(spark, folder):
    return table(spark, folder, "pages").select(
        F.explode(link_names("html")).alias("name"),
        F.regexp_extract("url", "//([^/]+)", 1).alias("location"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )


@query(
    "evidence_verdicts",
    f"""
    WITH {LINKS_SQL}
    SELECT trim(name) AS name, location,
      bool_or(len(tokens) = 0 OR len(list_filter(tokens, lambda x: contains(lower(title), x))) > 0) AS ok,
      count(*) AS hits
    FROM t GROUP BY 1, 2
    """,
)
def evidence_verdicts(spark, folder):
    links = _links(spark, folder)
    results = links.select(
        evidence_key(F.col("name"), F.col("location")).alias("key"),
        "title",
        F.lit("").alias("snippet"),
    )
    return ev.judge(links, results).select(F.trim("name").alias("name"), "location", "ok", "hits")


@query(
    "web_evidence",
    f"""
    WITH {LINKS_SQL},
    vocab AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(title, '\\([^)]*\\)', ' ', 'g'),
            '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g')), '\\s+')) AS token FROM l),
    d AS (SELECT DISTINCT name, list_filter(tokens, lambda x: length(x) >= 2) AS tokens FROM t)
    SELECT DISTINCT name FROM d WHERE len(tokens) = 0 OR EXISTS (
      SELECT 1 FROM vocab WHERE list_contains(d.tokens, token))
    """,
)
def web_evidence(spark, folder):
    links = _links(spark, folder)
    names = links.select("name").distinct()
    return ev.keep_mentioned(
        names.withColumn("id", F.col("name")), "id", "name", links, "title"
    ).select("name")


@query(
    "evidence_cache",
    """
    WITH v AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal < 2000 AS has_site FROM supplier),
    c AS (SELECT n_nationkey, n_regionkey > 1 AS ok FROM nation WHERE n_regionkey < 4)
    SELECT s_suppkey, has_site OR coalesce(ok, false) AS kept, NOT has_site AND ok IS NULL AS missing
    FROM v LEFT JOIN c ON s_nationkey = n_nationkey
    """,
)
def evidence_cache(spark, folder):
    nation = table(spark, folder, "nation")
    # Verdicts on nations of the last region are kept under places that no row has.
    kind = F.when(F.col("n_regionkey") < 4, "nation ").otherwise("country ")
    where = F.concat(kind, F.col("n_nationkey").cast("string"))
    cache = table(spark, folder, "supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    ).select(evidence_key(F.col("s_name"), where).alias("key"), (F.col("n_regionkey") > 1).alias("ok"))
    rows = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("location"),
        F.when(F.col("s_acctbal") < 2000, "HTTPS://site.example.org").alias("website"),
    )
    kept = ev.keep_evident(rows, cache).select("s_suppkey", F.lit(True).alias("_kept"))
    open_rows = ev.cache_misses(rows, cache).select("s_suppkey", F.lit(True).alias("_open"))
    return (
        rows.join(kept, "s_suppkey", "left")
        .join(open_rows, "s_suppkey", "left")
        .select(
            "s_suppkey",
            F.coalesce("_kept", F.lit(False)).alias("kept"),
            F.coalesce("_open", F.lit(False)).alias("missing"),
        )
    )


@query(
    "bulletin_items",
    """
    WITH d AS (SELECT doc_id, '>>> places:' || chr(10) || replace(replace(text, ' the ', ' - '), '. ', ', 050-1234567' || chr(10)) || chr(10) || '>>> end' AS body FROM documents),
    b AS (SELECT doc_id, string_split(regexp_extract(body, '(?s)>>> places:(.*?)>>> end', 1), chr(10)) AS lines FROM d),
    u AS (SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS item_no FROM b),
    l AS (SELECT doc_id, item_no, trim(raw) AS line FROM u),
    s AS (SELECT *, strpos(line, ' - ') AS spot FROM l WHERE line <> '' AND NOT starts_with(line, '>>>') AND contains(line, ' - ')),
    r AS (SELECT doc_id, item_no, trim(regexp_replace(trim(substr(line, 1, spot - 1), ' "''״'), '\\s+', ' ', 'g')) AS name,
            trim(regexp_replace(substr(line, spot + 3), '\\s+', ' ', 'g')) AS rest FROM s),
    p AS (SELECT *, regexp_extract(rest, '(0\\d{1,2}[-\\d\\s]{6,}|05\\d[-\\d\\s]{7,}|08-\\d{4}-\\d{3,})$', 1) AS phone FROM r),
    c AS (SELECT *, CASE WHEN phone <> '' THEN trim(regexp_replace(trim(substr(rest, 1, length(rest) - length(phone))), ',+$', ''))
            ELSE rest END AS body FROM p),
    q AS (SELECT *, list_filter(list_transform(string_split(body, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
    i AS (SELECT doc_id, CAST(item_no AS INTEGER) AS item_no, name, CASE WHEN len(parts) >= 1 THEN parts[1] ELSE body END AS kind,
            array_to_string(parts[2:], ', ') AS location, trim(phone) AS phone FROM q)
    SELECT doc_id, item_no, 'r-' || substr(sha256('bulletin:' || name || location), 1, 12) AS id,
      substr(name, 1, 120) AS name, substr(kind, 1, 150) AS restaurant_type, substr(location, 1, 200) AS location, phone
    FROM i WHERE contains(name || ' ' || kind || ' ' || location, 'tion') OR contains(name || ' ' || kind || ' ' || location, 'heed')
    """,
)
def bulletin_items(spark, folder):
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" - ")), F.lit(". "), F.lit(", 050-1234567\n"))
    docs = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit(">>> places:\n"), text, F.lit("\n>>> end")).alias("body")
    )
    return read_bulletin(docs, "doc_id", "body", ">>> places:", ">>> end", ("tion", "heed"))


@query(
    "seed_union_year",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN CAST(year(o_orderdate) AS INTEGER)
        WHEN 'O' THEN CAST(year(o_orderdate) AS INTEGER) END AS source_year
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR year(o_orderdate) >= 1997
    """,
)
def seed_union_year(spark, folder):
    o = table(spark, folder, "orders")
    line = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "'chat · 'd/M/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "'list 13/2040 · 'MM/yyyy"))
        .otherwise(F.concat(F.lit("no date "), F.substring("o_orderpriority", 1, 1)))
    )
    sources = [
        o.filter(condition).select("o_orderkey", line.alias("note"))
        for condition in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")
    ]
    seed = vn.union_sources(sources)
    return seed_since(seed, "note", 1997).select("o_orderkey", "source_year")
