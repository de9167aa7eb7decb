"""Whole jobs, the Hebrew rules, and the streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tipweave.operators import category as cat
from tipweave.operators import messages as msg
from tipweave.operators import mining
from tipweave.operators import names as nm
from tipweave.operators import overlay as ov
from tipweave.operators import search as se
from tipweave.operators import venues as vn
from tipweave.operators import verdicts as vd
from tipweave.operators import votes as vt
from tipweave.operators.dictionary import Rule, first_label
from tipweave.plans.contacts import ContactRules, build_contacts, merge_contacts
from tipweave.plans.serving import served_contacts, served_venues
from tipweave.plans.venues import build_venues
from tipweave.rules import hebrew
from tipweave.rules.loaders import aliases, extended, keyword_rules, norm_rules, phrase_sets
from tipweave.sinks.catalogue import write_json
from tipweave.sources.cards import contacts, parse_cards, read_cards
from tipweave.sources.chat import read_chat
from tipweave.sources.catalogue import complete_numbers
from tipweave.streaming.changes import current_catalogue, start_changes
from tipweave.streaming.messages import stream_mentions, stream_venues
from tipweave.streaming import votes as votes_stream
from tipweave.streaming.votes import current_counters, start_counters

KEYWORDS = [
    Rule(1, "חשמלאי", "חשמל"), Rule(2, "אינסטלטור", "אינסטלציה"), Rule(3, "שעון", "שענות"),
    Rule(4, "נגר", "נגרות", hebrew.KEYWORD_GUARDS["נגר"]),
]

CHAT = """1/2/2021, 9:00 - רות: מישהו מכיר חשמלאי טוב?
1/2/2021, 9:05 - דנה: One.vcf (file attached)
1/2/2021, 9:06 - דנה: ממליצה בחום
1/2/2021, 9:07 - נועה: Two.vcf (file attached)
2/2/2021, 9:00 - א: שלום
2/2/2021, 9:01 - א: בוקר
2/2/2021, 9:02 - א: אור
2/2/2021, 9:03 - א: יום
2/2/2021, 9:04 - א: טוב
2/2/2021, 9:05 - ב: Three.vcf (file attached)
2/2/2021, 9:06 - א: תודה
2/2/2021, 9:07 - א: רבה
2/2/2021, 9:08 - א: מאוד
3/2/2021, 9:00 - רות: מחפשת אינסטלטור במושב
3/2/2021, 9:01 - דנה: One.vcf (file attached)
3/2/2021, 9:02 - דנה: Unknown.vcf (file attached)
3/2/2021, 9:03 - דנה: Foreign.vcf (file attached)
"""


def card(name, phone, title=""):
    return f"BEGIN:VCARD\nFN:{name}\nTEL:{phone}\nTITLE:{title}\nEND:VCARD\n"


def contact_inputs(spark, folder):
    with open(f"{folder}/chat.txt", "w") as f:
        f.write(CHAT)
    for name, text in {
        "One": card("1. אבי", "050-0000001"),
        "Two": card("רון נגר", "050-0000002"),
        "Three": card("לא ברור", "050-0000003"),
        "Foreign": card("Far", "+1 202 555 0100"),
    }.items():
        with open(f"{folder}/{name}.vcf", "w") as f:
            f.write(text)
    return read_chat(spark, folder), contacts(parse_cards(read_cards(spark, folder)))


def test_contacts_from_chat_and_cards(spark, folder):
    messages, cards = contact_inputs(spark, folder)
    rules = ContactRules(
        hebrew.REQUEST_MARKERS, hebrew.LOCAL_MARKERS, KEYWORDS, hebrew.GUARDS, hebrew.SUB_LABELS,
        hebrew.MESSAGES.strong,
    )
    entries, parts = build_contacts(messages, cards, rules)
    got = {r.phone: r for r in entries.collect()}
    assert set(got) == {"0500000001", "0500000002"}
    one = got["0500000001"]
    # the first note asks for an electrician; folding adds the plumber, the vote is a tie and the
    # earlier rule wins
    assert one.name == "אבי" and one.field == "חשמל"
    assert one.note == "מישהו מכיר חשמלאי טוב? | מחפשת אינסטלטור במושב"
    assert one.from_local is False
    assert got["0500000002"].field == "נגרות"
    assert sorted(r.note for r in parts.collect()) == sorted(r.note for r in got.values())
    merged, _, _ = merge_contacts(entries)
    assert sorted(r.phone for r in merged.collect()) == ["0500000001", "0500000002"]
    everything, _ = build_contacts(
        messages, cards, rules,
        verdicts=spark.createDataFrame(
            [], "mention_id string, include boolean, field string, reason string, error string"
        ),
    )
    assert everything.count() == 0


VENUE_CHAT = """1/2/2021, 9:00 - רות: ממליצה בחום על מסעדת הגפן בתל אביב, אוכל מצוין
2/2/2021, 9:00 - דנה: היינו אתמול בבית קפה הדקל ברעננה. מומלץ מאוד
3/2/2021, 9:00 - נועה: מחפשת המלצות למסעדת דגים באזור
4/2/2021, 9:00 - גיל: המליצו לי על מסעדת הגפן, מומלצת!
5/2/2021, 9:00 - גיל: איפה יש מסעדה טובה?
6/2/2019, 9:00 - גיל: מומלץ מסעדת הישן בחיפה
7/2/2021, 9:00 - גיל: ביקשו להפיץ מסעדת הגדול
"""


def test_venues_from_chat(spark, folder):
    with open(f"{folder}/chat.txt", "w") as f:
        f.write(VENUE_CHAT)
    messages = read_chat(spark, folder, compact=False)
    rows = vn.strict_rows(messages, hebrew.VENUES).select("name", "location", "restaurant_type").collect()
    assert ("הגפן", "תל אביב", "") in [tuple(r) for r in rows]
    assert ("הדקל", "רעננה", "בית קפה") in [tuple(r) for r in rows]
    websites = spark.createDataFrame([("הגפן", "https://g.example.org")], "name string, website string")
    seed = spark.createDataFrame(
        [("s1", "הזית", "ים תיכוני לא כשר", 'כפ"ס', "רשימה 07/2018", "x"), ("s2", "האלון", "", "", "ללא", "y")],
        "id string, name string, restaurant_type string, location string, note string, extra_info string",
    )
    built = build_venues(messages, hebrew.VENUES, min_year=2020, seed=seed, websites=websites).collect()
    got = {r.name: r for r in built}
    assert set(got) == {"הגפן", "הדקל", "האלון"}
    assert got["הגפן"].location == "תל אביב" and got["הגפן"].website == "https://g.example.org"
    assert got["הגפן"].n_merged == 2 and got["הגפן"].note.count("|") == 1
    every = {r.name: r for r in build_venues(messages, hebrew.VENUES, seed=seed).collect()}
    assert set(every) == {"הגפן", "הדקל", "האלון", "הזית", "הישן"}
    assert every["הזית"].location == "כפר סבא" and every["הזית"].restaurant_type == "ים תיכוני"
    names = [r.name for r in build_venues(messages, hebrew.VENUES, seed=seed).collect()]
    assert names == sorted(names)


def _check(spark, fn, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_message_rules(spark):
    r = hebrew.MESSAGES
    texts = [
        "אשמח לקפה טוב", "יש פה התקפה חזקה", "מכונת קפה חדשה", "קפה עם חלב", "קפה הדקל פתוח",
        "בבית קפה בתקופות האלה", "בבית קפה הדקל", "מסעדת הגפן",
    ]
    assert _check(spark, lambda c: msg.names_venue(c, r), texts) == [
        True, False, False, False, True, False, True, True,
    ]
    reasons = _check(
        spark,
        lambda c: msg.reject_reason(c, r),
        [
            "מחפשת מסעדה טובה", "תודה מראש \U0001f64f\U0001f3fd\u200d\u2640\ufe0f", "מסעדת הגפן? איך היא",
            "איפה המסעדות הטובות?", "מסעדת דגים באזור? תודה", "בית הקפה פתוח בשבת? כן",
            "מסעדת הגפן פתוחה?", "אינסטלטור מומלץ", "מומלץ בחום מסעדת הגפן",
        ],
    )
    assert reasons == [
        "request", "request", "opinion", "where", "area", "opening", "question", "excluded", None,
    ]


def test_name_rules(spark):
    r = hebrew.NAMES
    names = [
        "הגפן", "תל אביב", "ברעננה", "איטלקית ברעננה", "על הדרך", "מעל שבועיים", "א",
        "טובה בחיפה", "דגים טובה מאוד", "*הדקל*", "לאירוע גדול", "הגפן?",
    ]
    got = _check(spark, lambda c: nm.reject_rule(c, r), names)
    assert [g is None for g in got] == [
        True, False, False, False, False, False, False, False, False, True, False, False,
    ]
    cleaned = _check(
        spark,
        lambda c: nm.clean_name(c, r, hebrew.VENUES.scrub),
        ["*הגפן* ", "הגפן - מעולה!", "הדקל https://x.example", "הדקל 050-1234567", "ינואר 2020", "דגי abc הים"],
    )
    assert cleaned == ["הגפן", "הגפן", "הדקל", "הדקל", None, "דגי הים"]


def test_patterns_hide_what_a_lead_took(spark):
    text = "הגפן - מסעדת דגים מעולה, וגם קפה הדקל"
    found = _check(spark, lambda c: vn.extract_names(c, hebrew.PATTERNS, hebrew.NAMES), [text])[0]
    assert found[0] == "הגפן" and "דגים מעולה" not in found and "הדקל" in found


def test_category_tables(spark):
    label = _check(spark, lambda c: first_label(c, KEYWORDS), ["רון זינגר", "הנגר רון", "נגר", "בנגר"])
    assert label == ["", "נגרות", "נגרות", ""]
    df = spark.createDataFrame(
        [
            ("שחר ספר", "", ""), ("דר כהן", "", ""), ("בשר טרי", "", ""), ("בשרון", "", ""),
            ("רון", "מורה נהיגה", ""), ("חשמלאי רכב", "", ""), ("משקפיים וחשמלאי", "x", ""),
        ],
        "name string, field string, note string",
    )
    got = [r.field for r in cat.normalise(df, hebrew.CATEGORY_RULES, KEYWORDS).collect()]
    assert got == ["מספרה", "רפואה", "אטליז", "", "נהיגה", "חשמל רכב", "חשמל"]
    sub = spark.createDataFrame(
        [
            ("ד", "קרדיולוג", "רפואה"), ("מורה", "רואה חשבון", "מורים פרטיים"),
            ("", "Cbt", "פסיכולוגיה"), ("לילדים", "", "מספרה"), ("x", "גיזום של עצים", "גינון וגיזום"),
        ],
        "name string, note string, field string",
    )
    labels = sub.select(cat.sub_label(*[F.col(c) for c in sub.columns], hebrew.SUB_LABELS)).collect()
    assert [r[0] for r in labels] == ["קרדיולוגיה", "", "CBT", "ילדים", "גיזום עצים"]
    mined = spark.createDataFrame([("מורה", "לשון", ""), ("x", "דוד שמש", "")], "name string, note string, field string")
    counts = {r.phrase: r.n for r in mining.phrase_counts(mined, hebrew.MINING_COUNTERS).collect()}
    assert counts == {"מורה ללשון / לשון": 1, "דודים": 1}


def test_rule_tables_can_be_loaded(spark):
    sets = spark.createDataFrame([("strong", "wow"), ("request", "pls")], "set_name string, phrase string")
    rules = extended(msg.MessageRules(strong=("top",)), phrase_sets(sets))
    assert rules.strong == ("top", "wow") and rules.request == ("pls",)
    table = spark.createDataFrame([(2, "נגר", "n"), (1, "b", "x")], "priority int, keyword string, label string")
    loaded = keyword_rules(table, hebrew.KEYWORD_GUARDS)
    assert [r.keyword for r in loaded] == ["b", "נגר"] and loaded[1].guard
    pairs = aliases(spark.createDataFrame([("C", "c")], "canonical string, alias string"))
    assert pairs == [("C", "c")]
    norm = spark.createDataFrame(
        [(1, "t", ["field"], ["a"], None)],
        "rule_id int, target string, scope array<string>, include array<string>, exclude array<string>",
    )
    assert norm_rules(norm)[0].target == "t"


def test_judged_venues_and_fallback(spark):
    body = "ממליצה בחום על מסעדת הגפן בתל אביב"
    judged = spark.createDataFrame(
        [
            ("c", 0, body, "s", "d", False, '{"venues": [{"name": "הגפן"}, {"name": "קפה"}, {"name": "汉字"}]}'),
            ("c", 1, body, "s", "d", True, '{"venues": [{"name": "אחר לגמרי"}, {"name": "הגפן", "location": "L"}]}'),
        ],
        "chat_id string, msg_seq long, body string, sender string, date_str string, is_loose boolean, answer string",
    )
    rows = vd.verified_rows(judged, hebrew.VENUES, "label").collect()
    assert sorted((r.msg_seq, r.name, r.location) for r in rows) == [(0, "הגפן", "תל אביב"), (1, "הגפן", "L")]
    strict = spark.createDataFrame([("c", 2, 0, "rule")], "chat_id string, msg_seq long, name_no int, name string")
    answers = spark.createDataFrame([("c", 2, "timeout"), ("c", 0, None)], "chat_id string, msg_seq long, error string")
    out = vd.rows_with_fallback(vd.verified_rows(judged, hebrew.VENUES, "label"), strict, answers)
    assert sorted(r.name for r in out.collect()) == ["rule", "הגפן", "הגפן"]


EVENT = "event_id long, ts timestamp, item_type string, item_key string, seq long, prev string, next string"


def test_vote_stream_equals_batch(spark, folder, monkeypatch):
    monkeypatch.setattr(votes_stream, "SNAPSHOT_EVERY", 2)
    rows = [(i, "entry", f"k{i % 3}", i, ["none", "like", "dislike"][i % 3], ["like", "dislike", "none"][i // 2 % 3]) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, item_type string, item_key string, seq long, prev string, next string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000)
    )
    for start in (0, 15, 30):
        part = events.filter(f"seq >= {start} AND seq < {start + 15}")
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    # a repeated delivery of old events
    events.filter("seq < 5").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = start_counters(stream, f"{folder}/state", f"{folder}/log", dedupe_delay="1 hour")
    run.awaitTermination()
    empty = spark.createDataFrame([], "item_type string, item_key string, likes long, dislikes long")
    want = {r.item_key: (r.likes, r.dislikes) for r in vt.apply_votes(events, empty).collect()}
    got = {r.item_key: (r.likes, r.dislikes) for r in current_counters(spark, f"{folder}/state").collect()}
    assert got == want


def test_change_stream_writes_versions(spark, folder):
    base = spark.createDataFrame(
        [(0, "A", "051", None, "f", False, "n", ""), (1, "B", "052", None, "f", False, "n", "")],
        "seq long, name string, phone string, phones array<string>, field string, from_local boolean, note string, extra_info string",
    )
    for i, change in enumerate([("051", 1, "edit", "field", "g", None), ("052", 2, "delete", None, None, None)]):
        spark.createDataFrame([change], ov.CHANGE_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/log")
    stream = spark.readStream.schema(ov.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/log")
    start_changes(stream, f"{folder}/cat", f"{folder}/cp").awaitTermination()
    rows = current_catalogue(spark, f"{folder}/cat", base).collect()
    assert [(r.name, r.field, r.phone) for r in rows] == [("A", "g", "051")]


@pytest.mark.parametrize("size", [1, 2, 4, 9])
def test_change_stream_does_not_depend_on_the_cut(spark, folder, size):
    base = spark.createDataFrame(
        [(i, f"N{i}", f"05{i}", None, "f", False, "n", "") for i in range(4)],
        "seq long, name string, phone string, phones array<string>, field string, from_local boolean, note string, extra_info string",
    )
    log = [
        ("050", 1, "edit", "phone", "0599", None), ("050", 2, "edit", "field", "g", None),
        ("051", 3, "note", None, "of the overlay", None), ("051", 4, "edit", "note", "edited", None),
        ("052", 6, "edit", "name", "newer", None), ("052", 5, "edit", "name", "older", None),
        ("053", 7, "delete", None, None, None), ("053", 8, "edit", "name", "gone", None),
        ("050", 9, "flag", None, "true", None),
    ]
    for i in range(0, len(log), size):
        spark.createDataFrame(log[i : i + size], ov.CHANGE_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/log")
    stream = spark.readStream.schema(ov.CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/log")
    start_changes(stream, f"{folder}/cat", f"{folder}/cp").awaitTermination()
    got = sorted((r.name, r.phone, r.field, r.from_local, r.note) for r in current_catalogue(spark, f"{folder}/cat", base).collect())
    assert got == [("N0", "0599", "g", True, "n"), ("N1", "051", "f", False, "of the overlay"), ("newer", "052", "f", False, "n")]
    assert len(complete_numbers(spark, f"{folder}/cat", "batch")) <= 2


def test_message_stream(spark, folder):
    messages = spark.createDataFrame(
        [
            ("c", 0, "s", "1/2/2021, 9:00", "One.vcf (file attached)", "2021-02-01"),
            ("c", 1, "s", "1/2/2021, 9:01", "ממליצה בחום על מסעדת הגפן בתל אביב", "2021-02-01"),
            ("c", 2, "s", "1/2/2019, 9:01", "ממליצה בחום על מסעדת הישן בתל אביב", "2019-02-01"),
        ],
        "chat_id string, msg_seq long, sender string, date_str string, body string, day string",
    ).withColumn("ts", F.to_timestamp("day"))
    write_json(messages, f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).json(f"{folder}/in")
    for name, df in {
        "mentions": stream_mentions(stream, 2020),
        "venues": stream_venues(stream, hebrew.VENUES, 2020),
    }.items():
        query = (
            df.writeStream.format("parquet").option("path", f"{folder}/{name}")
            .option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert [r.vcf_name for r in spark.read.parquet(f"{folder}/mentions").collect()] == ["One.vcf"]
    assert [r.name for r in spark.read.parquet(f"{folder}/venues").collect()] == ["הגפן"]


def test_served_catalogue(spark):
    schema = "seq long, name string, phone string, phones array<string>, field string, from_local boolean, note string, extra_info string"
    base = spark.createDataFrame([(0, "A", "051", None, "f", False, "n", "")], schema)
    log = spark.createDataFrame([("051", 1, "edit", "phone", "059", None)], ov.CHANGE_SCHEMA)
    votes = spark.createDataFrame(
        [("entry", "059", 3, -1), ("entry", "051", 9, 9), ("venue", "v1", 2, 0)],
        "item_type string, item_key string, likes long, dislikes long",
    )
    row = served_contacts(base, base.limit(0), log, votes).first()
    assert (row.likes, row.dislikes) == (3, 0) and "note" not in row.asDict()
    venues = spark.createDataFrame([("v1", "V", 1)], "id string, name string, _internal int")
    shown = served_venues(venues, votes).first().asDict()
    assert shown["likes"] == 2 and "_internal" not in shown


def test_facets_in_order(spark):
    values = spark.createDataFrame([("ב",), ("א",), ("b",), ("A",)], "value string")
    assert [r.value for r in se.facet_order(values).collect()] == ["A", "b", "א", "ב"]
    assert [r.value for r in se.facet_order(values, "he").collect()] == ["א", "ב", "A", "b"]
