"""Chat, cards, archives, bulletins, catalogues."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from tipweave.functions.text import year_in_text
from tipweave.sinks.cards import card_text
from tipweave.sinks.catalogue import compact, read_current, versions, write_version
from tipweave.sources import cards as ca
from tipweave.sources import chat as ch
from tipweave.sources.bulletin import bulletin_items
from tipweave.sources.catalogue import ENTRY_SCHEMA, VENUE_SCHEMA, read_json, with_venue_ids

CHAT = """lines before any header
01/02/2021, 9:05 - Sender A: first line
  continuation line

‏not a header 01/02/2021, 9:06 - x: y
02/02/2021, 10:00 - ‎Sender B‏: Contact One.vcf (file attached)
02/02/2021, 10:01 - Sender C: <Media omitted>
02/02/2021, 10:02 - Sender D created group "x"
31/12/2022, 23:59 - Sender A:
1/1/2023, 0:00 - Sender A: see 5/5/2020, 1:00 - no: it is in the body
"""


def _write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_compact_messages(spark, folder):
    _write(folder, "a.txt", CHAT)
    rows = ch.read_chat(spark, folder).orderBy("msg_seq").collect()
    assert [r.msg_seq for r in rows] == list(range(4))
    assert rows[0].body == (
        "first line\ncontinuation line\n‏not a header 01/02/2021, 9:06 - x: y"
    )
    assert rows[0].date_str == "01/02/2021 9:05"
    assert rows[2].body == '<Media omitted>\n02/02/2021, 10:02 - Sender D created group "x"'
    assert rows[3].body.startswith("see 5/5/2020") and rows[3].ts.year == 2023


def test_raw_messages_keep_empty_bodies(spark, folder):
    _write(folder, "a.txt", CHAT)
    rows = ch.read_chat(spark, folder, compact=False).orderBy("msg_seq").collect()
    assert [r.sender for r in rows] == ["Sender A", "Sender B", "Sender C", "Sender A", "Sender A"]
    assert rows[0].body.startswith("first line\n  continuation line\n\n")
    assert rows[3].body == "" and rows[3].date_str == "31/12/2022, 23:59"


def test_preamble_can_be_kept(spark, folder):
    _write(folder, "a.txt", CHAT)
    first = ch.read_chat(spark, folder, keep_preamble=True).orderBy("msg_seq").first()
    assert first.body == "lines before any header" and first.sender is None


def test_stitching_does_not_depend_on_splits(spark, folder):
    lines = []
    for i in range(600):
        lines.append(f"{i % 28 + 1}/3/2021, 8:{i % 60:02d} - S{i % 7}: message {i} " + "x" * (i % 50))
        lines += [f"more {j} of {i}" for j in range(i % 4)]
    _write(folder, "big.txt", "\n".join(lines))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    results = []
    try:
        for size in ("128m", "700b", "4k"):
            spark.conf.set(key, size)
            frame = ch.read_chat(spark, folder)
            results.append([tuple(r) for r in frame.select("msg_seq", "sender", "body").orderBy("msg_seq").collect()])
        spark.conf.set(key, "700b")
        assert spark.read.text(folder).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set(key, before)
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 600 and results[0][3][2].endswith("more 0 of 3\nmore 1 of 3\nmore 2 of 3")


CARD = """BEGIN:VCARD
VERSION:3.0
N:;Contact One;;;
FN:1. Contact One
ORG:Example Org;
TITLE:Plumber
item1.TEL;waid=972500000001:+972 50-000-0001
item1.X-ABLabel:Mobile
PHOTO;ENCODING=b:AAAA
END:VCARD
"""


def _contacts(spark, folder, files):
    for name, text in files.items():
        _write(folder, name, text)
    return {
        r.name: r for r in ca.contacts(ca.parse_cards(ca.read_cards(spark, folder))).collect()
    }


def test_card_fields(spark, folder):
    got = _contacts(spark, folder, {"One #1.vcf": CARD})
    r = got["Contact One"]
    assert (r.phone, r.org, r.title_vcf) == ("0500000001", "Example Org;", "Plumber")
    assert (r.file_key, r.stem_key, r.vcf_filename) == ("one #1.vcf", "one #1", "One #1.vcf")


def test_card_cases(spark, folder):
    two = CARD.replace("1. Contact One", "Second") + CARD.replace("1. Contact One", "\U0001f600 Third")
    got = _contacts(
        spark,
        folder,
        {
            "no_fn.vcf": "BEGIN:VCARD\nN:Family;Given;Middle;;\nTEL:03-1234567 8\nEND:VCARD",
            "no_phone.vcf": "BEGIN:VCARD\nFN:Nobody\nEND:VCARD",
            "7 stem only.vcf": "BEGIN:VCARD\nTEL:050-0000009\nTEL:050-1111111\nEND:VCARD",
            "two.VCF": two,
        },
    )
    assert set(got) == {"Middle Given", "stem only", "Second", "Third"}
    assert got["stem only"].phone == "0500000009"


def test_later_file_wins_a_key(spark, folder):
    _write(folder, "A.vcf", CARD)
    _write(folder, "a.vcf", CARD.replace("1. Contact One", "Later"))
    found = ca.lookup(ca.contacts(ca.parse_cards(ca.read_cards(spark, folder))))
    assert {r.key: r.contact.name for r in found.collect()} == {"a.vcf": "Later", "a": "Later"}


def test_archive_members(spark, folder):
    with zipfile.ZipFile(f"{folder}/export.zip", "w") as z:
        z.writestr("chat.txt", CHAT)
        z.writestr("other.txt", "1/1/2020, 1:00 - Z: not the chat")
        z.writestr("One.vcf", CARD)
    members = ch.read_archives(spark, folder)
    messages = ch.stitch(ch.archive_lines(members))
    assert messages.count() == 4 and messages.filter("sender = 'Z'").count() == 0
    names = [r.name for r in ca.contacts(ca.parse_cards(ca.archive_cards(members))).collect()]
    assert names == ["Contact One"]


def test_card_text_limits_and_escapes(spark):
    df = spark.createDataFrame(
        [("a;b,c\\", ["x", "03-5555555", "+972501111111", "0502222222"], "", "l1\r\nl2"), (" ", ["x"], "", "")],
        "name string, phones array<string>, field string, extra string",
    )
    rows = df.select(card_text(*[F.col(c) for c in df.columns]).alias("t")).collect()
    assert rows[0].t.split("\r\n")[2:9] == [
        "FN:a\\;b\\,c\\\\",
        "N:;a\\;b\\,c\\\\;;;",
        "TEL;TYPE=VOICE:+03-5555555".replace("-", ""),
        "TEL;TYPE=CELL,PREF:+972501111111",
        "TEL;TYPE=CELL:+0502222222",
        "X-EXTRA-INFO:l1\\nl2",
        "END:VCARD",
    ]
    assert rows[1].t is None


def test_bulletin_items(spark):
    text = (
        "intro\n>>> food:\n>>> sub\n\"The Oven\" – bakery, Old Street, North, 050-1234567\n"
        "Plain line\nFish - grill\nTools - hammers\n>>> end\nBakery - outside"
    )
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    rows = bulletin_items(df, "id", "text", ">>> food:", ">>> end", ("bakery", "grill")).collect()
    got = sorted((r.name, r.restaurant_type, r.location, r.phone) for r in rows)
    assert got == [("Fish", "grill", "", ""), ("The Oven", "bakery", "Old Street, North", "050-1234567")]


@pytest.mark.parametrize(
    "line, year",
    [("on 3/4/2021", 2021), ("13/2020 and 07/2018", 2018), ("in 2019!", 2019), ("id 12019", None), ("", None)],
)
def test_year_in_text(spark, line, year):
    df = spark.createDataFrame([(line,)], "t string")
    assert df.select(year_in_text(F.col("t"))).first()[0] == year


def test_json_catalogue_guards(spark, folder):
    assert read_json(spark, f"{folder}/missing.json", ENTRY_SCHEMA).count() == 0
    _write(folder, "v.json", '[{"name": "A", "location": "X"}, {"id": " ", "name": "A", "location": "X"}, 7]')
    rows = with_venue_ids(read_json(spark, f"{folder}/v.json", VENUE_SCHEMA)).collect()
    named = [r for r in rows if r.name]
    assert len(named) == 2 and named[0].id == named[1].id and named[0].id.startswith("r-")


def test_versions_and_compaction(spark, folder):
    root = f"{folder}/cat"
    df = spark.createDataFrame(
        [(1, 0, "A", "050", "050 shown", ["050", "051"], "f", True, " n ", "e", None)],
        "seq long, src_rank int, name string, phone string, phone_display string, phones array<string>,"
        "field string, from_local boolean, note string, extra_info string, recommender string",
    )
    write_version(df, root)
    compact(read_current(spark, root), root)
    row = read_current(spark, root).first()
    assert len(versions(spark, root)) == 2
    assert (row.phone, row.phones, row.note, row.recommender) == ("050 shown", ["050", "051"], "n", "")
