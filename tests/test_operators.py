"""Operators against simple loops on small inputs, with group splitting forced."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tipweave.functions import phone as ph
from tipweave.functions import text as tx
from tipweave.functions.phrases import alternation, contains_any
from tipweave.operators import category as cat
from tipweave.operators import dictionary as di
from tipweave.operators import duplicates as dup
from tipweave.operators import mentions as m
from tipweave.operators import notes
from tipweave.operators import overlay as ov
from tipweave.operators import sequence as sq
from tipweave.operators import votes as vt
from tipweave.operators.components import connected_components
from tipweave.operators.notes import fold_notes, note_heads, note_texts
from tipweave.operators.verdicts import read_venues, read_verdict
from tipweave.runtime import durable


def test_phone_forms(spark):
    raw = [
        "050-000-0001", "+972 50 000 0001", "500000001", "03-0000001", "072-0000001",
        "+1 202 555 0100", "1800", "", None,
    ]
    df = spark.createDataFrame([(r,) for r in raw], "p string")
    p = F.col("p")
    rows = df.select(ph.national(p), ph.last10(p), ph.international(p), ph.is_valid(p), ph.is_mobile(p)).collect()
    assert [r[0] for r in rows] == [
        "0500000001", "0500000001", "0500000001", "030000001", "0720000001", "12025550100", "1800", "", "",
    ]
    assert [r[3] for r in rows] == [True, True, True, True, True, False, False, False, False]
    assert [r[4] for r in rows] == [True, True, True, False, False, False, False, False, False]
    assert rows[0][2] == "+0500000001" and rows[1][2] == "+972500000001"


def test_phrase_sets(spark):
    words = [f"w{i}x" for i in range(40)] + ["a.b", "(c", "w1xy"]
    texts = ["zz w39x", "a.b", "aXb", "(c)", "w4", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(contains_any(F.col("t"), words)).collect()]
    assert got == [any(w in t for w in words) for t in texts]
    assert "w1xy" not in alternation(["w1x", "w1xy"])


def test_text_folding(spark):
    df = spark.createDataFrame(
        [("  12. \U0001f600 Dan  Co‏", "A-B (c)\t'd'")], "a string, b string"
    )
    row = df.select(tx.name_from_first_letter(F.col("a")), tx.fold_spaces(F.col("a")), tx.fold_name(F.col("b"))).first()
    assert row[0].startswith("Dan") and row[1] == "12. \U0001f600 Dan Co" and row[2] == "a b c d"


def _rows(n, hot):
    rng = random.Random(3)
    keys = ["hot" if rng.random() < hot else f"k{rng.randrange(4)}" for _ in range(n)]
    return [(k, i * 3 + 1, f"t{i}") for i, k in enumerate(keys)]


def test_renumber_is_dense(spark):
    df = spark.createDataFrame(_rows(300, 0.5), "k string, s long, t string")
    got = sq.renumber(df, ["k"], "s", "n", width=32).orderBy("k", "s").collect()
    seen: dict[str, int] = {}
    for r in got:
        assert r.n == seen.get(r.k, 0)
        seen[r.k] = r.n + 1


def test_frames_and_neighbours_equal_whole_windows(spark):
    df = spark.createDataFrame(_rows(300, 0.6), "k string, s long, t string")
    dense = sq.renumber(df, ["k"], "s", "n", width=16)
    rows = [(r.k, r.n, r.t) for r in dense.collect()]
    by_key: dict[str, list] = {}
    for k, n, t in sorted(rows):
        by_key.setdefault(k, []).append(t)
    framed = sq.with_frames(
        dense, ["k"], "n",
        {
            "before": (-5, -1, lambda w: F.collect_list("t").over(w)),
            "after": (1, 3, lambda w: F.collect_list("t").over(w)),
        },
        width=8,
    ).collect()
    assert len(framed) == 300
    for r in framed:
        assert r.before == by_key[r.k][max(0, r.n - 5) : r.n]
        assert r.after == by_key[r.k][r.n + 1 : r.n + 4]
    wanted = dense.filter("t LIKE '%7'").withColumn("id", F.col("t"))
    near = sq.around(dense, wanted, ["k"], "n", "id", F.col("t"), 5, 3).collect()
    assert near
    for r in near:
        assert r.ctx_before == by_key[r.k][max(0, r.n - 5) : r.n]
        assert r.ctx_after == by_key[r.k][r.n + 1 : r.n + 4]


def test_mentions_in_messages(spark):
    body = "see A b.vcf (file attached) and ‎C.VCF (file attached)\nD.vcf\n(file attached) E.vcf"
    df = spark.createDataFrame([("c", 0, "s", body), ("c", 1, "s", "none.vcf")], "chat_id string, msg_seq long, sender string, body string")
    got = m.find_mentions(df).orderBy("pos").collect()
    assert [r.vcf_name for r in got] == ["see A b.vcf", "and ‎C.VCF".replace("‎", ""), "D.vcf"]
    assert got[2].mention_id == "c#0#2"


def _fold(base, notes):
    text = base
    for n in notes:
        if n and n not in text:
            text += " | " + n
    return text


@pytest.mark.parametrize("max_notes", [0, 3, 512])
def test_note_fold_equals_loop(spark, max_notes):
    rng = random.Random(5)
    words = ["a", "ab", "plumber", "best plumber in town", "town", "of", "good one", "one", "né", "best plumber"]
    base, later = [], []
    for k in range(6):
        base.append((f"k{k}", "c", 0, 0, rng.choice([*words, ""])))
        for s in range(1, 40 if k == 0 else 8):
            later.append((f"k{k}", "c", s, 0, " ".join(rng.sample(words, rng.randrange(0, 3)))))
    schema = "k string, chat_id string, msg_seq long, pos int, note string"
    b, l = spark.createDataFrame(base, schema), spark.createDataFrame(later, schema)
    order = ["chat_id", "msg_seq", "pos"]
    kept = fold_notes(b, l, "k", order, "note", max_notes)
    texts = {r.k: r.note for r in note_texts(kept, "k", order, "note", width=16).collect()}
    heads = {r.k: r.note for r in note_heads(kept, "k", order, "note", 30).collect()}
    for k, _, _, _, text in base:
        want = _fold(text, [n for kk, _, _, _, n in later if kk == k])
        assert texts[k] == want
        assert heads[k] == want[:30]


@pytest.mark.parametrize("max_notes", [0, 30, 512])
def test_notes_that_hold_the_separator(spark, max_notes):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9)]
    base = [(f"k{k}", "c", 0, 0, rng.choice([*words, ""])) for k in range(4)]
    later = [
        (f"k{k}", "c", s, 0, rng.choice([" | ", " | ", "|", " "]).join(rng.choices(words, k=rng.randrange(1, 5))))
        for k in range(3) for s in range(1, 25 + 20 * k)
    ]
    # What goes decides who are neighbours: with "a | b" gone, "b | d" lies across the edge of the others.
    chain = ["a", "b", "a | b", "d", "b | d", "e ", "d | e", " f", "e  |  f", "x|y", "| d", "f"]
    later += [("k3", "c", s, 0, n) for s, n in enumerate(chain, 1)]
    schema = "k string, chat_id string, msg_seq long, pos int, note string"
    order = ["chat_id", "msg_seq", "pos"]
    kept = fold_notes(
        spark.createDataFrame(base, schema), spark.createDataFrame(later, schema), "k", order, "note", max_notes
    )
    texts = {r.k: r.note for r in note_texts(kept, "k", order, "note").collect()}
    for k, _, _, _, text in base:
        assert texts[k] == _fold(text, [n for kk, _, _, _, n in later if kk == k])


@pytest.mark.parametrize("n", [510, 512, 513, 515, 2100])
def test_no_note_is_lost_at_any_number(spark, n):
    schema = "k string, chat_id string, msg_seq long, pos int, note string"
    base = spark.createDataFrame([("k", "c", 0, 0, "base")], schema)
    later = spark.createDataFrame([("k", "c", i, 0, f"note {i:05d}") for i in range(1, n + 1)], schema)
    order = ["chat_id", "msg_seq", "pos"]
    [row] = note_texts(fold_notes(base, later, "k", order, "note"), "k", order, "note").collect()
    assert row.note == " | ".join(["base", *[f"note {i:05d}" for i in range(1, n + 1)]])


def test_notes_never_meet_by_a_broadcast(spark):
    """Like notes take next to nothing as a table, and many times that in the driver."""
    rows = spark.range(2000).select(
        F.lit("k").alias("k"), F.struct(F.col("id").alias("msg_seq")).alias("_order"),
        F.format_string("note %09d", F.col("id") - F.col("id") % 2).alias("note"),
    )
    rows = rows.withColumn("note", F.concat("note", F.when(F.col("_order.msg_seq") % 2 == 0, "!").otherwise("")))
    told = notes._not_contained(durable(rows), "k", "_order", "note")
    assert {r.note[-1] for r in told.collect()} == {"!"} and told.count() == 1000
    assert "BroadcastHashJoin" not in told._jdf.queryExecution().executedPlan().toString()


def test_merged_notes_are_whole(spark):
    rows = [(i, "Dan Cohen", f"05000{i % 2}", "x", False, f"note {i:05d}", "") for i in range(600)]
    schema = "seq long, name string, phone string, field string, from_local boolean, note string, extra_info string"
    [row] = dup.apply_merge(spark.createDataFrame(rows, schema))[0].collect()
    assert row.note == " | ".join(f"note {i:05d}" for i in range(600))


RULES = [
    di.Rule(1, "Alpha beta", "x"), di.Rule(2, "alpha", "y"), di.Rule(3, "be", "z"),
    di.Rule(4, "gaz", "gas", r"(?<![rm])gaz(?!r)"), di.Rule(5, "Q", "w"),
]
TEXTS = ["Alpha beta", "ALPHA", "mgazine", "gaz gazr gaz", "be be alpha", "", "q", "none"]


def test_labels_inline_and_joined(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    first = [r[0] for r in df.select(di.first_label(F.col("t"), RULES)).collect()]
    assert first == ["x", "y", "", "gas", "y", "", "w", ""]
    vote = [r[0] for r in df.select(di.voted_label(F.col("t"), RULES)).collect()]
    assert vote == ["x", "y", "", "gas", "z", "", "w", ""]
    plain = [r for r in RULES if not r.guard]
    table = spark.createDataFrame(
        [(r.priority, r.keyword, r.label) for r in plain], "priority long, keyword string, label string"
    )
    matches = di.match_by_grams(df, "id", "t", table).collect()
    want = {(i, r.keyword, t.count(r.keyword)) for i, t in enumerate(TEXTS) for r in plain if r.keyword in t}
    assert {(r.id, r.keyword, r.n) for r in matches} == want


@pytest.mark.parametrize("limit", [0, 200_000])
def test_label_rows_gives_the_same_for_big_tables(spark, monkeypatch, limit):
    plain = [r for r in RULES if not r.guard]
    table = spark.createDataFrame(
        [(r.priority, r.keyword, r.label) for r in plain], "priority long, keyword string, label string"
    )
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for mode in ("first", "vote"):
        small = {r.id: r.label for r in di.label_rows(df, "id", "t", table, mode).collect()}
        monkeypatch.setattr(di, "inline_rules", lambda rules: None)
        monkeypatch.setattr(di, "MAX_BROADCAST_RULES", limit)
        big = {r.id: r.label for r in di.label_rows(df, "id", "t", table, mode).collect()}
        monkeypatch.undo()
        assert small == big


@pytest.mark.parametrize("limit", [0, 200_000])
def test_many_rules_meet_few_texts_each(spark, monkeypatch, limit):
    """Keywords of like letters: short runs would bring each text to a great part of the rules."""
    monkeypatch.setattr(di, "MAX_BROADCAST_RULES", limit)
    words = [f"k{i}" for i in range(0, 20_000, 7)] + ["z", "é" * 9, "a much longer keyword", "😀k\n7"]
    rules = spark.createDataFrame([(0, w, "l") for w in words], "priority long, keyword string, label string")
    texts = [f"k{i} k{i}z" for i in range(0, 20_000, 50)] + ["", "é" * 20, "a much longer keyword!", "😀k\n70 k"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    got = {(r.id, r.keyword): r.n for r in di.match_by_grams(df, "id", "t", rules).collect()}
    assert got == {(i, w): t.count(w) for i, t in enumerate(texts) for w in words if w in t}
    assert di._candidates(df, "id", "t", rules, di.GRAM).count() < 3 * len(got)


def test_longest_alias_prefers_table_order_on_ties(spark):
    df = spark.createDataFrame([("at aa and bb",), ("bb",), ("no",)], "t string")
    pairs = [("Town", "bb"), ("City", "aa"), ("Big Place", "zz")]
    assert [r[0] for r in df.select(di.longest_alias(F.col("t"), pairs)).collect()] == ["Town", "Town", ""]


def test_components_of_a_hub_and_a_chain(spark):
    edges = [("h", f"l{i:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    got = connected_components(spark.createDataFrame(edges, "u string, v string")).collect()
    parts: dict[str, set] = {}
    for r in got:
        parts.setdefault(r.component, set()).add(r.node)
    assert sorted(len(p) for p in parts.values()) == [61, 201] and len(got) == 262


def _related(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not a or a == b or len(a.split()) < 2:
        return False
    if b.startswith(a + " "):
        return True
    ts, tl = a.split(), b.split()
    rest = iter(tl)
    return len(a) < len(b) and len(ts) >= 3 and len(tl) > len(ts) and all(t in rest for t in ts)


def _groups_by_pairs(entries):
    parent = list(range(len(entries)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, n1, p1, f1) in enumerate(entries):
        for j in range(i):
            _, n2, p2, f2 = entries[j]
            if f1 == f2 and p1 and p2 and p1 != p2 and _related(n1, n2):
                parent[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, e in enumerate(entries):
        groups.setdefault(find(i), []).append(e)
    return {
        frozenset(e[0] for e in g)
        for g in groups.values()
        if len({e[2] for e in g} - {""}) >= 2 and len({e[1] for e in g}) >= 2
    }


@pytest.mark.parametrize("seed, most_paired", [(0, 24), (1, 24), (1, 3)])
def test_extended_groups_equal_all_pairs(spark, monkeypatch, seed, most_paired):
    monkeypatch.setattr(dup, "MOST_PAIRED", most_paired)
    rng = random.Random(seed)
    words = ["dan", "cohen", "plumber", "north", "new"]
    entries = [
        (
            i,
            " ".join(sorted(rng.sample(words, rng.randrange(1, 5)), key=words.index)),
            rng.choice(["", "1", "2", "3", "4"]) if rng.random() < 0.7 else str(i),
            rng.choice(["f", "g"]),
        )
        for i in range(60)
    ]
    df = spark.createDataFrame(entries, "seq long, name string, phone string, field string")
    k = dup.keyed(df)
    found = dup.extended_members(dup.triples(k))
    rows = k.join(found, ["norm_field", "norm_name", "norm_phone"]).select("component", "seq").collect()
    got: dict[str, set] = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.seq)
    wanted = _groups_by_pairs(entries)
    by_id = {e[0]: e for e in entries}
    complete = {
        frozenset(s) for s in got.values()
        if len({by_id[i][2] for i in s}) >= 2 and len({by_id[i][1] for i in s}) >= 2
    }
    assert complete == wanted


def test_merge_twice_changes_nothing(spark):
    entries = [
        (0, "Dan Cohen", "0500000002", "x", False, "a", ""),
        (1, "dan-cohen", "030000001", "x", True, "b", "long"),
        (2, "Other", "0500000009", "x", False, "", ""),
        (3, "ניקוי ספות", "1", "", False, "", ""),
        (4, "ניקוי ספות", "2", "", False, "", ""),
    ]
    schema = "seq long, name string, phone string, field string, from_local boolean, note string, extra_info string"
    once, phones, _ = dup.apply_merge(spark.createDataFrame(entries, schema))
    first = sorted(tuple(r) for r in once.drop("group_id").collect())
    assert ("Dan Cohen", "0500000002", "x", True, "a | b", "long", 0) in first and len(first) == 4
    nested = {r.name: r.phones for r in dup.nest_phones(once, phones).collect()}
    assert nested["Dan Cohen"] == ["0500000002", "030000001"] and nested["Other"] is None
    again, _, _ = dup.apply_merge(once.drop("group_id"))
    assert sorted(tuple(r) for r in again.drop("group_id").collect()) == first


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_counters_equal_loop(spark, width):
    rng = random.Random(9)
    states = ["none", "like", "dislike", "", "odd"]
    events = [
        (i, "entry", "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice(states), rng.choice(states))
        for i in range(300)
    ]
    stored = [("entry", "hot", 2, -5), ("entry", "idle", 4, None)]
    df = spark.createDataFrame(events, "event_id long, item_type string, item_key string, seq long, prev string, next string")
    state = spark.createDataFrame(stored, "item_type string, item_key string, likes long, dislikes long")
    want = {"hot": [2, 0], "idle": [4, 0]}
    history = []
    for _, _, key, seq, prev, new in events:
        prev, new = prev or "none", new or "none"
        if "odd" in (prev, new):
            continue
        cur = list(want.get(key, [0, 0]))
        for i, s in enumerate(("like", "dislike")):
            cur[i] = max(0, cur[i] + (new == s) - (prev == s))
        if prev != new:
            want[key] = cur
        history.append((key, seq, cur[0], cur[1]))
    final = {r.item_key: [r.likes, r.dislikes] for r in vt.apply_votes(df, state, width).collect()}
    assert final == want
    got = vt.vote_history(df, state, width).select("item_key", "seq", "likes", "dislikes").collect()
    assert sorted(tuple(r) for r in got) == sorted(history)


BASE = (
    "seq long, name string, phone string, phones array<string>, field string, from_local boolean, "
    "note string, extra_info string"
)


def test_overlay_rules(spark):
    base = spark.createDataFrame(
        [
            (0, "A", "050-1", None, "f", False, "own", ""),
            (1, "A again", "0501", None, "f", False, "", ""),
            (2, "B", "052", ["052", "053"], "f", True, "own", ""),
            (3, "C", "054", None, "f", False, "", ""),
            (4, "no phone", "", None, "f", False, "", ""),
            (5, "no phone 2", "", None, "f", False, "", ""),
        ],
        BASE,
    )
    added = spark.createDataFrame([(0, "D", "054", None, "", False, "", ""), (1, "E", "055", None, "", False, "", "")], BASE)
    log = spark.createDataFrame(
        [
            ("0501", 1, "edit", "field", "", None),
            ("0501", 2, "edit", "phone", "0999", None),
            ("0501", 3, "note", None, "", None),
            ("0501", 4, "edit", "note", "edited", None),
            ("052", 5, "edit", "phones", None, ["052"]),
            ("052", 6, "flag", None, "false", None),
            ("052", 7, "note", None, "said", None),
            ("054", 8, "delete", None, None, None),
            ("077", 9, "edit", "name", "unknown", None),
        ],
        ov.CHANGE_SCHEMA,
    )
    got = {r.name: r for r in ov.merge_overlay(base, added, ov.with_display_phone(log)).collect()}
    assert set(got) == {"A", "B", "no phone", "no phone 2", "E"}
    assert (got["A"].field, got["A"].phone, got["A"].phone_display, got["A"].item_key) == ("", "0999", "0999", "0999")
    assert got["A"].note == "edited" and got["B"].note == "said"
    assert got["B"].phones is None and got["B"].from_local is False and got["E"].is_added
    assert ov.merge_overlay(base, added, log, collapse_blank_keys=True).filter("name LIKE 'no%'").count() == 1
    same = ov.merge_overlay(base, added.limit(0), log.limit(0)).filter("item_key <> ''")
    assert sorted(r.name for r in same.collect()) == ["A", "B", "C"]


def test_additions_equal_one_by_one(spark):
    rng = random.Random(2)
    keys = [f"{i:03d}" for i in range(30)]
    requests = [(i, f"n{i}" if i % 9 else " ", rng.choice(keys), "", rng.sample(keys, 2)) for i in range(60)]
    catalogue = [("000", None, ["001"])]
    taken = {"000", "001"}
    want = []
    for seq, name, phone, _, phones in requests:
        mine = {phone, *phones}
        if name.strip() and not mine & taken:
            want.append(seq)
            taken |= mine
    df = ov.prepare_additions(
        spark.createDataFrame(requests, "seq long, name string, phone string, phone_display string, phones array<string>")
    )
    cat_df = spark.createDataFrame(catalogue, "phone string, phone_display string, phones array<string>")
    accepted, refused = ov.accept_additions(df, cat_df)
    assert sorted(r.seq for r in accepted.collect()) == want
    assert accepted.count() + refused.count() == df.count()


def _one_by_one(rows):
    taken, won = set(), []
    for i, phones in rows:
        if not taken & set(phones):
            taken |= set(phones)
            won.append(i)
    return won


@pytest.mark.parametrize("settled", [2048, 16])
def test_additions_along_a_chain_and_around_a_hub(spark, monkeypatch, settled):
    """Each row of the chain shares a phone with the next; all of the hub share one."""
    monkeypatch.setattr(ov, "SETTLED", settled)

    def phone(i):
        return f"05{i:08d}"

    n = 2000 if settled > 1000 else 60
    rows = [(i, [phone(i), phone(i + 1)]) for i in range(n)]
    rows += [(n + i, [phone(50_000_000), phone(60_000_000 + i)]) for i in range(300)]
    df = spark.createDataFrame(
        [(i, "x", p[0], p[0], p) for i, p in rows],
        "seq bigint, name string, phone string, phone_display string, phones array<string>",
    )
    spark.sparkContext.setJobGroup(f"chain-{settled}", "")
    accepted, refused = ov.accept_additions(df, df.limit(0))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{settled}"))
    spark.sparkContext.setJobGroup("", "")
    want = _one_by_one(rows)
    assert sorted(r.seq for r in accepted.collect()) == want
    assert refused.count() == len(rows) - len(want)
    if settled > 1000:
        assert jobs < 150  # one by one it would be a thousand rounds


def test_normaliser_rules_see_earlier_results(spark):
    df = spark.createDataFrame(
        [("x", "a", ""), ("barber", "z", ""), ("y", "mebty", ""), ("y", "meb", ""), ("a", "z", "")],
        "name string, field string, note string",
    )
    rules = [
        cat.NormRule("b", ("field",), ("a",)),
        cat.NormRule("c", ("name", "field"), (cat.START + "b" + cat.END, cat.START + "bar")),
        cat.NormRule("d", ("field",), unless=(("meb", "mebty"),)),
        cat.NormRule("e", ("name", "field"), ("z",), exclude=("a",)),
    ]
    assert [r.field for r in cat.normalise(df, rules).collect()] == ["c", "c", "mebty", "d", "z"]


def test_verdict_texts(spark):
    raw = [
        '{"include": true, "field": "x", "reason": "r"}',
        'text ```json\n{"include": false, "reason": "no"}\n``` tail',
        "include = TRUE and more",
        '{"include": true, "field": "broken \\"q\\"", "reason": ',
        "",
        "no verdict here",
    ]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    got = [r[0] for r in df.select(read_verdict(F.col("t"))).collect()]
    assert [g.include for g in got] == [True, False, True, True, None, None]
    assert got[0].field == "x" and got[1].reason == "no" and got[3].field == 'broken "q"'
    assert got[4].error == "empty answer" and got[5].error and got[2].error is None
    venues = spark.createDataFrame([('x {"venues": [{"name": " A "}, {"name": ""}]} y',), ("bad",)], "t string")
    found = venues.select(read_venues(F.col("t"))).collect()
    assert [v.name for v in found[0][0]] == ["A"] and not found[1][0]


def test_entry_stub_cuts_notes(spark):
    from tipweave.sinks.reports import entry_stub

    df = spark.createDataFrame(
        [("A", "1", None, True, "n" * 201), ("B", "2", "f", False, None)],
        "name string, phone string, field string, from_local boolean, note string",
    )
    rows = entry_stub(df).collect()
    assert rows[0].note_preview == "n" * 200 + "…" and rows[0].field == "" and rows[1].note_preview == ""


def test_limit_takes_the_first_mentions(spark):
    from tipweave.plans.contacts import ContactRules, candidates

    messages = spark.createDataFrame(
        [("c", i, "s", "d", f"P{i}.vcf (file attached)") for i in range(5)],
        "chat_id string, msg_seq long, sender string, date_str string, body string",
    )
    cards = spark.createDataFrame(
        [(f"p{i}.vcf", f"p{i}", "x", 0, f"P{i}", f"050000000{i}", "", "", "", f"P{i}.vcf") for i in range(5)],
        "file_key string, stem_key string, file_path string, card_no int, name string, phone string,"
        "org string, note_vcf string, title_vcf string, vcf_filename string",
    )
    got = candidates(messages, cards, ContactRules((), (), [], limit=2)).select("name").collect()
    assert sorted(r.name for r in got) == ["P0", "P1"]


def test_places_over_all_rows(spark):
    rows = [(i, f"n{i * 37 % 11}") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string").repartition(7)
    got = {r.id: r.place for r in sq.placed(df, [F.desc("name"), F.col("id")]).collect()}
    by_name = sorted(sorted(rows), key=lambda r: r[1], reverse=True)
    assert got == {i: n for n, (i, _) in enumerate(by_name)}
    assert sq.placed(df.filter("id < 0"), ["id"]).count() == 0


def test_foreign_letters_go_to_the_last_run(spark):
    from tipweave.operators.names import scrub_foreign_letters
    from tipweave.rules import hebrew

    runs = "א" + "".join(f" ab{c} ג" for c in "cdefghijk")
    df = spark.createDataFrame(
        [(runs,), ("kפה בר",), ("Bar ab",), ("בר  ב",), (None,)], "name string"
    )
    got = [r[0] for r in df.select(
        scrub_foreign_letters(F.col("name"), *hebrew.VENUES.scrub)
    ).collect()]
    assert got == ["א" + " ג" * 9, "קפה בר", "Bar ab", "בר ב", ""]
