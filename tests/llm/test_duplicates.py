"""SimHash groups, components and passage dedup against brute force."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, no_docs, odd_docs, odd_rows, words
from tipweave.llm import near_texts, simhash, unit_dedup
from tipweave.llm.graph import components


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("kind", ["path", "star", "random", "clique", "none"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(1, 300)],
        "star": [(1000, i) for i in range(1, 300)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)],
        "clique": [(i, j) for i in range(40) for j in range(i)],
        "none": [],
    }[kind]
    want = Union()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.root for r in
           components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    for x in want.up:
        assert got.get(x, x) == want.find(x)


def fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    rng = random.Random(9)
    rows = [(i, t) for i, t, *_ in odd_rows()]
    base = words(rng, 400, 5000)
    for i in range(100, 180):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{i % 7}"
        rows.append((i, " ".join(copy).upper() if i % 2 else " ".join(copy)))
    return rows


def test_links_within_two_bits(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = [(i, fingerprint(t)) for i, t in rows]
    groups = Union()
    for k, (_, a) in enumerate(prints):
        groups.find(k)
        for j in range(k):
            if (a ^ prints[j][1]).bit_count() <= 2:
                groups.join(k, j)
    least = {}
    for k, (i, _) in enumerate(prints):
        root = groups.find(k)
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted(repr((i, format(f, "016x"), least[groups.find(k)]))
                  for k, (i, f) in enumerate(prints))
    for light in (64, 2):  # by pairs, and by keys one bit away
        monkeypatch.setattr(simhash, "LIGHT", light)
        got = sorted(repr(tuple(r)) for r in simhash.components_of(docs).collect())
        assert got == want
    assert simhash.components_of(spark.createDataFrame([], docs.schema)).count() == 0


def test_pair_tables_cover_all_pairs_within_two_bits():
    masks = [m % 2**64 for m in simhash.pair_tables(4, 2)]
    for a in range(64):
        for b in range(a):
            assert any(not m & (1 << a | 1 << b) for m in masks)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_one_of_each_group_stays(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_texts, "CHUNK", chunk)
    rng = random.Random(11)
    rows = odd_rows()
    for g in range(12):
        base = words(rng, 300, 9000)
        for c in range(8):
            copy = list(base)
            for _ in range(c // 2):
                copy[rng.randrange(300)] = f"y{rng.randrange(99)}"
            rows.append((1000 + g * 10 + c, " ".join(copy), "en", "s", 0))
    docs = clashing(spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = near_texts.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert [i for i in sorted(x for x in ids if x and x >= 1000)] == [1000 + g * 10 for g in range(12)]
    assert ids.count(25) == 0 and ids.count(0) == 1  # 25 copies 0
    assert ids.count(26) == 2  # one id, two texts
    assert near_texts.one_of_each(no_docs(spark)).count() == 0


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(None, None)] * 2,
                                 "doc_id bigint, text string")
    assert sorted(map(tuple, near_texts.one_of_each(docs).collect()), key=repr) == [
        (1, "a b c d e f"), (None, None)]


def edited_pair(rng, i, edits):
    """Two texts that differ in ``edits`` words, and the share of five-word shingles they share."""
    base = words(rng, 400, 9000)
    copy = list(base)
    for at in rng.sample(range(400), edits):
        copy[at] = f"z{i}_{at}"
    a, b = ({" ".join(t[k : k + 5]) for k in range(396)} for t in (base, copy))
    return " ".join(base), " ".join(copy), len(a & b) / len(a | b)


def test_pairs_of_two_at_the_required_similarity(spark):
    rng = random.Random(17)
    rows, shares = [], {}
    for i in range(240):
        a, b, shares[i] = edited_pair(rng, i, 5 + i % 10)
        rows += [(2 * i, a), (2 * i + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in near_texts.one_of_each(docs).collect()}
    assert all(2 * i in left for i in shares)
    met = {i for i in shares if 2 * i + 1 not in left}
    high = {i for i, s in shares.items() if 0.8 <= s <= 0.9}
    assert len(high) > 80 and len(high & met) >= 0.93 * len(high)
    assert not {i for i in met if shares[i] < 0.8}
    assert len(set(shares) - high) > 80


def loose_group(rng, n, edits, size=400):
    """A text, and copies that each have other words changed: nearer to it than to each other."""
    base = words(rng, size, 9000)
    out = [" ".join(base)]
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(size), edits):
            copy[at] = f"q{i}_{at}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("chunk", [1024, 8])
def test_a_loose_group_is_joined_by_its_middle(spark, monkeypatch, chunk):
    """0.88 of the shingles are shared with the middle, which has the largest id, 0.78 otherwise."""
    monkeypatch.setattr(near_texts, "CHUNK", chunk)
    rng = random.Random(31)
    with_middle, without = loose_group(rng, 150, 5), loose_group(rng, 60, 9)[1:]
    rows = [(1000 - i, t) for i, t in enumerate(with_middle)]
    rows += [(2000 + i, t) for i, t in enumerate(without)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    left = {r.doc_id for r in near_texts.one_of_each(docs).collect()}
    assert len([i for i in left if i <= 1000]) <= 3 and 850 in left
    assert len([i for i in left if i >= 2000]) == 60  # 0.64 among themselves: no copies


def test_groups_meet_brute_force_on_close_texts(spark):
    rng = random.Random(37)
    rows = []
    for g in range(30):
        for t in loose_group(rng, rng.randrange(1, 6), rng.randrange(1, 4)):
            rows.append((len(rows), t))
    shingles = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    union = Union()
    for i in range(len(rows)):
        union.find(i)
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                union.join(i, j)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r.doc_id for r in near_texts.one_of_each(docs).collect()}
    assert left == {union.find(i) for i in range(len(rows))}


def test_near_copies_that_fill_a_source_leave_one_whole(spark):
    import corpus_pipeline

    rng = random.Random(41)
    base = [words(rng, 12, 9000) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [list(x) for x in base]
        for at in rng.sample(range(25), 4 if i else 0):
            lines[at][rng.randrange(12)] = f"q{i}_{at}"
        rows.append((i, "\n".join(" ".join(x) for x in lines), "s"))
    rows += [(100 + i, "Menu\n" + "\n".join(" ".join(words(rng, 20, 9000)) for _ in range(3)), "s")
             for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = {r.doc_id: r.text for r in
            corpus_pipeline.near(spark, corpus_pipeline.lines(spark, docs, ""), "").collect()}
    assert left[0] == rows[0][1] and len(left) <= 125
    assert not any("Menu" in t for t in left.values())


def test_copies_that_fill_a_source_leave_one_whole(spark):
    import corpus_pipeline

    rng = random.Random(23)
    text = "\n".join(" ".join(words(rng, 12, 9000)) for _ in range(20))
    rows = [(i, text, "s") for i in range(40)]
    rows += [(100 + i, "Menu\n" + "\n".join(" ".join(words(rng, 30, 9000)) for _ in range(3)), "s")
             for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    cleaned = corpus_pipeline.lines(spark, docs, "")
    left = {r.doc_id: r.text for r in corpus_pipeline.near(spark, cleaned, "").collect()}
    assert left[0] == text and len(left) == 81
    assert not any("Menu" in t for t in left.values())  # boilerplate still goes


def passages_rows():
    rng = random.Random(21)
    passage = " ".join(" ".join(words(rng, 8, 9000)) + "," for _ in range(9))
    rows = [(i, t, "en", "s", 0) for i, t, *_ in odd_rows()]
    for i in range(40, 60):
        own = [" ".join(words(rng, 9, 9000)) + "." for _ in range(6)]
        k = rng.randrange(5)
        text = " ".join(own[:k]) + ((" " + passage) if i % 2 else "") + " " + "\n".join(own[k:])
        rows.append((i, text + "\nAll rights reserved.", "en", "s", 0))
    return rows


def test_passages_against_brute_force(spark):
    rows = passages_rows()
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first: dict[str, object] = {}
    for i, text, *_ in ranked:
        for _, _, p in unit_dedup.units(text or ""):
            first.setdefault(p, i)
    want = []
    for i, text, *_ in rows:
        seen, runs = set(), []
        for place, (start, end, p) in enumerate(unit_dedup.units(text or "")):
            if p in seen or first[p] != i:
                size = p.count(" ") + 1
                if runs and runs[-1][0] == place - 1:
                    runs[-1] = (place, runs[-1][1], end, runs[-1][3] + size)
                else:
                    runs.append((place, start, end, size))
            seen.add(p)
        cuts = [r[1:] for r in runs if r[3] >= unit_dedup.MIN_WORDS]
        kept, at = "", 0
        for start, end, _ in cuts:
            kept, at = kept + text[at:start], end
        want.append((i, None if text is None else kept + text[at:], cuts))
    got = [(r.doc_id, r.text, [tuple(c) for c in r.cuts or []])
           for r in unit_dedup.without_repeats(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    cut = {i for i, _, c in got if c and i and 40 <= i < 60}
    assert cut == {i for i in range(43, 60, 2)}  # 41 has the passage first, even ids lack it
    for i, text, c in got:
        if not c and text is not None:
            assert (i, text) in {(r[0], r[1]) for r in rows}


def test_passages_that_start_and_end_inside_units(spark):
    rng = random.Random(37)

    def text(n):
        parts = []
        while n > 0:
            size = min(n, rng.randrange(3, 19))
            parts.append(" ".join(words(rng, size, 9000)) + rng.choice(",.;\n"))
            n -= size
        return " ".join(parts)

    rows, plain = [], []
    for i in range(300):
        source = text(150).split(" ")
        at, size = rng.randrange(1, 60), rng.randrange(51, 81)
        own = [text(40).rstrip(",.;\n"), text(40)]
        rows.append((i, " ".join(source)))
        rows.append((1000 + i, f"{own[0]} {' '.join(source[at:at + size])} {own[1]}"))
        plain.append((2000 + i, text(120)))
    docs = spark.createDataFrame(rows + plain, "doc_id bigint, text string")
    got = {r.doc_id: r for r in unit_dedup.without_repeats(docs).collect()}
    found = [i for i in range(300) if got[1000 + i].cuts]
    assert len(found) >= 285
    for i in found:  # the words around the passage stay
        assert len(got[1000 + i].text.split()) >= 70
    assert all(got[i].text == t for i, t in plain + rows[::2])


def test_units_are_sent_as_five_numbers_and_unpacked_alike(spark):
    text = "\n".join(["One two,  Three\tFOUR five.", "one TWO, six!", "été 🙂 é;"] * 3)
    asked = pa.RecordBatch.from_pylist([{"rank": 1, "text_hash": -2, "text": text}])
    [sent] = unit_dedup._cut_up(iter([asked]))
    assert sent.num_columns == 5 and {str(t) for t in sent.schema.types} == {"int64"}
    # The largest place, start, length and number of words that a text can have.
    top = 2**31 - 1
    far = (3, 4, 5, top << 32 | top - 9, 9 << 32 | 2**30 << 1 | 1)
    rows = [*(tuple(r.values()) for r in sent.to_pylist()), far]
    packed = spark.createDataFrame(rows, unit_dedup._UNITS_SQL)
    got = unit_dedup._unpacked(packed.withColumn("again", unit_dedup._again()))
    want, seen = [], set()
    for place, (start, end, plain) in enumerate(unit_dedup.units(text)):
        want.append((place, start, end, plain.count(" ") + 1, plain in seen))
        seen.add(plain)
    want += [(top, top - 9, top, 2**30, True)]
    got = got.select("place", "start", "end", "words", "again").collect()
    assert [tuple(r) for r in got] == want


def test_words_around_units_are_sent_once_and_as_they_stand():
    text = "One two,  Three\tFOUR five. one two, six!"
    digests = [xxhash.xxh64_intdigest(p) - 2**63 for _, _, p in unit_dedup.units(text)]
    for role, places in [(unit_dedup.EARLIEST, [0]), (unit_dedup.AGAIN, [0, 2]), (3, [0, 2])]:
        asked = pa.RecordBatch.from_pylist([
            {"rank": 1, "text_hash": 2, "wanted": [{"digest": digests[0], "role": role}], "text": text}
        ])
        [sent] = unit_dedup._look_around(iter([asked]))
        rows = sent.to_pylist()
        assert [r["place"] for r in rows] == places
        assert (rows[0]["before"], rows[0]["after"]) == ("", "  Three\tFOUR five. one two, six")
        if len(rows) == 2:
            assert (rows[1]["before"], rows[1]["after"]) == ("One two,  Three\tFOUR five.", " six")
            assert [r["role"] for r in rows] == [role, unit_dedup.AGAIN]


def test_passages_keep_columns_and_take_no_rows(spark):
    docs = clashing(odd_docs(spark)).withColumn("cuts", F.lit("mine"))
    got = unit_dedup.without_repeats(docs)
    assert got.columns == [c for c in docs.columns if c != "cuts"] + ["cuts", "cut_chars"]
    assert got.count() == len(odd_rows())
    assert unit_dedup.without_repeats(no_docs(spark)).count() == 0
