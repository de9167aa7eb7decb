"""The registered queries without SQL, over whole small tables, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from tests.llm.test_duplicates import Union, fingerprint
from tests.llm.test_texts import check_packing
from tipweave.llm import digests, fingerprints, html_text, sharding, toxicity, unit_dedup
from tipweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_shards(spark, docs):
    def key(d):
        return hashlib.md5(f"{sharding.SEED}:{d.doc_id}".encode()).hexdigest()

    by_source = defaultdict(list)
    for d in docs:
        by_source[d.source].append(d)
    placed = []
    for source, own in by_source.items():
        for rank, d in enumerate(sorted(own, key=key)):
            placed.append(((2 * rank + 1) / (2 * len(own)), source, key(d), d))
    want = set()
    n = sharding.SHARDS
    for place, (_, _, _, d) in enumerate(sorted(placed, key=lambda p: p[:3])):
        shard = place * n // len(docs)
        text = (d.text or "").encode()
        want.add((d.doc_id, len(text) + 8, zlib.crc32(text), "rows", shard,
                  place - (shard * len(docs) + n - 1) // n, None))
    assert set(map(tuple, rows(spark, "op1_sharding"))) == want


def test_toxicity(spark, docs):
    got = rows(spark, "op2_toxicity")
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD)


def test_packing(spark, docs):
    total, n = check_packing(rows(spark, "op4_packing"), [(d.doc_id, d.text) for d in docs])
    assert n <= 1.01 * total / 1024 + 1


def test_fingerprints(spark, docs):
    texts = [(d.doc_id, d.text or "") for d in sorted(docs, key=lambda d: -d.doc_id)]
    want = set()
    for (i, a), (_, b) in zip(texts, texts[1:] + texts[:1]):
        new = fingerprints.edited(a, b)
        one, two, other = (digests.codes([x.encode()]) for x in (a, new, b))
        want.add((i, len(a), hashlib.sha256(new.encode()).hexdigest(), digests.written(one)[0],
                  digests.written(two)[0], digests.likeness(one, two)[0],
                  digests.likeness(one, other)[0]))
    assert set(map(tuple, rows(spark, "op5_fingerprints"))) == want


def test_simhash(spark, docs):
    prints = {d.doc_id: fingerprint(d.text) for d in docs}
    groups = Union()
    ids = sorted(prints)
    for k, i in enumerate(ids):
        groups.find(i)
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                groups.join(i, j)
    want = {(i, format(prints[i], "016x"), groups.find(i)) for i in ids}
    assert set(map(tuple, rows(spark, "op7_simhash"))) == want


def test_page_texts(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    want = {(p.page_id, p.url, t := html_text.main_text(p.html), len(t)) for p in pages}
    assert set(map(tuple, rows(spark, "op9_html_text"))) == want
    assert all(t for _, _, t, _ in want)


def longer_passage(text, run, of_first):
    """The span around a short run that agrees word by word with where its longest unit is first."""
    start, end, size, (_, _, unit_start, unit_end, (other, o_start, o_end)) = run
    mine = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\s.,;:!?]+", text)]
    theirs = [(m.start(), m.end(), m[0].lower())
              for m in re.finditer(r"[^\s.,;:!?]+", of_first[other])]
    i, j = (next(n for n, w in enumerate([*ws, (9**9,) * 3]) if w[0] >= s)
            for ws, s in ((mine, unit_start), (theirs, o_start)))
    k, m = (next(n for n, w in enumerate([*ws, (9**9,) * 3]) if w[0] >= e)
            for ws, e in ((mine, unit_end), (theirs, o_end)))
    back = on = 0
    while back < unit_dedup.REACH and min(i, j) > back and mine[i - 1 - back][2] == theirs[j - 1 - back][2]:
        back += 1
    while (on < unit_dedup.REACH and k + on < len(mine) and m + on < len(theirs)
           and mine[k + on][2] == theirs[m + on][2]):
        on += 1
    agree = back + k - i + on
    if agree < unit_dedup.PASSAGE_WORDS:
        return None
    return (min(start, mine[i - back][0]), max(end, mine[k + on - 1][1]), max(size, agree))


def test_passages(spark, docs):
    first: dict[str, tuple] = {}
    got = {r.doc_id: r for r in rows(spark, "op10_unit_dedup")}
    assert len(got) == len(docs)
    texts = {d.doc_id: d.text or "" for d in docs}
    longer = 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        text = d.text or ""
        runs: list[list] = []
        for place, (start, end, unit) in enumerate(unit_dedup.units(text)):
            size = unit.count(" ") + 1
            if unit in first:
                best = (size, place, start, end, first[unit])
                if runs and runs[-1][0] == place - 1:
                    last = runs[-1]
                    runs[-1] = [place, last[1], end, last[3] + size, max(last[4], best)]
                else:
                    runs.append([place, start, end, size, best])
            first.setdefault(unit, (d.doc_id, start, end))
        spans = [tuple(r[1:4]) for r in runs if r[3] >= unit_dedup.MIN_WORDS]
        short = [r[1:] for r in runs if unit_dedup.ANCHOR_WORDS <= r[3] < unit_dedup.MIN_WORDS]
        more = [s for r in short if (s := longer_passage(text, r, texts))]
        longer += len(more)
        cuts: list[tuple] = []
        for span in sorted(spans + more):
            if cuts and cuts[-1][1] > span[0]:
                cuts[-1] = (cuts[-1][0], max(cuts[-1][1], span[1]), max(cuts[-1][2], span[2]))
            else:
                cuts.append(span)
        assert [tuple(c) for c in got[d.doc_id].cuts or []] == cuts
        kept, at = "", 0
        for start, end, _ in cuts:
            kept, at = kept + text[at:start], end
        assert (got[d.doc_id].text or "") == kept + text[at:]
    assert longer
