"""Ranked search against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest

from tests.llm.fixtures import clashing, no_docs, odd_docs, odd_rows
from tipweave.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    found = [(i, split(t)) for i, t in docs]
    whole = [w for _, w in found if w]
    count, length = len(whole), sum(map(len, whole))
    df = {}
    for w in whole:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, w in found:
            m = 10 + 90 * len(w) * count // max(length, 1)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                for t in terms if t in w
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, s[3], -s[0]) for n, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def items():
    rng = random.Random(9)
    shared = [f"w{rng.randrange(400)}" for _ in range(12)]
    rows = [(i, " ".join(shared[: rng.randrange(12)] + [f"W{rng.randrange(400)}" for _ in range(9)]))
            for i in range(25)]
    rows += [(50, None), (51, ""), (52, "nowhere-found zzz"), (None, "w1 w2"), (3, "w7 w8"),
             (53, "ä 漢字 \U0001f600 END"), (54, " ".join(f"w{x % 400}" for x in range(5000)))]
    return rows


@pytest.mark.parametrize("block,wave,cells", [(1 << 15, 32 << 20, 1 << 21), (30, 2000, 300)])
def test_search(spark, monkeypatch, block, wave, cells):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "WAVE_BYTES", wave)
    monkeypatch.setattr(lexical, "CELLS", cells)
    wanted = clashing(spark.createDataFrame(items(), "item_id bigint, text string"))
    got = lexical.search(clashing(odd_docs(spark)), wanted, 7).collect()
    assert sorted(map(tuple, got), key=repr) == brute([r[:2] for r in odd_rows()], items(), 7)


def test_nothing(spark):
    some = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert lexical.search(no_docs(spark), some, 3).count() == 0
    assert lexical.search(odd_docs(spark), some.where("false"), 3).count() == 0


def test_terms_go_by_bytes():
    text = "Ab_c ÄB x​9{z}~\x00q\U0001f600E" * 3
    assert [t.decode() for t in lexical.terms(text.encode())] == split(text)


def test_shared_sums_are_shared():
    rng = random.Random(2)
    common = list(range(100, 130))
    own = [sorted({*common, *(rng.randrange(90) for _ in range(5))}) for _ in range(40)]
    nodes, left = lexical.shared_sums([list(x) for x in own])
    size = 1 + max(max(x) for x in own)
    flat: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(nodes):
        flat[size + i] = flat.get(a, [a]) + flat.get(b, [b])
    for item, parts in zip(own, left, strict=True):
        assert sorted(t for p in parts for t in flat.get(p, [p])) == item
    additions = len(nodes) + sum(len(x) - 1 for x in left)
    assert additions < sum(len(x) - 1 for x in own) / 3
