"""Exact top-k and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, no_docs, odd_docs, odd_rows
from tipweave.llm import digests, fingerprints, topk

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vector_rows():
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(330)]
    rows += [(i, rows[7][1], 0) for i in range(400, 460)]  # ties
    rows += [(500, None, 0), (600, [], 0), (700, [1.0, None] + [0.0] * 6, 0), (None, [0.5] * 8, 0),
             (800, [float("nan")] * 8, 0), (900, [float("inf")] * 8, 0), (1000, [0.1, 0.2], 0),
             (1001, [0.3, 0.4], 0), (1100, rows[1][1], 0), (1100, rows[1][1], 0)]
    return rows


def brute(rows, k, step):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole
                        if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,blocks", [(10, (512, 8192)), (3, (2, 50)), (400, (5, 100))])
def test_top_k(spark, monkeypatch, k, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "ROW_BLOCK", blocks[1])
    rows = vector_rows()
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), k, F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, 100)


def test_top_k_of_nothing_and_of_huge_values(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), 5, F.col("id") == 0).count() == 0
    rows = [(0, [3e30, 1.0], 0), (1, [3e30, 0.0], 0), (2, [-3e30, 0.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), 5, F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [
        (1, topk.MOST), (2, -topk.MOST)]


def test_top_k_in_parts(spark, monkeypatch):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS)
    for values in (2000, 500):  # parts of 250 and of 62 vectors
        monkeypatch.setattr(topk, "PART_VALUES", values)
        got = topk.top_k(frame, 7, F.col("id") % 50 == 0).collect()
        assert sorted(map(tuple, got)) == brute(rows, 7, 50)


def test_top_k_of_scores_up_to_what_a_long_holds(spark):
    rows = [(i, [float(x), 1.0], 0) for i, x in enumerate([2**21, 2**20, 2**20 + 1, -(2**21), 3, 3])]
    rows += [(10 + i, [float(2**21 - i * 2**10), float(i)], 0) for i in range(8)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), 4, F.col("id") % 3 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 3)
    assert max(r.score for r in got) > 2**60


def test_fingerprints_against_brute_force(spark):
    rows = odd_rows()
    got = fingerprints.fingerprint_pairs(clashing(odd_docs(spark))).collect()
    assert len(got) == len(rows)
    alone = [(i, t or "") for i, t, *_ in rows if i is not None and i not in (25, 26)]
    alone.sort(reverse=True)
    by_id = {r.doc_id: r for r in got}
    for (i, a), (_, b) in zip(alone, alone[1:]):
        if (i, a) == alone[0] or abs(i - 25) < 3:
            continue  # next to the shared ids, whose order is by hash
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        r = by_id[i]
        assert r.n_chars == len(a)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        one, two, other = (digests.codes([x.encode()]) for x in (a, new, b))
        assert r.fingerprint == digests.written(one)[0]
        assert r.edited_fingerprint == digests.written(two)[0]
        assert r.near_edited == pytest.approx(digests.likeness(one, two)[0])
        assert r.near_next == pytest.approx(digests.likeness(one, other)[0])
    assert fingerprints.fingerprint_pairs(no_docs(spark)).count() == 0


def test_the_last_document_is_followed_by_the_first(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 5) for i in range(300)],
                                 "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs).collect()}
    texts = {i: f"text number {i} " * 5 for i in range(300)}
    for i in range(300):
        new = fingerprints.edited(texts[i], texts[(i - 1) % 300])
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    one = fingerprints.fingerprint_pairs(docs.where("doc_id = 4")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(4, 1.0)]


def test_counts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 50, 999, 5000)]
    whole = digests.triplet_counts(texts)
    for t, row in zip(texts, whole):
        assert row.sum() == max(0, len(t) - 2)
    monkeypatch.setattr(digests, "PIECE", 100)
    assert (digests.triplet_counts(texts) == whole).all()


def test_likeness_is_bounded_and_orders_edits():
    rng = random.Random(4)
    text = " ".join(f"word{rng.randrange(300)}" for _ in range(500)).encode()
    other = " ".join(f"else{rng.randrange(300)}" for _ in range(500)).encode()
    small, half = text[:-40] + other[:40], text[: len(text) // 2] + other[: len(text) // 2]
    a, b, c, d, e = (digests.codes([x]) for x in (text, small, half, other, b""))
    near = [digests.likeness(a, x)[0] for x in (a, b, c, d)]
    assert near[0] == 1 and near == sorted(near, reverse=True)
    assert 0 <= digests.likeness(a, e)[0] <= 1
