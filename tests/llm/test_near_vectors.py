"""Near-equal vectors against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.fixtures import clashing
from tipweave.llm import near_vectors, navigable
from tipweave.llm.queries.vectors import LEAST

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(seed, n, groups, noise, dims=24, labels=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims)) / dims**0.5
    return [(i, x[i].astype(np.float32).tolist(), int(rng.integers(0, labels))) for i in range(n)]


def odd(rows):
    v = rows[0][1]
    return rows + [
        (5000, None, 0), (5001, [], 0), (5002, [0.0] * 24, 0), (5003, [None, *v[1:]], 0),
        (5004, [float("nan"), *v[1:]], 0), (5005, [float("inf"), *v[1:]], 0), (5006, v, None),
        (5007, v, 0), (5007, v, 0), (5008, v, 1), (5009, [2 * x for x in v], 0), (5010, v[:-1], 0),
        (None, v, 0), (5011, [1e-30 * x for x in v], 0),
    ]


def brute(rows):
    good = [(p, i, np.array(v, np.float32).astype(float), lab) for p, (i, v, lab) in enumerate(rows)
            if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {p: v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for p, _, v, _ in good}
    links = {p: set() for p in range(len(rows))}
    for a, (p, _, v, lab) in enumerate(good):
        for q, _, u, other in good[:a]:
            if lab == other and len(u) == len(v) and unit[p] @ unit[q] >= LEAST:
                links[p].add(q)
                links[q].add(p)
    out, seen = {}, set()
    for p in range(len(rows)):
        if p in seen:
            continue
        part, todo = {p}, [p]
        while todo:
            for q in links[todo.pop()] - part:
                part.add(q)
                todo.append(q)
        seen |= part
        ids = [rows[q][0] for q in part if rows[q][0] is not None]
        for q in part:
            out[q] = (rows[q][0], len(links[q]), min(ids, default=None))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("shard,noise,n", [(8192, 0.4, 700), (60, 0.4, 500), (60, 0.05, 500), (90, 1.5, 400)])
def test_linked(spark, monkeypatch, shard, noise, n):
    monkeypatch.setattr(near_vectors, "SHARD_ROWS", shard)
    rows = odd(vectors(3, n, 25, noise))
    got = near_vectors.linked(clashing(spark.createDataFrame(rows, VECTORS)), LEAST).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_nothing(spark):
    assert near_vectors.linked(spark.createDataFrame([], VECTORS), LEAST).count() == 0
    alone = spark.createDataFrame([(1, None, 0), (2, [0.0], None)], VECTORS)
    assert sorted(map(tuple, near_vectors.linked(alone, LEAST).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_copies_are_one_node():
    rng = np.random.default_rng(1)
    one = rng.normal(size=16)
    x = one + 0.01 * rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = navigable.Graph(x).build(float(np.cos(np.arccos(LEAST) / 2)))
    assert len(graph.lead) == 1 and (graph.ball == 0).all()


def test_recall_of_the_graph_alone():
    """Links the graphs find by themselves, without the pairs of the audit."""
    rows = vectors(8, 4000, 400, 0.27, 32, 1)
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = navigable.Graph(x).build(float(np.cos(np.arccos(LEAST) / 2 - 1e-6)))
    found, _ = navigable.near_balls(graph, graph, np.arccos(LEAST), near_vectors.WIDTH, 0, 1.0)
    every = navigable._all_pairs(graph, graph, np.arccos(LEAST))
    both = set(map(tuple, found.tolist())) & set(map(tuple, every.tolist()))
    assert len(every) > 500 and len(both) >= 0.97 * len(every)


def test_beams_widen_until_the_audit_passes(monkeypatch):
    rows = vectors(8, 1500, 150, 0.27, 32, 1)
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = navigable.Graph(x).build(float(np.cos(np.arccos(LEAST) / 2 - 1e-6)))
    for level in graph.near:
        level[:, 2:] = -1  # a poor graph
    pairs, width = navigable.near_balls(graph, graph, np.arccos(LEAST), 1, 200, 0.99)
    every = navigable._all_pairs(graph, graph, np.arccos(LEAST))
    assert width > 1
    assert len(set(map(tuple, pairs.tolist())) & set(map(tuple, every.tolist()))) >= 0.97 * len(every)
