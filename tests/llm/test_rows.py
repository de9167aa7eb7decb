"""Sharding, line dedup and mixing."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import clashing, no_docs, odd_docs, odd_rows
from tipweave.llm import line_dedup, mixing, sharding
from tipweave.llm.tables import running


def test_running_sums_equal_a_plain_loop(spark):
    rows = [(g, i, (i * 7) % 5) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): (r.s_before, r.s_total) for r in
           running(df, [F.col("i")], {"s": F.col("v")}, group="g").collect()}
    for g in ("a", "b", None):
        before = 0
        mine = [v for h, _, v in rows if h == g]
        for i, v in enumerate(mine):
            assert got[g, i] == (before, sum(mine))
            before += v


@pytest.mark.parametrize("shards", [1, 4, 24, 40])
def test_shards_are_even_and_mixed(spark, shards):
    got = sharding.stratified_shards(odd_docs(spark), shards).collect()
    assert len(got) == len(odd_rows())
    sizes = Counter(r.shard for r in got)
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(2400)]
    got = sharding.stratified_shards(
        spark.createDataFrame(rows, "doc_id bigint, source string"), 24
    ).collect()
    for s in range(24):
        found = Counter(r.source for r in got if r.shard == s)
        for source, share in (("a", 60), ("b", 30), ("c", 10)):
            assert abs(found[source] - share) <= 1


def test_shards_agree_between_runs_and_keep_columns(spark):
    docs = clashing(odd_docs(spark))
    one, two = (
        sorted(map(repr, sharding.stratified_shards(docs, 5).collect())) for _ in range(2)
    )
    assert one == two
    assert sharding.stratified_shards(no_docs(spark)).count() == 0


def test_write_shards(spark, folder):
    sharded = sharding.stratified_shards(odd_docs(spark), 3)
    sharding.write_shards(sharded, f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out")
    assert back.count() == len(odd_rows())
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def plain(line: str) -> str:
    return " ".join(x for x in line.replace("\x0b", " ").split(" ") if x).strip()


def test_lines_against_brute_force(spark):
    rows = []
    for i in range(40):
        site = "hot" if i % 4 else "cold"
        body = [f"line {i} one", "", f"line {i} two"]
        if i % 3 == 0:
            body.insert(1, "  share   this ")
        if i % 9 == 0:
            body.append("rare tail")
        rows.append((i, "\n".join(body), "en", site, 0))
    rows += odd_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string,"
                                       " n_chars bigint")
    got = line_dedup.drop_boilerplate(docs, ratio=0.2, min_pages=3).collect()
    pages, seen = Counter(), defaultdict(Counter)
    for _, text, _, site, _ in rows:
        pages[site] += 1
        seen[site].update({plain(x) for x in (text or "").split("\n")} - {""})
    want = []
    for i, text, lang, site, _ in rows:
        if text is None:
            want.append((i, None, lang, site, None, 0))
            continue
        lines = text.split("\n")
        rest = [x for x in lines if not (
            plain(x) and seen[site][plain(x)] >= 3 and seen[site][plain(x)] > 0.2 * pages[site])]
        out = "\n".join(rest) if len(rest) < len(lines) else text
        want.append((i, out, lang, site, len(out), len(lines) - len(rest)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(r.dropped_lines for r in got)


def test_lines_keep_extra_columns_and_take_no_rows(spark):
    docs = clashing(odd_docs(spark))
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == [*docs.columns, "dropped_lines"]
    assert got.count() == len(odd_rows())
    assert line_dedup.drop_boilerplate(no_docs(spark)).count() == 0


def brute_targets(sizes: dict, weights=mixing.WEIGHTS, share=1.5, limit=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, dict(sizes)
    budget = share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        above = [s for s in free if total and budget * weight[s] / total > limit * sizes[s]]
        if not above:
            target |= {s: budget * weight[s] / total if total else 0.0 for s in free}
            return target
        for s in above:
            target[s] = limit * sizes[s]
            budget -= target[s]
            del free[s]


def test_mix_reaches_the_targets(spark):
    rows = [(i, " ".join(["word"] * (5 + i * 13 % 40)), f"s{min(i % 17, 5)}") for i in range(900)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "only one", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.draw(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target, rel_tol=1e-9) for r in mine)
        taken = sum(r.size * r.times for r in mine)
        assert abs(taken - target) <= max(r.size for r in mine) / 2 + 1
        assert all(0 <= r.times <= 2 for r in mine)
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        assert all(whole <= r.times <= whole + 1 for r in mine)


def test_mix_takes_the_smallest_keys_first(spark):
    rows = [(i, "a b c d", "s") for i in range(50)] + [(i, "a", "t") for i in range(50, 52)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.times for r in mixing.draw(docs, share=0.5, quality=F.lit(1.0)).collect()}

    def key(i: int) -> float:
        digits = hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12]
        return -math.log((int(digits, 16) + 0.5) / 2**48)

    chosen = [i for i in range(50) if got[i]]
    assert chosen and max(map(key, chosen)) < min(key(i) for i in range(50) if not got[i])


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "a b c d" if i % 2 else "%%%%%%% $$$$$$$ ####### &&&&&&&", "s") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.draw(docs, share=0.3).collect()
    taken = Counter(r.doc_id % 2 for r in got if r.times)
    assert taken[1] > 3 * taken[0]


def test_mixed_repeats_rows_whole(spark):
    docs = clashing(odd_docs(spark))
    drawn = {(r.doc_id, r.source, r.size): r.times * r.times_found
             for r in mixing.draw(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    found = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in got.collect())
    assert {k: v for k, v in drawn.items() if v} == dict(found)
    assert mixing.mixed(no_docs(spark)).count() == 0
