"""Ranked lexical search for many queries at once, with shared parts of queries computed once.

Queries (items) that have terms in common share work: their terms are put in one common order, and
runs of neighbours that occur in several items become nodes (`shared_sums`), again and again, until
no pair of neighbours occurs twice. What comes out is a graph whose leaves are terms and whose nodes
are sums of two; an item is the sum of what is left of it. For a batch of documents every node is
one addition of whole columns: the partial sums of a document are made once and serve all items.

Items are dealt in blocks of about ``BLOCK_TERMS`` terms, by ranges of their rarest shared term;
blocks are mined in tasks and kept as a table. The driver hands them out in waves of at most
``WAVE_BYTES``. Per wave, documents become postings of the wave's terms (one map over whole texts),
whose counts give the weights; a second map over the postings scores all documents for all items of
the wave. A task keeps the k best of each item only, and those of all tasks are ranked at the end.

Scores are 64-bit integers, so sums do not depend on the order in which they are made.

Defined cases: items of one id are one item with the terms of all its texts; a null id is an id;
items without a term find nothing. Documents without an id count, and stand after the others of the
same score; repeated rows are documents of their own; a null or empty text has no terms and counts
for nothing; no documents or no items give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipweave.llm.tables import marked, running, stored

#: Bytes that are part of a term, with A to Z in lower case; a blank for all others.
TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
#: Terms of a block of items, with repeats, unless one item has more.
BLOCK_TERMS = 1 << 15
#: Bytes of blocks that are handed out at once.
WAVE_BYTES = 32 << 20
#: Numbers in the table of sums that a task holds at once.
CELLS = 1 << 21


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"]
        )


def shared_sums(items: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes that each add two earlier things, and the items in terms of them.

    Things are numbered: first the terms, one for each number used, then the nodes. Neighbours that
    occur together in the most items are put together first; a round makes all pairs that do not
    overlap, so few rounds are needed.
    """
    used = Counter(t for item in items for t in item)
    rank = {t: i for i, t in enumerate(sorted(used, key=lambda t: (-used[t], t)))}
    items = [sorted(item, key=rank.__getitem__) for item in items]
    size = 1 + max(used, default=-1)
    nodes: list[tuple[int, int]] = []
    while True:
        pairs = Counter(p for item in items for p in pairwise(item))
        pairs = {p: n for p, n in pairs.items() if n > 1}
        if not pairs:
            return nodes, items
        made: dict[tuple[int, int], int] = {}
        for k, item in enumerate(items):
            # The most frequent pair of the item goes first; what it takes is no part of another.
            at = sorted((i for i, p in enumerate(pairwise(item)) if p in pairs),
                        key=lambda i: (-pairs[item[i], item[i + 1]], i))
            joined, taken = set(), set()
            for i in at:
                if i not in taken and i + 1 not in taken:
                    joined.add(i)
                    taken |= {i, i + 1}
            if not joined:
                continue
            new, i = [], 0
            while i < len(item):
                if i in joined:
                    pair = (item[i], item[i + 1])
                    if pair not in made:
                        made[pair] = size + len(nodes)
                        nodes.append(pair)
                    new.append(made[pair])
                    i += 2
                else:
                    new.append(item[i])
                    i += 1
            items[k] = new


def _mined(df: pd.DataFrame) -> pd.DataFrame:
    """One block of items: its terms, the nodes (flat pairs) and the items (flat, with ends)."""
    words = sorted({t for item in df["terms"] for t in item})
    number = {t: i for i, t in enumerate(words)}
    nodes, left = shared_sums([[number[t] for t in item] for item in df["terms"]])
    flat = [x for item in left for x in item]
    return pd.DataFrame({
        "block": [df["block"].iloc[0]],
        "terms": [words], "items": [df["item"].tolist()],
        "nodes": [[x for pair in nodes for x in pair]],
        "parts": [flat], "ends": [np.cumsum([len(x) for x in left]).tolist()],
        "volume": [sum(len(t) + 16 for t in words) + 16 * (len(nodes) + len(flat) + len(left))],
    })


def mined_blocks(items: DataFrame) -> DataFrame:
    """Blocks of items from ``(item, text)``, each with the sums its items share; ``item`` is a
    string that is never null."""
    rows = items.select("item", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_distinct, "item string, terms array<binary>")
    # One item may have several texts.
    found = found.select("item", F.explode("terms").alias("term")).distinct()
    found = stored(found, "item-terms")
    often = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = found.join(stored(often, "often"), "term").groupBy("item").agg(
        F.collect_set("term").alias("terms"),
        # Items that share their rarest shared term come to stand together.
        F.min(F.when(F.col("n") > 1, F.struct("n", "term"))).alias("rare"),
    )
    order = [F.col("rare").asc_nulls_last(), F.col("item").asc()]
    placed = running(placed, order, {"terms": F.size("terms")})
    block = F.floor(F.col("terms_before") / BLOCK_TERMS)
    return placed.select(block.alias("block"), "item", "terms").groupBy("block").applyInPandas(
        _mined,
        "block bigint, terms array<binary>, items array<string>, nodes array<int>,"
        " parts array<int>, ends array<int>, volume bigint",
    )


def _postings(words):
    """Per document: its size in terms, and the numbers and counts of the wave's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(words.value)}
        for batch in batches:
            sizes, at, times = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                own = [(i, n) for t, n in Counter(found).items() if (i := number.get(t)) is not None]
                sizes.append(len(found))
                at.append([i for i, _ in own])
                times.append([n for _, n in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "size", "terms", "times"],
            )

    return run


class Block:
    """One block, ready to add up: `scores` turns what each term gives into what each item gets."""

    def __init__(self, row, number: dict[bytes, int]):
        self.items = list(row["items"])
        self.wave = np.array([number[bytes(t)] for t in row["terms"]], np.int64)
        self.nodes = np.array(row["nodes"], np.int64).reshape(-1, 2)
        self.parts = np.array(row["parts"], np.int64)
        self.starts = np.concatenate([[0], np.array(row["ends"], np.int64)[:-1]])
        self.rows = len(self.wave) + len(self.nodes)
        # Nodes that only need earlier levels are added together.
        level = np.zeros(self.rows, np.int64)
        for i, (a, b) in enumerate(self.nodes.tolist()):
            level[len(self.wave) + i] = 1 + max(level[a], level[b])
        deep = level[len(self.wave):]
        self.levels = [np.flatnonzero(deep == d) for d in range(1, 1 + int(deep.max(initial=0)))]

    def scores(self, given: np.ndarray) -> np.ndarray:
        sums = np.empty((self.rows, given.shape[1]), np.int64)
        sums[: len(self.wave)] = given
        for at in self.levels:
            sums[len(self.wave) + at] = sums[self.nodes[at, 0]] + sums[self.nodes[at, 1]]
        return np.add.reduceat(sums[self.parts], self.starts, axis=0)


class Best:
    """The k best documents of each item seen so far."""

    def __init__(self, k: int, items: int):
        self.k = k
        self.least = np.ones(items, np.int64)  # what a score must reach
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        self.found.append((item, scores[item, at], no_id[at], ids[at]))
        self.waiting += len(item)
        if self.waiting > 4 * self.k * len(self.least) + 1024:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, no_id, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, no_id, -score, item))
        item = item[order]
        starts = np.searchsorted(item, np.arange(len(self.least)))
        keep = order[np.arange(len(item)) - starts[item] < self.k]
        item, score, no_id, ids = item[np.arange(len(item)) - starts[item] < self.k], score[keep], no_id[keep], ids[keep]
        full = np.flatnonzero(np.bincount(item, minlength=len(self.least)) == self.k)
        last = np.searchsorted(item, full, side="right") - 1
        self.least[full] = score[last]
        self.found, self.waiting = [(item, score, no_id, ids)], 0
        return self.found[0]


def _scored(shared, k: int, count: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words, weights = shared.value
        number = {t: i for i, t in enumerate(words)}
        blocks = [Block(r, number) for r in rows]
        best = [Best(k, len(b.items)) for b in blocks]
        width = max(1, min(512, CELLS // max(b.rows for b in blocks)))
        for batch in batches:
            ids = batch.column("doc_id")
            no_id = np.array(ids.is_null())
            ids = np.array(ids.fill_null(0))
            size = np.array(batch.column("size"))
            at, times = batch.column("terms"), batch.column("times")
            ends = np.concatenate([[0], np.cumsum(at.value_lengths().fill_null(0))])
            at, times = np.array(at.flatten()), np.array(times.flatten())
            weight = 10 + 90 * size * count // max(length, 1)
            for a in range(0, len(ids), width):
                b = min(a + width, len(ids))
                own = slice(ends[a], ends[b])
                doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                n = times[own]
                given = np.zeros((len(words), b - a), np.int64)
                given[at[own], doc] = weights[at[own]] * (
                    1_000_000_000 * n // (1000 * n + 8 * weight[a:b][doc])
                )
                for block, top in zip(blocks, best, strict=True):
                    top.add(block.scores(given[block.wave]), ids[a:b], no_id[a:b])
        for block, top in zip(blocks, best, strict=True):
            if not top.found:
                continue
            item, score, no_id, ids = top.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.items[i] for i in item], pa.string()),
                 pa.array(ids, pa.int64(), mask=no_id), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"],
            )

    return run


def _waves(blocks: DataFrame) -> Iterator[list[int]]:
    """Numbers of blocks that are handed out together."""
    wave, volume = [], 0
    for row in blocks.select("block", "volume").orderBy("block").toLocalIterator():
        if wave and volume + row["volume"] > WAVE_BYTES:
            yield wave
            wave, volume = [], 0
        wave.append(row["block"])
        volume += row["volume"]
    if wave:
        yield wave


def _wave(spark: SparkSession, docs: DataFrame, rows: list, k: int) -> DataFrame:
    words = sorted({bytes(t) for r in rows for t in r["terms"]})
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.col("text").cast("binary").alias("text"))
    postings = stored(
        texts.mapInArrow(
            _postings(spark.sparkContext.broadcast(words)),
            "doc_id bigint, size bigint, terms array<int>, times array<bigint>",
        ),
        "postings",
    )
    count, length = postings.agg(F.count_if(F.col("size") > 0), F.coalesce(F.sum("size"), F.lit(0))).first()
    # At most one row per term of the wave.
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )
    weights = np.zeros(len(words), np.int64)
    for term, n in held.collect():
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1)))
    shared = spark.sparkContext.broadcast((rows, words, weights))
    found = postings.where(F.size("terms") > 0).mapInArrow(
        _scored(shared, k, count, length), "item string, doc_id bigint, score bigint"
    )
    return stored(found, "best")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best per item; first within groups of tasks, so that no task ranks what all have sent."""
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("some", F.spark_partition_id() % 64)
    for keys in (["item", "some"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k documents of the highest scores above zero of each
    item; documents are ``(doc_id, text)``, items ``(item_id, text)``."""
    spark = docs.sparkSession
    kind = items.schema[key].dataType
    blocks = stored(mined_blocks(items.select(marked(key).alias("item"), "text")), "blocks")
    found = None
    for wave in _waves(blocks):
        rows = [r.asDict() for r in blocks.where(F.col("block").between(wave[0], wave[-1])).collect()]
        more = _wave(spark, docs, rows, k)
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "item string, doc_id bigint, score bigint")
    own: Column = F.when(F.col("item") != "-", F.substring("item", 2, 1 << 30)).cast(kind)
    return _ranked(found, k).select(own.alias(key), "rank", "doc_id", "score")
