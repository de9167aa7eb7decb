"""Packing documents into sequences: best-fit within a grouping genetic algorithm.

Documents become token ids and a closing id. Longer ones are cut into pieces of the capacity, the
first of which may be shorter; a piece of full length is a sequence of its own. The others are dealt
by a hash into cells of about ``CELL`` pieces. In each cell some islands evolve packings: a child
takes whole well-filled bins of one parent, the bins of the other parent that hold any of the same
pieces go, and the pieces this displaces are put, longest first, where they fit best. After each
epoch an island's elite, its best packing, also migrates to the next island of the ring. The best
packing of the islands counts. Bins that stay slack in all this are opened again and their pieces
dealt into fewer cells, until one cell is left or this gains nothing.

A cell, an island and an epoch are rows of one group of bounded size; cells grow in number with the
data, never in size. Rows that move are numbers, not texts; what was tokenised is kept once.

Defined cases: a null or empty text has the closing id only; repeated rows and equal ids are pieces
of their own; extra columns are ignored unless named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipweave.llm.tables import stored

CAPACITY = 1024
END = 2
CELL = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 10
POPULATION = 5
#: Bins filled less than this share are opened again in the next level.
SLACK = 0.98
#: Words whose ids a task remembers; bounds its memory.
REMEMBERED = 300_000

# The white space pattern of byte-level vocabularies, a fixed value.
_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_ODD = re.compile(r"\s |^ ")
_ODD_ASCII = tuple(c + " " for c in " \n\t\r\v\f\x1c\x1d\x1e\x1f")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _tokenizers(path: str):
    """The vocabulary of the file for whole texts, and a quicker reader of the same for words."""
    import json
    import os

    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True  # their names in a text are ordinary text
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model["added_tokens"] if t["special"]}
    letters = _byte_letters()
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in model["model"]["vocab"].items() if token not in special
    }
    return whole, tiktoken.Encoding(
        "words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}
    )


class Encoder:
    """Ids of whole texts, with the ids of words remembered.

    Tokens never reach over the edge between a character and white space after it, so a text is
    the sum of its words, each with the one space before it. Texts with runs of white space are
    encoded in one go.
    """

    def __init__(self, path: str):
        self.whole, words = _tokenizers(path)
        self.encode = words.encode_ordinary
        self.known: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(self.known) < REMEMBERED:  # common words come early
            self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if _odd(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _with_space(text)
        known, new = self.known.get, self._new
        return b"".join([known(w) or new(w) for w in words])


def _odd(text: str) -> bool:
    """Is there white space before a space, or a space at the start?"""
    if text.isascii():
        return text[0] == " " or any(s in text for s in _ODD_ASCII)
    return _ODD.search(text) is not None


def _with_space(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *[" " + w for w in rest]]


def _cutter(path: str, capacity: int, end: int, keep: list[pa.Field]):
    schema = pa.schema([
        *keep, ("item", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids", pa.binary()),
    ])
    last = np.array([end], "<u4").tobytes()

    def rows(columns: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            kept = [batch.column(f.name).to_pylist() for f in keep]
            out: list[list] = [[] for _ in schema]
            for i, text in enumerate(batch.column("__text")):
                ids = encode(text.as_py() or "") + last
                total = len(ids) // 4
                start, size = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    row = (
                        *[c[i] for c in kept], item, piece, start, size,
                        ids[4 * start : 4 * (start + size)],
                    )
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    item, piece, start, size = item + 1, piece + 1, start + size, capacity
                    if len(out[0]) == 4096:
                        yield rows(out)
                        out = [[] for _ in schema]
            if out[0]:
                yield rows(out)

    return run


def pieces(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """The columns of ``keep`` with ``item`` (a number of its own), ``piece``, ``start``,
    ``length`` and ``ids`` (binary) per piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(*keep, F.col(text).alias("__text"))
    fields = list(to_arrow_schema(docs.select(*keep).schema))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(
        _cutter(path, capacity, end, fields),
        f"{names}, item bigint, piece int, start bigint, length bigint, ids binary",
    )


class _Bins:
    """Open bins by the room left in them; finds the one with the least room that suffices."""

    def __init__(self, capacity: int, room: dict[int, int], next_bin: int):
        self.capacity, self.next = capacity, next_bin
        self.stacks: dict[int, list[int]] = {}
        self.mask = 0
        for b, r in room.items():
            self._put(b, r)

    def _put(self, b: int, room: int) -> None:
        self.stacks.setdefault(room, []).append(b)
        self.mask |= 1 << room

    def fit(self, length: int) -> int:
        above = self.mask >> length
        if not above:
            b, room = self.next, self.capacity
            self.next += 1
        else:
            room = length + (above & -above).bit_length() - 1
            stack = self.stacks[room]
            b = stack.pop()
            if not stack:
                self.mask ^= 1 << room
        self._put(b, room - length)
        return b


def best_fit(lengths: np.ndarray, order, bins: np.ndarray, capacity: int) -> np.ndarray:
    """``bins`` with the items of ``order``, so far in no bin (-1), put where they fit best."""
    placed = bins >= 0
    filled = np.bincount(bins[placed], lengths[placed]).astype(int) if placed.any() else []
    room = {b: capacity - int(f) for b, f in enumerate(filled) if 0 < f < capacity}
    open_bins = _Bins(capacity, room, len(filled))
    for i in order:
        bins[i] = open_bins.fit(int(lengths[i]))
    return bins


def cost(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Bins used, less a part below one that grows as full and slack bins part."""
    filled = np.bincount(bins, lengths)
    filled = filled[filled > 0] / capacity
    return len(filled) - float((filled**2).mean()) if len(filled) else 0.0


def _dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def child_of(
    lengths: np.ndarray, taker: np.ndarray, giver: np.ndarray, capacity: int,
    rng: np.random.Generator,
) -> np.ndarray:
    """The taker with some well-filled bins of the giver in place of what holds their items."""
    filled = np.bincount(giver, lengths)
    good = np.flatnonzero(filled >= np.quantile(filled, 0.4))
    given = good[rng.random(len(good)) < rng.uniform(0.1, 0.5)]
    injected = np.isin(giver, given)
    own = np.bincount(taker, lengths)
    slack = np.flatnonzero(own < np.quantile(own, 0.05)) if len(own) > 1 else []
    broken = np.union1d(np.unique(taker[injected]), slack)
    displaced = np.isin(taker, broken) & ~injected
    bins = np.where(injected, giver + taker.max() + 1, taker)
    bins[displaced] = -1
    kept = bins >= 0
    bins[kept] = _dense(bins[kept])
    loose = np.flatnonzero(displaced)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    return _dense(best_fit(lengths, order, bins, capacity))


def evolve(
    lengths: np.ndarray, elites: list[np.ndarray], capacity: int, rng: np.random.Generator,
    generations: int = GENERATIONS,
) -> np.ndarray:
    """The best packing after some generations, from the elites and fresh best-fit packings."""
    population = [_dense(e) for e in elites]
    while len(population) < POPULATION:
        noise = 1 + (0.1 if population else 0.0) * rng.standard_normal(len(lengths))
        order = np.argsort(-lengths * noise, kind="stable")
        empty = np.full(len(lengths), -1)
        population.append(_dense(best_fit(lengths, order, empty, capacity)))
    costs = [cost(lengths, p, capacity) for p in population]
    lower = -(-int(lengths.sum()) // capacity)
    for _ in range(generations):
        if min(costs) < lower:  # as few bins as there can be
            break
        a, b = rng.choice(len(population), 2, replace=False)
        child = child_of(lengths, population[a], population[b], capacity, rng)
        c, worst = cost(lengths, child, capacity), int(np.argmax(costs))
        if c < costs[worst]:
            population[worst], costs[worst] = child, c
    return population[int(np.argmin(costs))]


_STATE = "cell bigint, island int, origin int, item bigint, length bigint, bin int, cost double"


def _epoch(capacity: int, level: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(key[0]), int(key[1])
        rng = np.random.default_rng([cell, island, level, epoch])
        rows = rows.sort_values(["origin", "item"])
        first = rows[rows["origin"] == rows["origin"].iat[0]]
        lengths = first["length"].to_numpy(np.int64)
        elites = [g["bin"].to_numpy(np.int64) for _, g in rows.groupby("origin")] if epoch else []
        best = evolve(lengths, elites, capacity, rng)
        return pd.DataFrame({
            "cell": cell, "island": island, "origin": island, "item": first["item"].to_numpy(),
            "length": lengths, "bin": best, "cost": cost(lengths, best, capacity),
        })

    return run


def _best_of_islands(loose: DataFrame, cells: int, capacity: int, level: int) -> DataFrame:
    """``(cell, item, length, bin, filled)`` by the best island of each cell."""
    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))
    state = loose.select(
        F.pmod(F.xxhash64("item", F.lit(level)), F.lit(cells)).alias("cell"), "item", "length",
        islands.alias("island"), F.lit(0).alias("origin"), F.lit(-1).alias("bin"),
    )
    for epoch in range(EPOCHS):
        if epoch:
            onward = F.array(F.col("origin"), (F.col("origin") + 1) % ISLANDS)
            state = state.withColumn("island", F.explode(onward))
        state = state.groupBy("cell", "island").applyInPandas(_epoch(capacity, level, epoch), _STATE)
    in_cell = Window.partitionBy("cell").orderBy("cost", "island")
    best = state.withColumn("place", F.rank().over(in_cell)).where("place = 1")
    in_bin = Window.partitionBy("cell", "bin")
    return best.select("cell", "item", "length", "bin", F.sum("length").over(in_bin).alias("filled"))


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(item, sequence_id)`` of kept pieces ``(item, length)``."""
    full = found.where(F.col("length") == capacity)
    done = full.select("item", (-1 - F.col("item")).alias("sequence_id"))
    loose = found.where(F.col("length") < capacity).select("item", "length")
    level = 0
    while True:
        n = loose.count()
        if not n:
            return done
        cells = -(-n // CELL)
        best = stored(_best_of_islands(loose, cells, capacity, level), "cells")
        slack = best.where(F.col("filled") < SLACK * capacity)
        more = slack.count() if cells > 1 else 0
        again = 0 < more <= n / 2
        closed = best.where(F.col("filled") >= SLACK * capacity) if again else best
        number = F.expr(f"shiftleft({level}L, 56) + shiftleft(cell, 24) + bin")
        done = done.union(closed.select("item", number.alias("sequence_id")))
        if not again:
            return done
        loose, level = slack.select("item", "length"), level + 1


def pack(
    docs: DataFrame, path: str, keep: list[str], text: str = "text", capacity: int = CAPACITY,
    end: int = END, with_ids: bool = True,
) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``, its place there, gapless from 0; with its
    token ids as binary, or else only their CRC-32."""
    found = pieces(docs, path, keep, text, capacity, end)
    found = found.withColumn("ids_crc32", F.crc32("ids"))
    found = stored(found if with_ids else found.drop("ids"), "pieces")
    placed = found.join(packed(found, capacity), "item")
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return placed.withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0))
    ).drop("item")
