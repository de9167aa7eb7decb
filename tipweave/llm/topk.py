"""Exact top-k by inner product: histograms of all scores narrow down each k-th score.

Every component becomes ``floor(1024 * x)``, so scores are whole numbers. All scores of a query lie
in an interval of ``2**b``; each pass scores everything, counts the scores per bin of the interval
that holds the k-th one, adds the counts of all tasks, and goes on in the bin where the count from
the top reaches k. When bins are one score wide, that score is the exact threshold: a last pass
keeps what reaches it, and ties at the threshold go to the smaller ids.

Candidates are dealt into parts of a bounded number of values, each to a task of its own; the queries
go to every part. A task reads its part first and then takes the queries in blocks of ``QUERY_BLOCK``
against ``ROW_BLOCK`` of its rows by matrix products, so its memory is bounded whatever the sizes,
and a pass sends each candidate once, however many queries there are. A task sends only bins from
the top until its own count reaches k, which are all that can matter: the k-th score overall is no
smaller than the k-th score of any part.

Defined cases: rows whose id or vector is null, empty, or holds a null, NaN or infinite component
take no part; vectors of another length than the query's are no candidates of it; rows with the
query's id are its own and no candidates; each query row gets its own result, also where ids repeat;
equal candidate rows count each; scores that no long holds are clipped to ``MOST``. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.llm.tables import stored

QUERY_BLOCK = 512
ROW_BLOCK = 8192
#: Numbers in a part: 65,536 vectors of 64 components.
PART_VALUES = 1 << 22
#: Parts are smaller than that if there are fewer than cores, but not below so many rows.
PART_ROWS = 4096
#: Each pass splits the interval of every query into 2**BITS bins.
BITS = 11
#: Scores beyond what a long holds are clipped.
MOST = 2**63 - 1


def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))),
    )
    good = F.col(key).isNotNull() & (F.size(vector) > 0) & ~bad
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return rows.where(good).select(F.col(key).alias("id"), ints.alias("v"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length: the places of such rows in the batch, and their matrix."""
    v = batch.column("v")
    lengths, flat = np.array(pc.list_value_length(v)), np.array(v.flatten())
    starts = lengths.cumsum() - lengths
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, flat[starts[at][:, None] + np.arange(n)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64. Whole numbers below 2**53 are exact in doubles, for which there are
    fast matrix products; what may not fit a long is taken over Python's ints."""
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


class _Queries:
    """A block of query rows as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.q, self.id, self.low, self.above = (
            np.array(batch.column(c)) for c in ("q", "id", "low", "above")
        )
        self.of = {n: (at, m) for n, at, m in _by_length(batch)}

    def scores(self, part: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple]:
        """Places of queries, ids of candidates, their scores, and which are the query's own."""
        for n in self.of.keys() & part.keys():
            at, a = self.of[n]
            for ids, b in part[n]:
                yield at, ids, _product(a, b), self.id[at][:, None] == ids[None, :]


def _count(k: int, shift: int) -> Callable:
    """Counts per query and bin, from the top down to where the part's own count reaches k."""
    width = max(0, shift - BITS)
    bins = 1 << (shift - width)

    def count(queries: _Queries, part: dict) -> list[np.ndarray]:
        found = np.zeros((len(queries.q), bins), np.int64)
        for at, _, s, own in queries.scores(part):
            low = queries.low[at][:, None]
            # The difference of two longs may need 64 bits without a sign.
            bin_ = (s.view(np.uint64) - low.view(np.uint64)) >> np.uint64(width)
            ok = (s >= low) & (bin_ < bins) & ~own
            flat = (np.arange(len(at))[:, None] * bins + bin_.astype(np.int64))[ok]
            found[at] += np.bincount(flat, minlength=len(at) * bins).reshape(len(at), bins)
        need = k - queries.above
        down = found[:, ::-1].cumsum(1)[:, ::-1]
        i, b = np.nonzero((found > 0) & (down - found < need[:, None]))
        return [queries.q[i], b, found[i, b], need[i]]

    return count


def _select(k: int) -> Callable:
    """Of each query the part's best k that reach its threshold."""

    def select(queries: _Queries, part: dict) -> list[np.ndarray]:
        out = [(np.zeros(0, np.int64),) * 3]
        for at, ids, s, own in queries.scores(part):
            i, j = np.nonzero((s >= queries.low[at][:, None]) & ~own)
            order = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, np.arange(len(at)))
            best = np.arange(len(i)) - first[i] < k
            i, j = i[best], j[best]
            out.append((at[i], ids[j], s[i, j]))
        at, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return [queries.q[at], queries.id[at], ids, scores]

    return select


def _in_blocks(rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> list[tuple]:
    ids, matrix = (np.concatenate(x) for x in zip(*rows, strict=True))
    return [(ids[i : i + size], matrix[i : i + size]) for i in range(0, len(ids), size)]


def _met(function: Callable, names: list[str], query_block: int, row_block: int):
    """Each part's candidates, which come first, with its queries, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, part = None, {}, None
        for batch in batches:
            numbers, asks = np.array(batch.column("part")), np.array(batch.column("asks"))
            new = (numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                if numbers[a] != number:
                    number, held, part = numbers[a], {}, None
                some = batch.slice(a, b - a)
                if not asks[a]:
                    ids = np.array(some.column("id"))
                    for n, at, matrix in _by_length(some):
                        held.setdefault(n, []).append((ids[at], matrix))
                    continue
                if part is None:
                    part = {n: _in_blocks(x, row_block) for n, x in held.items()}
                    held = {}
                for at in range(0, len(some), query_block):
                    found = function(_Queries(some.slice(at, query_block)), part)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return run


def top_k(
    rows: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of each row with ``is_query``."""
    plain = stored(
        whole_vectors(rows, key, vector, scale).withColumn("at", F.monotonically_increasing_id()),
        "vectors",
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_rows, values, most = plain.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))
    ).first()
    cores = plain.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-values // PART_VALUES), min(cores, -(-n_rows // PART_ROWS)), 1)
    # No component is greater than the root of the greatest norm.
    kind = "int" if most < 2.0**60 else "bigint"
    small = F.col("v").cast(f"array<{kind}>").alias("v")
    nothing = F.lit(0).cast("bigint")
    candidates = stored(
        plain.select(
            F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("asks"),
            F.col("id").cast("bigint").alias("id"), nothing.alias("q"), nothing.alias("low"),
            nothing.alias("above"), small,
        ),
        "candidates",
    )
    bound = min(int(math.ceil(most * (1 + 1e-9))) + 1, MOST)
    shift = (2 * bound).bit_length()
    state = plain.where(is_query).select(
        F.col("id").cast("bigint").alias("id"), F.col("at").alias("q"),
        F.lit(-(2 ** (shift - 1))).cast("bigint").alias("low"), nothing.alias("above"), small,
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")

    def meet(state: DataFrame, function: Callable, names: list[str]) -> DataFrame:
        asked = state.select(everywhere, F.lit(True).alias("asks"), "id", "q", "low", "above", "v")
        dealt = candidates.unionByName(asked).repartitionById(parts, F.col("part"))
        schema = ", ".join(f"{n} bigint" for n in names)
        task = _met(function, names, QUERY_BLOCK, ROW_BLOCK)
        return dealt.sortWithinPartitions("part", "asks").mapInArrow(task, schema)

    from_top = Window.partitionBy("q").orderBy(F.desc("bin"))
    while shift > 0:
        width = max(0, shift - BITS)
        counts = meet(state, _count(k, shift), ["q", "bin", "n", "need"])
        summed = counts.groupBy("q", "bin").agg(
            F.sum("n").alias("n"), F.first("need").alias("need")
        ).withColumn("down", F.sum("n").over(from_top))
        reached = summed.where("down >= need AND down - n < need").select(
            "q", "bin", (F.col("down") - F.col("n")).alias("more")
        )
        # A query with fewer than k candidates keeps its lower end, which all of them reach.
        up = F.coalesce("bin", F.lit(0)).cast("decimal(5,0)") * F.lit(Decimal(1 << width))
        state = stored(
            state.join(reached, "q", "left").select(
                "id", "q", (F.col("low").cast("decimal(20,0)") + up).cast("bigint").alias("low"),
                (F.col("above") + F.coalesce("more", F.lit(0))).alias("above"), "v",
            ),
            "thresholds",
        )
        shift = width
    best = meet(state, _select(k), ["q", "query_id", "vec_id", "score"])
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
