"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (positives) and plain documents (unlabelled) train linear classifiers
over hashed words and word beginnings with numpy. With the share of toxic documents ``prior``, the
risk is

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

the part under max being the risk of the negatives hidden among the unlabelled; where a batch
drives it below zero the step goes up that part instead. One classifier learns per bag of unlabelled
documents, each in a task of its own; the score is the mean of theirs.

Labels are learnt from a bounded sample (``POSITIVES``, ``UNLABELLED``) of documents outside the
held-out fold; the prior is the share of toxic labels outside that fold. Labels, language, source
and id are never inputs of a score: it depends on the whole text only. Every text is scored whole,
by a map without a shuffle.

Defined cases: null and empty texts score as texts without words; a label that is null is none,
a document with several labels is toxic if one says so; rows that share an id are scored each by its
text; rows without an id are scored, belong to no fold and have no label; without positives every
score is the prior (0 if there are no labels). Other columns are kept by ``without_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.llm.tables import stored

POSITIVES = 10_000
UNLABELLED = 20_000
BAGS = 4
#: Size of the hashed feature space, and how many features a classifier uses.
SPACE_BITS = 22
FEATURES = 4096
#: Least log-likelihood ratio of a used feature: chance passes it about once in a million features.
EVIDENCE = 24.0
#: Beginnings of words, in bytes, that are features beside the whole words.
BEGINNINGS = (4, 5, 6, 7)
STEPS, RATE, SHRINK = 300, 0.05, 1e-4
THRESHOLD = 0.3
#: Bytes hashed at once.
PIECE = 1 << 19

# Letters in lower case; all else parts words. Bytes of letters beyond ASCII count as letters.
_LOWER = np.zeros(256, np.uint64)
_LOWER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LOWER[128:] = np.arange(128, 256)
_BASE = 0x100000001B3
_UNBASE = pow(_BASE, -1, 2**64)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = (np.full(PIECE + 2, x, np.uint64) for x in (_BASE, _UNBASE))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - SPACE_BITS)).astype(np.int32)


def _piece_features(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and feature of every word and word beginning of the bytes."""
    b = _LOWER[np.frombuffer(joined, np.uint8)]
    letter = np.concatenate([[False], b > 0, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)])])
    at, by = sums[start], down[start]
    where, found = [start], [_mixed((sums[end] - at) * by, 1)]
    for n in BEGINNINGS:
        longer = end - start > n
        some = start[longer]
        where.append(some)
        found.append(_mixed((sums[some + n] - at[longer]) * by[longer], 2 + n))
    return np.concatenate(where), np.concatenate(found)


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end between words, if there is a word edge to end at."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
        cut = cut if cut > at else end
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position of the text, feature), some repeated, run by run of the texts."""
    run: list[bytes] = []
    of: list[int] = []
    size = 0

    def settle():
        where, found = _piece_features(b"\n".join(run))
        ends = np.cumsum([len(t) + 1 for t in run])
        return np.array(of)[np.searchsorted(ends, where, side="right")], found

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").encode()):
            if run and size + len(piece) + 1 > PIECE:
                yield settle()
                run, of, size = [], [], 0
            run.append(piece)
            of.append(i)
            size += len(piece) + 1
    if run:
        yield settle()


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row.astype(np.int64) << SPACE_BITS | feature)
    return both >> SPACE_BITS, both & ((1 << SPACE_BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and kind, summed over the task."""
    sums = np.zeros((2, 1 << SPACE_BITS), np.int32)
    for batch in batches:
        positive = np.array(batch.column("positive").to_pylist(), bool)
        for row, feature in features(batch.column("text").to_pylist()):
            row, feature = _distinct(row, feature)
            for k in (0, 1):
                np.add.at(sums[k], feature[positive[row] == bool(k)], 1)
    some = np.flatnonzero(sums.any(0))
    for at in range(0, len(some), 50_000):
        part = some[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(sums[1][part], pa.int64()),
             pa.array(sums[0][part], pa.int64())],
            names=["feature", "in_positive", "in_unlabelled"],
        )


class Hits:
    """Positions, in the list of used features, of those a text has."""

    def __init__(self, used: np.ndarray):
        self.place = np.full(1 << SPACE_BITS, -1, np.int32)
        self.place[used] = np.arange(len(used))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, feature in features(texts):
            place = self.place[feature]
            hit = place >= 0
            rows.append(row[hit])
            places.append(place[hit])
        return _distinct(np.concatenate(rows), np.concatenate(places))


def _examples(used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(used)
        for batch in batches:
            row, place = hits(batch.column("text").to_pylist())
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("positive"), lists],
                names=["doc_id", "positive", "has"],
            )

    return run


def fit_nonnegative(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float
) -> np.ndarray:
    """Weights of ``n`` features, and last the offset, by the non-negative risk.

    Examples are lists of the features they have; full-batch steps of Adam.
    """
    def flat(examples):
        sizes = [len(x) for x in examples]
        cols = np.concatenate([*examples, np.zeros(0, np.int64)]).astype(np.int64)
        return np.repeat(np.arange(len(examples)), sizes), cols, len(examples)

    def values(w, rows, cols, m):
        return w[n] + np.bincount(rows, w[cols], minlength=m)

    def slope(g, rows, cols):
        return np.append(np.bincount(cols, g[rows], minlength=n), g.sum())

    p, u = flat(positive), flat(unlabelled)
    w, m1, m2 = (np.zeros(n + 1) for _ in range(3))
    w[n] = np.log(prior / (1 - prior))
    for step in range(1, STEPS + 1):
        fp, fu = values(w, *p), values(w, *u)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        hidden = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = slope(su / u[2], *u[:2]) - prior * slope(sp / p[2], *p[:2])
        g = prior * slope((sp - 1) / p[2], *p[:2]) + down if hidden >= 0 else -down
        g[:n] += SHRINK * w[:n]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w


def _bag(n: int, prior: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["positive", "doc_id"])
        examples = [np.asarray(x, np.int64) for x in rows["has"]]
        positive = rows["positive"].to_numpy(bool)
        chosen = [[x for x, y in zip(examples, positive, strict=True) if y == k] for k in (1, 0)]
        if not all(chosen):
            return pd.DataFrame({"bag": [], "weights": []})
        weights = fit_nonnegative(*chosen, n, prior)
        return pd.DataFrame({"bag": [int(rows["bag"].iat[0])], "weights": [weights.tolist()]})

    return run


def held_out(key: Column) -> Column:
    """Whether a document is in the fold whose labels are not learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``(doc_id, positive, text)`` of the bounded sample, and the class prior."""
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    draw = F.xxhash64(F.lit(5), "doc_id")
    toxic = known.where("toxic = 1").select("doc_id").orderBy(draw, "doc_id").limit(POSITIVES)
    fraction = min(1.0, 1.2 * UNLABELLED / max(1, docs.count()))
    plain = docs.select("doc_id").where(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
        & (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(fraction * (1 << 30)))
    ).distinct().orderBy(draw, "doc_id").limit(UNLABELLED)
    # At most POSITIVES + UNLABELLED numbers.
    ids = toxic.withColumn("positive", F.lit(True)).union(
        plain.withColumn("positive", F.lit(False))
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return chosen.dropDuplicates(["doc_id", "positive"]).select("doc_id", "positive", "text"), share


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Used features, one row of weights per bag, and the prior."""
    sample, share = _sample(docs, labels)
    sample = stored(sample, "learn")
    sizes = dict(sample.groupBy("positive").count().collect())
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros((0, 1)), share
    prior = min(max(share, 1e-3), 0.5)
    counts = sample.select("positive", "text").mapInArrow(
        _count, "feature int, in_positive bigint, in_unlabelled bigint"
    ).groupBy("feature").agg(F.sum("in_positive").alias("p"), F.sum("in_unlabelled").alias("u"))
    def surprise(found: str, size: int) -> Column:
        expected = (F.col("p") + F.col("u")) * (size / (n_p + n_u))
        return F.when(F.col(found) > 0, F.col(found) * F.log(F.col(found) / expected)).otherwise(0)

    evidence = counts.withColumn("g", 2 * (surprise("p", n_p) + surprise("u", n_u)))
    best = evidence.where(F.col("g") >= EVIDENCE).orderBy(F.desc("g"), "feature").limit(FEATURES)
    used = np.array(sorted(r[0] for r in best.select("feature").collect()), np.int64)
    examples = sample.mapInArrow(_examples(used), "doc_id bigint, positive boolean, has array<int>")
    bag = F.explode(
        F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(BAGS - 1)))
        .otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.lit(BAGS)).cast("int")))
    )
    fitted = examples.withColumn("bag", bag).groupBy("bag").applyInPandas(
        _bag(len(used), prior), "bag int, weights array<double>"
    )
    weights = np.array([r.weights for r in sorted(fitted.collect())])
    return used, weights.reshape(-1, len(used) + 1), share


def _scorer(used: np.ndarray, weights: np.ndarray, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(used)
        for batch in batches:
            n = batch.num_rows
            if len(weights):
                row, place = hits(batch.column("text").to_pylist())
                parts = [
                    1 / (1 + np.exp(-(w[-1] + np.bincount(row, w[place], minlength=n))))
                    for w in weights
                ]
                score = np.mean(parts, 0)
            else:
                score = np.full(n, share)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names), pa.array(score, pa.float64())],
                names=[*batch.schema.names, "score"],
            )

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``score``, the likelihood of label 1."""
    used, weights, share = train(docs, labels)
    kept = docs.drop("score")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_scorer(used, weights, share), f"{names}, score double")


def without_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents whose score is below the threshold."""
    found = scored(docs.withColumnRenamed("score", "__score"), labels)
    return found.where(F.col("score") < threshold).drop("score").withColumnRenamed(
        "__score", "score"
    )
