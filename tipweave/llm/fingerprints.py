"""Fingerprint every document, an edited form of it, and compare it with its successor.

Successors are neighbours in one total order. Rows are dealt to ranges of that order and sorted in
each; a task then walks its range once, batch by batch, and holds back one row. Only the last row
of a range needs the first row of the next one: these two rows per range are kept aside and joined
by the number of the range. A text moves once, and no task holds more than a batch and one row.

Defined cases: a null text is an empty one; rows without an id stand last; rows with one id are
ordered by a hash of their text, and equal rows follow each other; the last row's successor is the
first row, which is the row itself if there is only one; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm import digests
from tipweave.llm.tables import stored

RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double"
)
RESULT_BATCH = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
WALKED = pa.schema([
    *RESULT_BATCH, ("kind", pa.string()), ("range", pa.int32()), ("text", pa.string())
])
#: Texts fingerprinted at once; bounds the memory whatever the size of an Arrow batch.
GROUP = 256


def edited(text: str, successor: str) -> str:
    """The text with its last half replaced by as many first characters of the successor."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def _compared(ids, texts, codes, next_texts, next_codes) -> dict[str, list]:
    new = [edited(a, b).encode() for a, b in zip(texts, next_texts, strict=True)]
    new_codes = digests.codes(new)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in new],
        "fingerprint": digests.written(codes),
        "edited_fingerprint": digests.written(new_codes),
        "near_edited": digests.likeness(codes, new_codes),
        "near_next": digests.likeness(codes, next_codes),
    }


def _batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    """The columns as a batch; those that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here = TaskContext.get().partitionId()
    ids, texts, codes = [], [], np.zeros((0, digests.BUCKETS + 1), np.uint8)

    def end(kind: str) -> pa.RecordBatch:
        i = 0 if kind == "first" else -1
        return _batch(
            WALKED, {"doc_id": [ids[i]], "kind": [kind], "range": [here], "text": [texts[i]]}
        )

    started = False
    for batch in batches:
        for at in range(0, batch.num_rows, GROUP):
            part = batch.slice(at, GROUP)
            more = [t or "" for t in part.column("text").to_pylist()]
            ids += part.column("doc_id").to_pylist()
            texts += more
            codes = np.concatenate([codes, digests.codes([t.encode() for t in more])])
            if not started:
                yield end("first")
                started = True
            if len(ids) > 1:
                done = _compared(ids[:-1], texts[:-1], codes[:-1], texts[1:], codes[1:])
                n = len(ids) - 1
                yield _batch(WALKED, done | {"kind": ["row"] * n, "range": [here] * n})
            ids, texts, codes = ids[-1:], texts[-1:], codes[-1:]
    if started:
        yield end("last")


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, after = (batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text"))
        codes = digests.codes([t.encode() for t in texts])
        next_codes = digests.codes([t.encode() for t in after])
        yield _batch(RESULT_BATCH, _compared(ids, texts, codes, after, next_codes))


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``RESULT`` for every document, with successors in descending order of the key."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    walked = stored(
        dealt.mapInArrow(_walk, f"{RESULT}, kind string, range int, text string"), "walked"
    )
    first, last = (walked.where(F.col("kind") == k) for k in ("first", "last"))
    # One number per range of the order, as many as the shuffle has partitions.
    ranges = sorted(r[0] for r in first.select("range").collect())
    after = dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))
    done = walked.where(F.col("kind") == "row").select(*RESULT_BATCH.names)
    if not after:
        return done
    following = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])
    ends = last.select("doc_id", "text", following[F.col("range")].alias("range")).join(
        first.select("range", F.col("text").alias("next_text")), "range"
    )
    return done.union(ends.drop("range").mapInArrow(_closed, RESULT))
