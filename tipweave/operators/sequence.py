"""Ordered work inside a group that may hold a third of all rows.

A window over a whole chat or item is one task. Everything here cuts a group by ranges of its
integer order column first, works inside the ranges, and carries a small summary across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipweave.runtime import durable

RANGE_WIDTH = 1 << 18


def _range_of(seq: str, width: int) -> Column:
    return F.floor(F.col(seq) / F.lit(width)).cast("long")


def renumber(
    df: DataFrame, keys: Sequence[str], seq: str, out: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Add ``out`` = 0, 1, 2, … per key in the order of the distinct integers in ``seq``."""
    cut = df.withColumn("_range", _range_of(seq, width))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(seq)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(starts, [*keys, "_range"])
        .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_range", "_rn", "_start")
    )


def numbered(rows: DataFrame, order: list[str | Column], out: str = "seq") -> DataFrame:
    """A distinct integer per row that follows ``order``.

    Rows are sorted into ranges and numbered inside them; ranges are as even as the data allows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn(out, F.monotonically_increasing_id())


def placed(rows: DataFrame, order: Sequence[str | Column], out: str = "place") -> DataFrame:
    """Add ``out`` = 0, 1, 2, … over all rows in ``order``, so that an order shows in the rows.

    Rows are kept sorted by ranges, and the sizes of the earlier ranges (one row per range) are
    added. The order should end with a column that tells equal rows apart.
    """
    # The number of a row holds its range above bit 33.
    kept = durable(numbered(rows, [*order], "_at"))
    return renumber(kept, [], "_at", out, 1 << 33).drop("_at")


def around(
    rows: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    seq: str,
    row_id: str,
    payload: Column,
    before: int,
    after: int,
) -> DataFrame:
    """The payloads of the ``before`` rows before and ``after`` rows after each wanted row.

    For wanted rows that are sparse: each asks for its neighbours by number, so the cost follows
    the wanted rows and no group is ever sorted. ``seq`` must be dense (see ``renumber``).
    Returns one row per wanted row with ``ctx_before`` and ``ctx_after``, oldest first.
    """
    offsets = [o for o in range(-before, after + 1) if o]
    asked = wanted.select(
        *keys, row_id, F.col(seq).alias("_at"), F.explode(F.lit(offsets)).alias("_offset")
    ).withColumn(seq, F.col("_at") + F.col("_offset"))
    found = asked.join(rows.select(*keys, seq, payload.alias("_payload")), [*keys, seq])
    sides = found.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.struct("_offset", "_payload"))).alias("_near")
    )
    payload_type = rows.select(payload).schema[0].dataType
    none = F.array().cast(T.ArrayType(payload_type))

    def side(keep):
        near = F.transform(F.filter("_near", keep), lambda n: n["_payload"])
        return F.coalesce(near, none)

    return wanted.join(sides, row_id, "left").select(
        *[wanted[c] for c in wanted.columns],
        side(lambda n: n["_offset"] < 0).alias("ctx_before"),
        side(lambda n: n["_offset"] > 0).alias("ctx_after"),
    )


def with_frames(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    frames: dict[str, tuple[int, int, callable]],
    width: int = 4096,
) -> DataFrame:
    """Window aggregates over small row frames for every row, in bounded partitions.

    ``frames`` maps an output name to (first offset, last offset, window -> Column). Each range of
    ``width`` rows also gets copies of the rows just outside it, so the frames at its edges are
    complete; with dense ``seq`` the result equals a window over the whole group.
    """
    back = max(0, -min(first for first, _, _ in frames.values()))
    ahead = max(0, max(last for _, last, _ in frames.values()))
    home = _range_of(seq, width)
    place = F.col(seq) - home * width
    homes = F.array_compact(
        F.array(
            home,
            F.when(place >= width - back, home + 1),
            F.when(place < ahead, home - 1),
        )
    )
    spread = df.withColumn("_home", home).withColumn("_range", F.explode(homes))
    w = Window.partitionBy(*keys, "_range").orderBy(seq)
    for name, (first, last, make) in frames.items():
        spread = spread.withColumn(name, make(w.rowsBetween(first, last)))
    return spread.filter("_range = _home").drop("_range", "_home")
