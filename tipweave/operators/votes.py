"""Like and dislike counters that never fall below zero.

``v_n = max(0, v_{n-1} + x_n)`` from start ``c`` equals ``S_n + max(c, -min_k S_k)`` with the
running sums S. The pair (sum, smallest running sum) of a stretch of events composes with the next
stretch, so a hot item is cut into ranges of its sequence numbers: windows run inside a range, and
only one row per range is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.functions.text import blank, non_blank, strip
from tipweave.operators.sequence import RANGE_WIDTH

ITEM = ("item_type", "item_key")
STATES = ("none", "like", "dislike")
COUNTERS = {"likes": "like", "dislikes": "dislike"}


def _state(c: Column) -> Column:
    return F.coalesce(non_blank(strip(blank(c))), F.lit("none"))


def transitions(events: DataFrame) -> DataFrame:
    """Valid events with their steps; events with an unknown state are dropped."""
    prev, new = _state(F.col("prev")), _state(F.col("next"))
    steps = {
        f"d_{counter}": (new == state).cast("long") - (prev == state).cast("long")
        for counter, state in COUNTERS.items()
    }
    return events.filter(prev.isin(*STATES) & new.isin(*STATES)).withColumns(steps)


def known_targets(events: DataFrame, items: DataFrame) -> DataFrame:
    return events.join(items.select(*ITEM).distinct(), list(ITEM), "left_semi")


def clean_state(state: DataFrame) -> DataFrame:
    """Stored counters with missing and negative values read as zero."""
    return state.groupBy(*ITEM).agg(
        *[F.max(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))).alias(c) for c in COUNTERS]
    )


def _running(events: DataFrame, width: int) -> DataFrame:
    cut = transitions(events).withColumn("_range", F.floor(F.col("seq") / width).cast("long"))
    inside = (
        Window.partitionBy(*ITEM, "_range").orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = cut.withColumns({f"_s_{c}": F.sum(f"d_{c}").over(inside) for c in COUNTERS})
    return summed.withColumns({f"_m_{c}": F.min(f"_s_{c}").over(inside) for c in COUNTERS})


def _ranges(running: DataFrame) -> DataFrame:
    return running.groupBy(*ITEM, "_range").agg(
        *[F.sum(f"d_{c}").alias(f"sum_{c}") for c in COUNTERS],
        *[F.min(f"_m_{c}").alias(f"low_{c}") for c in COUNTERS],
        F.max(F.greatest(*[F.abs(F.col(f"d_{c}")) for c in COUNTERS])).alias("moved"),
    )


def _carried(ranges: DataFrame, state: DataFrame) -> DataFrame:
    """Per range the counters at its start, and what the range adds."""
    order = Window.partitionBy(*ITEM).orderBy("_range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = ranges.withColumns(
        {f"_before_{c}": F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)) for c in COUNTERS}
    )
    lows = upto.withColumns(
        {
            f"_low_{c}": F.min(F.col(f"_before_{c}") + F.col(f"low_{c}")).over(before)
            for c in COUNTERS
        }
    )
    started = lows.join(clean_state(state), list(ITEM), "left")
    return started.select(
        *ITEM,
        "_range",
        "moved",
        *[F.col(f"{k}_{c}") for c in COUNTERS for k in ("sum", "low")],
        *[
            (
                F.col(f"_before_{c}")
                + F.greatest(F.coalesce(F.col(c), F.lit(0)), -F.coalesce(F.col(f"_low_{c}"), F.lit(0)))
            ).alias(f"start_{c}")
            for c in COUNTERS
        ],
    )


def vote_history(events: DataFrame, state: DataFrame, width: int = RANGE_WIDTH) -> DataFrame:
    """Counters after every valid event."""
    running = _running(events, width)
    starts = _carried(_ranges(running), state).select(
        *ITEM, "_range", *[f"start_{c}" for c in COUNTERS]
    )
    return running.join(starts, [*ITEM, "_range"]).select(
        *ITEM,
        "seq",
        *[
            (F.col(f"_s_{c}") + F.greatest(F.col(f"start_{c}"), -F.col(f"_m_{c}"))).alias(c)
            for c in COUNTERS
        ],
    )


def apply_votes(events: DataFrame, state: DataFrame, width: int = RANGE_WIDTH) -> DataFrame:
    """State after all events. An item without a stored row appears once a vote changes it."""
    carried = _carried(_ranges(_running(events, width)), state)
    last = carried.groupBy(*ITEM).agg(
        F.max("moved").alias("_moved"),
        *[
            F.max_by(
                F.col(f"sum_{c}") + F.greatest(F.col(f"start_{c}"), -F.col(f"low_{c}")), "_range"
            ).alias(f"_{c}")
            for c in COUNTERS
        ],
    )
    return (
        clean_state(state)
        .join(last.filter("_moved > 0"), list(ITEM), "full")
        .select(*ITEM, *[F.coalesce(f"_{c}", c, F.lit(0)).alias(c) for c in COUNTERS])
    )


def with_votes(items: DataFrame, votes: DataFrame, item_type: str, key: str) -> DataFrame:
    """Catalogue rows with their counters; items without votes get zero."""
    mine = (
        clean_state(votes.filter(F.col("item_type") == item_type))
        .drop("item_type")
        .withColumnRenamed("item_key", key)
    )
    return items.join(mine, key, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS}
    )


def orphan_votes(votes: DataFrame, items: DataFrame, item_type: str, key: str) -> DataFrame:
    """Counters whose item is gone, as after a phone edit changed its key."""
    keys = items.select(F.col(key).alias("item_key")).distinct()
    return votes.filter(F.col("item_type") == item_type).join(keys, "item_key", "left_anti")
