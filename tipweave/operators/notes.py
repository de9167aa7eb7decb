"""Folding the notes of repeated mentions into one ordered note per contact."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.operators.dictionary import grams
from tipweave.operators.sequence import placed
from tipweave.runtime import durable, join_facts

SEPARATOR = " | "
BAR = "|"
MAX_NOTES_PER_ROW = 512
PART_WIDTH = 4096
_LONG_GRAM = 8
_SHORT_GRAMS = (1, 2, 3)


def fold_notes(
    base: DataFrame,
    later: DataFrame,
    key: str,
    order: Sequence[str],
    note: str,
    max_notes: int = MAX_NOTES_PER_ROW,
) -> DataFrame:
    """Notes that stay after folding, one row each: ``key, order…, note``.

    ``base`` has one row per key, whose note always stays and comes first; a later note stays unless
    it is empty or the text of the earlier ones, joined by the separator, already says it. Equal notes
    are merged before anything is grouped. A key with up to ``max_notes`` different notes is folded in
    one row; the notes of a bigger key never meet in one place: each is compared, by a join on a rare
    run of letters, with the notes that can contain it, and one that holds separators also with
    runs of neighbouring notes. The result is the same either way.
    """
    base = durable(base.select(key, *order, note))
    texts = base.select(key, F.col(note).alias("_base"))
    said = later.filter(F.col(note) != "").join(texts, key)
    distinct = durable(
        said.filter(~F.contains("_base", F.col(note)))
        .groupBy(key, note)
        .agg(F.min(F.struct(*order)).alias("_order"))
    )
    sizes = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > max_notes).select(key)
    any_big = not big.isEmpty()
    few = distinct.join(big, key, "left_anti") if any_big else distinct

    folded = (
        few.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_order", F.col(note).alias("_note")))).alias("_all"))
        .join(texts, key)
    )
    kept_few = folded.select(key, F.explode(_keep_new("_base", "_all")).alias("_kept")).select(
        key, "_kept._order", F.col("_kept._note").alias(note)
    )
    first = base.select(key, F.struct(*order).alias("_order"), note)
    kept = first.unionByName(kept_few)
    if any_big:
        many = durable(distinct.join(big, key, "left_semi"))
        single = durable(_not_contained(many, key, "_order", note))
        kept = kept.unionByName(_not_across(first.join(big, key, "left_semi"), single, key, note))
    return kept.select(key, *[F.col(f"_order.{o}").alias(o) for o in order], note)


def _keep_new(base: str, notes: str) -> Column:
    start = F.struct(F.col(base).alias("text"), F.expr(f"slice({notes}, 1, 0)").alias("kept"))

    def step(acc: Column, n: Column) -> Column:
        known = F.contains(acc["text"], n["_note"])
        return F.struct(
            F.when(known, acc["text"])
            .otherwise(F.concat(acc["text"], F.lit(SEPARATOR), n["_note"]))
            .alias("text"),
            F.when(known, acc["kept"])
            .otherwise(F.concat(acc["kept"], F.array(n)))
            .alias("kept"),
        )

    return F.aggregate(notes, start, step, lambda acc: acc["kept"])


def _sorted_in(rows: DataFrame) -> DataFrame:
    """Rows of a size with the notes, to be joined by a sort: kept as a table, like notes are many
    times smaller than in memory, and the planner would send them whole through the driver."""
    return rows.hint("merge")


def _sizes(notes: DataFrame, note: str) -> list[int]:
    """The sizes of the runs that ``_rarest`` looks for; no text needs others."""
    size = F.least(F.length(note), F.lit(max(_SHORT_GRAMS)))
    wanted = F.when(F.length(note) >= _LONG_GRAM, _LONG_GRAM).otherwise(size)
    return sorted(r[0] for r in notes.select(wanted).distinct().collect())


def _runs(texts: DataFrame, keys: Sequence[str], text: Column, sizes: Sequence[int]) -> DataFrame:
    return texts.select(*keys, F.explode(grams(text, sizes)).alias("_run"))


def _rarest(notes: DataFrame, runs: DataFrame, key: str, order: str, note: str) -> DataFrame:
    """``key, order, _run``: of the runs of each note the one that the fewest texts have."""
    size, middle = F.length(note), max(_SHORT_GRAMS)
    own = (
        F.when(size >= _LONG_GRAM, grams(F.col(note), [_LONG_GRAM]))
        .when(size >= middle, grams(F.col(note), [middle]))
        .otherwise(F.array(note))
    )
    offered = notes.select(key, order, F.explode(own).alias("_run"))
    common = runs.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("_n"))
    return (
        offered.join(_sorted_in(common), [key, "_run"])
        .groupBy(key, order)
        .agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"))
    )


def _not_contained(notes: DataFrame, key: str, order: str, note: str) -> DataFrame:
    """Drop each note that an earlier, longer note of the same key contains."""
    runs = _runs(notes, [key, order], F.col(note), _sizes(notes, note))
    pairs = (
        _rarest(notes, runs, key, order, note)
        .join(_sorted_in(runs.withColumnRenamed(order, "_earlier")), [key, "_run"])
        .filter(F.col("_earlier") < F.col(order))
        .select(key, order, "_earlier")
    )
    told = (
        pairs.join(_sorted_in(notes), [key, order])
        .join(
            _sorted_in(notes.select(key, F.col(order).alias("_earlier"), F.col(note).alias("_longer"))),
            [key, "_earlier"],
        )
        .filter(F.contains("_longer", F.col(note)))
        .select(key, order)
        .distinct()
    )
    return notes.join(_sorted_in(told), [key, order], "left_anti").select(key, order, note)


def _not_across(first: DataFrame, notes: DataFrame, key: str, note: str) -> DataFrame:
    """Drop each note that lies across the edges of earlier notes: ``key, _order, note``.

    ``notes`` are those that no single earlier note contains; of them only notes with a bar, or with
    a space at an end, can match a separator. One with n bars reaches over at most n + 3 notes, so it
    lies in one of the stretches of 2 (n + 2) notes that start every n + 2 notes, n being the key's
    greatest. Which notes are neighbours depends on those dropped before, so this is repeated until
    the same notes go: each time at least the next decision in order is final, mostly all are. Keys
    of which the same notes go are done.
    """
    bars = F.length(note) - F.length(F.replace(F.col(note), F.lit(BAR)))
    crossing = durable(
        notes.filter((bars > 0) | (F.trim(F.col(note)) != F.col(note))).withColumn("_bars", bars)
    )
    if crossing.isEmpty():
        return notes
    strides = crossing.groupBy(key).agg((F.max("_bars") + 2).alias("_stride"))
    crossing, sizes = crossing.drop("_bars"), _sizes(crossing, note)
    some_first, some_notes, some_crossing = first, notes, crossing
    gone = durable(crossing.select(key, "_order").filter(F.lit(False)))
    finished = []
    while True:
        left = some_notes.join(_sorted_in(gone), [key, "_order"], "left_anti")
        lined = placed(join_facts(some_first.unionByName(left), strides, key), [key, "_order"], "_place")
        block = F.floor(F.col("_place") / F.col("_stride"))
        stretches = durable(
            lined.withColumn("_block", F.explode(F.array(block - 1, block)))
            .groupBy(key, "_block")
            .agg(F.array_sort(F.collect_list(F.struct("_order", F.col(note).alias("_note")))).alias("_all"))
        )
        runs = _runs(stretches, [key, "_block"], _joined(F.col("_all")), sizes)
        before = F.filter("_all", lambda n: n["_order"] < F.col("_order"))
        now = durable(
            _rarest(some_crossing, runs, key, "_order", note)
            .join(_sorted_in(runs), [key, "_run"])
            .select(key, "_order", "_block")
            .join(_sorted_in(some_crossing), [key, "_order"])
            .join(_sorted_in(stretches), [key, "_block"])
            .filter(F.contains(_joined(before), F.col(note)))
            .select(key, "_order")
            .distinct()
        )
        changed = now.exceptAll(gone).unionByName(gone.exceptAll(now))
        moved = durable(changed.select(key).distinct())
        finished.append(now.join(moved, key, "left_anti"))
        if moved.isEmpty():
            told = reduce(DataFrame.unionByName, finished)
            return notes.join(_sorted_in(told), [key, "_order"], "left_anti")
        gone = now.join(moved, key, "left_semi")
        some_first, some_notes, some_crossing = (
            rows.join(moved, key, "left_semi") for rows in (first, notes, crossing)
        )


def _joined(notes: Column) -> Column:
    return F.array_join(F.transform(notes, lambda n: n["_note"]), SEPARATOR)


def note_texts(
    kept: DataFrame, key: str, order: Sequence[str], note: str, width: int = PART_WIDTH
) -> DataFrame:
    """``key, note``: the whole folded text of each contact, whatever the number of its notes.

    Notes are put together by ranges of the last-but-one order column first, so no task sorts all
    notes of a big contact; what then meets by contact is the finished parts.
    """
    spans = [F.col(o) for o in order[:-2]] + [F.floor(F.col(order[-2]) / width).cast("long")]
    parts = (
        kept.withColumn("_span", F.struct(*[s.alias(f"s{i}") for i, s in enumerate(spans)]))
        .groupBy(key, "_span")
        .agg(_in_order(F.struct(*order), note).alias("_part"))
    )
    return parts.groupBy(key).agg(_in_order(F.col("_span"), "_part").alias(note))


def _in_order(place: Column, text: str) -> Column:
    texts = F.array_sort(F.collect_list(F.struct(place.alias("_at"), F.col(text).alias("_text"))))
    return F.array_join(F.transform(texts, lambda n: n["_text"]), SEPARATOR)


def note_heads(
    kept: DataFrame, key: str, order: Sequence[str], note: str, max_chars: int = 420
) -> DataFrame:
    """The first ``max_chars`` of each folded text, from at most that many leading notes.

    The rank filter is applied before the shuffle, so long groups are cut where they are read.
    """
    ranked = kept.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ).filter(F.col("_rn") <= max_chars)
    joined = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_rn", note))).alias("_all")
    )
    text = F.array_join(F.transform("_all", lambda n: n[note]), SEPARATOR)
    return joined.select(key, F.substring(text, 1, max_chars).alias(note))
