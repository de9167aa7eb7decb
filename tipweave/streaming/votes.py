"""Vote stream to live counters.

A micro-batch is reduced by the same closed form as the batch job (a hot item is cut into ranges),
then folded into the stored counters of the items it touches. The state is a log: batch *n* writes
the new counters of its items only, and every so often a full snapshot is written. Batch *n* reads
what came before it and writes its own folder, so a batch repeated after a failure gives the same.
What lies before the last two snapshots is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipweave.operators.votes import COUNTERS, ITEM, apply_votes, clean_state
from tipweave.sources.catalogue import VOTE_SCHEMA, complete_numbers, drop_numbers

SNAPSHOT_EVERY = 64


def _folder(root: str, kind: str, number: int) -> str:
    return f"{root}/{kind}={number:010d}"


def read_state(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Counters before the batch: the newest snapshot, and the batches since then on top."""
    snapshots = [n for n in complete_numbers(spark, root, "snapshot") if n <= batch]
    start = snapshots[-1] if snapshots else 0
    state = spark.createDataFrame([], VOTE_SCHEMA).withColumn("_batch", F.lit(-1))
    if snapshots:
        kept = spark.read.schema(VOTE_SCHEMA).parquet(_folder(root, "snapshot", start))
        state = kept.withColumn("_batch", F.lit(-1))
    paths = [(n, _folder(root, "batch", n)) for n in complete_numbers(spark, root, "batch") if start <= n < batch]
    for number, path in paths:
        newer = spark.read.schema(VOTE_SCHEMA).parquet(path).withColumn("_batch", F.lit(number))
        state = state.unionByName(newer)
    newest = F.max_by(F.struct(*COUNTERS), "_batch")
    return state.groupBy(*ITEM).agg(newest.alias("c")).select(*ITEM, "c.*")


def start_counters(
    events: DataFrame,
    root: str,
    checkpoint: str,
    initial: DataFrame | None = None,
    trigger: dict | None = None,
    dedupe_delay: str | None = None,
) -> StreamingQuery:
    """Run the counters over a stream of ``event_id, ts, item_type, item_key, seq, prev, next``.

    With ``dedupe_delay`` an event id delivered twice within that time counts once.
    """
    if dedupe_delay:
        events = events.withWatermark("ts", dedupe_delay).dropDuplicatesWithinWatermark(
            ["event_id"]
        )

    spark = events.sparkSession
    if initial is not None and not complete_numbers(spark, root, "snapshot"):
        _write(initial, _folder(root, "snapshot", 0))

    def fold(batch: DataFrame, batch_id: int) -> None:
        before = read_state(batch.sparkSession, root, batch_id)
        if batch_id and batch_id % SNAPSHOT_EVERY == 0:
            _write(before, _folder(root, "snapshot", batch_id))
            # A repeated batch starts from the last snapshot but one at the earliest.
            for kind in ("snapshot", "batch"):
                drop_numbers(batch.sparkSession, root, kind, below=batch_id - SNAPSHOT_EVERY)
        touched = batch.select(*ITEM).distinct()
        own = before.join(touched, list(ITEM), "left_semi")
        _write(apply_votes(batch, own), _folder(root, "batch", batch_id))

    return (
        events.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _write(state: DataFrame, path: str) -> None:
    columns = [F.col(c).cast("long").alias(c) for c in COUNTERS]
    state.select(*ITEM, *columns).write.mode("overwrite").parquet(path)


def current_counters(spark: SparkSession, root: str) -> DataFrame:
    """Counters after the last complete batch; stored negatives are read as zero."""
    done = complete_numbers(spark, root, "batch")
    return clean_state(read_state(spark, root, done[-1] + 1 if done else 0))
