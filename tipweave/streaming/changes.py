"""Change-log stream to catalogue: what the log says so far, in a bounded form, on top of the base.

The state is the log itself, reduced to the newest row per key, operation and column, so it grows
with the keys that were ever changed and not with the changes. The catalogue is the base with this
log merged in, just as the batch job does it, whatever way the log was cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tipweave.operators.overlay import CHANGE_SCHEMA, merge_overlay, stored_rows
from tipweave.sources.catalogue import ENTRY_SCHEMA, complete_numbers, drop_numbers, path_exists


def newest_changes(changes: DataFrame) -> DataFrame:
    """The newest row per key, operation and column; merging these equals merging all rows."""
    rest = F.struct("seq", "value", "phones")
    return changes.groupBy("key", "op", "column").agg(F.max_by(rest, "seq").alias("_r")).select(
        "key", F.col("_r.seq").alias("seq"), "op", "column",
        F.col("_r.value").alias("value"), F.col("_r.phones").alias("phones"),
    )


def _folder(root: str, batch: int) -> str:
    return f"{root}/batch={batch:010d}"


def current_catalogue(spark: SparkSession, root: str, base: DataFrame) -> DataFrame:
    """The base with all complete batches merged in."""
    done = complete_numbers(spark, root, "batch")
    changes = (
        spark.read.schema(CHANGE_SCHEMA).parquet(_folder(root, done[-1]))
        if done else spark.createDataFrame([], CHANGE_SCHEMA)
    )
    none_added = spark.createDataFrame([], ENTRY_SCHEMA).withColumn("seq", F.lit(0).cast("long"))
    return stored_rows(merge_overlay(base, none_added, changes))


def start_changes(
    changes: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Fold each batch into the reduced log.

    A repeated batch overwrites its own folder from the same predecessor; folders before that are
    removed.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _folder(root, batch_id - 1)
        rows = batch.select(*CHANGE_SCHEMA.names)
        if path_exists(spark, f"{before}/_SUCCESS"):
            rows = rows.unionByName(spark.read.schema(CHANGE_SCHEMA).parquet(before))
        newest_changes(rows).write.mode("overwrite").parquet(_folder(root, batch_id))
        drop_numbers(spark, root, "batch", below=batch_id - 1)

    return (
        changes.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
