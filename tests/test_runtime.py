"""Session helpers: what hot keys, broadcasts and intermediate folders do."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tipweave.runtime import broadcast_if_small, drop_work, fresh_path, join_facts


def test_a_hot_key_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(300_000).select(
            F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("v")
        ).repartition(8)
        facts = rows.groupBy("key").agg(F.max("v").alias("most"))
        joined = join_facts(rows, facts, "key")
        sizes = joined.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) == 300_000
        assert max(sizes) < 100_000  # the hot key alone has 200,000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"))

    def hinted(**limits) -> bool:
        plan = broadcast_if_small(df, otherwise="shuffle_hash", **limits)._jdf.queryExecution()
        return "broadcast" in plan.logical().toString().lower()

    assert hinted(max_rows=100)
    assert not hinted(max_rows=99)
    assert not hinted(max_rows=100, max_bytes=50_000)


def test_work_is_removed(spark):
    path = fresh_path(spark, "work")
    spark.range(3).write.parquet(path)
    local = Path(path.removeprefix("file:"))
    assert local.exists()
    drop_work(spark)
    assert not local.exists()
