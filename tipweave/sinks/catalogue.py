"""Writing catalogues: new versions beside the old ones, JSON for exchange, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tipweave.operators.overlay import stored_rows
from tipweave.sources.catalogue import folder_names, path_exists


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, oldest first; one is complete once its success file is there."""
    found = sorted(n for n in folder_names(spark, root) if n.startswith("v"))
    return [v for v in found if path_exists(spark, f"{root}/{v}/_SUCCESS")]


def write_version(df: DataFrame, root: str) -> str:
    """Write the table as the next version. Readers keep the old one until this is complete, so a
    job may read and replace the same catalogue and a failed write changes nothing."""
    spark = df.sparkSession
    done = versions(spark, root)
    number = int(done[-1][1:9]) + 1 if done else 1
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{root}/{name}")
    return name


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    done = versions(spark, root)
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)


def compact(merged: DataFrame, root: str) -> str:
    """Make the merged state the new base; its change log starts empty after this version."""
    return write_version(stored_rows(merged), root)
