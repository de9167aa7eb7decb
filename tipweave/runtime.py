"""Session-level helpers: the shared work folder, durable cuts in the lineage, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own; on a cluster a machine-local
    folder would lose data with its machine, so there the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_PATHS: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; ``drop_work`` removes what lies there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def drop_work(spark: SparkSession) -> None:
    """Remove the intermediate tables of this process. Results that still read them must be done."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor costs one step.

    Unlike a checkpoint, which computes its rows once to count and once to write them, this is one
    pass, and the planner knows the size of what it reads next.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_counted(df: DataFrame, wanted: Column | None = None) -> tuple[DataFrame, int]:
    """`durable`, and how many of its rows are ``wanted`` (all, if nothing is given), counted while
    they are written: no job of its own asks whether any are left."""
    seen = Observation()
    count = F.count(F.lit(1)) if wanted is None else F.count_if(wanted)
    return durable(df.observe(seen, count.alias("n"))), seen.get["n"]


def join_facts(rows: DataFrame, facts: DataFrame, on, how: str = "inner") -> DataFrame:
    """Rows joined with what was found out about their keys, which may be hot.

    Spark splits a hot key only if no aggregate on it stands between the shuffle and the join, so
    the facts, one row per key, are kept first.
    """
    return rows.join(durable(facts), on, how)


def rows_if_small(df: DataFrame, max_rows: int) -> list | None:
    """The rows of a rule table if there are at most ``max_rows``, else None.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


MAX_BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether rows and bytes of the table are few enough for a broadcast."""
    texts = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n, t in df.dtypes if t == "string"]
    size = sum(texts, F.lit(16 * len(df.columns)))
    rows, volume = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (volume or 0) <= max_bytes


def broadcast_if_small(
    df: DataFrame, max_rows: int, otherwise: str, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast if rows and bytes of the table are few; a bigger table gets the
    ``otherwise`` join hint."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df.hint(otherwise)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work to all cores when the input is a single split.

    That is at most ``spark.sql.files.maxPartitionBytes``; larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and df.rdd.getNumPartitions() == 1 else df
