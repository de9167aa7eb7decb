"""Reading, keeping and ordering tables: what several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipweave.runtime import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows from a Parquet copy in the shared folder.

    It cuts the lineage, survives lost executors, and gives the planner the true size, by which it
    chooses between a broadcast and a shuffled join that it may split where a key is hot.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(column: str) -> Column:
    """The value as a text that is never null and differs for null and every value."""
    c = F.col(column)
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string")))


def tie_break(df: DataFrame) -> Column:
    """A hash of all columns of the row: orders rows that agree in every other key."""
    plain = [F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*plain)


def running(
    df: DataFrame, order: list[Column], sums: dict[str, Column], group: str | None = None
) -> DataFrame:
    """Running sums over a total order, without one task that sees a whole group.

    For each name ``n`` of ``sums`` the rows get ``n_before``, the sum over the rows that stand
    before this one in its group, and ``n_total``, the sum over the group. A null group is a group.

    Rows are dealt by ranges of (group, order) whose bounds Spark takes from a sample, so a group
    with a third of all rows spans a third of the ranges. Sums per range meet in a table of one row
    per range and group; its prefix sums are added to those inside each range.
    """
    rows = df.withColumns({f"__v_{n}": c for n, c in sums.items()})
    rows = rows.withColumn("__group", marked(group) if group else F.lit(""))
    rows = rows.repartitionByRange(F.col("__group"), *order)
    rows = stored(rows.withColumn("__range", F.spark_partition_id()), "ordered")
    per_range = rows.groupBy("__group", "__range").agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums]
    )
    whole = Window.partitionBy("__group")
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        "__group", "__range",
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums],
        *[F.sum(f"__s_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy("__group", "__range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    for n in sums:
        rows = rows.withColumn(
            f"__i_{n}", F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))
        )
    joined = rows.join(starts, ["__group", "__range"])
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__i_{n}") + F.col(f"__b_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums],
    )
