"""Stored catalogues: JSON arrays of records, versioned Parquet tables, rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipweave.functions.ids import content_id
from tipweave.functions.text import blank, non_blank, strip


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ENTRY_SCHEMA = T.StructType(
    [
        *_strings("name", "phone", "phone_display"),
        T.StructField("phones", T.ArrayType(T.StringType())),
        *_strings("field"),
        T.StructField("from_local", T.BooleanType()),
        *_strings("note", "extra_info", "recommender"),
    ]
)
VENUE_SCHEMA = T.StructType(
    _strings(
        "id", "name", "restaurant_type", "location", "note", "extra_info", "website", "recommender"
    )
)
VOTE_SCHEMA = T.StructType(
    [
        *_strings("item_type", "item_key"),
        T.StructField("likes", T.LongType()),
        T.StructField("dislikes", T.LongType()),
    ]
)
CACHE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        *_strings("query", "name", "location"),
        T.StructField("hits", T.LongType()),
    ]
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm_path))


def folder_names(spark: SparkSession, root: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def drop_numbers(spark: SparkSession, root: str, kind: str, below: int) -> None:
    """Remove the folders ``kind=<number>`` with smaller numbers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for n in folder_names(spark, root):
        if n.startswith(f"{kind}=") and int(n.split("=")[1]) < below:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}"), True)


def complete_numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the completely written folders ``kind=<number>``, in order."""
    return sorted(
        int(n.split("=")[1])
        for n in folder_names(spark, root)
        if n.startswith(f"{kind}=") and path_exists(spark, f"{root}/{n}/_SUCCESS")
    )


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    renamed: dict[str, str] | None = None,
    one_per_line: bool = False,
) -> DataFrame:
    """Records of a JSON catalogue: one array per file, or one record per line.

    An array file is read by one task; files of one record per line are split. A missing path is an empty catalogue and records that are no objects are dropped. ``renamed``
    maps names in the file to names in the schema.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    back = {new: old for old, new in (renamed or {}).items()}
    stored = T.StructType([T.StructField(back.get(f.name, f.name), f.dataType) for f in schema])
    if one_per_line:
        bad = T.StructField("_corrupt_record", T.StringType())
        raw = spark.read.schema(T.StructType([*stored.fields, bad])).json(path)
        rows = raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    else:
        # Element by element, so that one odd element does not cost the whole file.
        whole = spark.read.text(path, wholetext=True).filter(strip(F.col("value")).startswith("["))
        elements = whole.select(F.explode(F.from_json("value", "array<string>")).alias("element"))
        rows = (
            elements.filter(strip(F.col("element")).startswith("{"))
            .select(F.from_json("element", stored).alias("r"))
            .select("r.*")
        )
    for old, new in (renamed or {}).items():
        rows = rows.withColumnRenamed(old, new)
    return rows


def with_venue_ids(venues: DataFrame) -> DataFrame:
    """Ids for rows without one, from their content, so that a second run gives the same."""
    text = F.concat_ws("\u0001", *[blank(F.col(c)) for c in ("name", "location", "note", "extra_info")])
    own = non_blank(strip(blank(F.col("id"))))
    return venues.withColumn("id", F.coalesce(own, content_id(text)))


def with_legacy_column(df: DataFrame, column: str, legacy: str) -> DataFrame:
    """Take the old column where the new one is missing, then drop it."""
    if legacy not in df.columns:
        return df
    value = F.coalesce(F.col(column), F.col(legacy)) if column in df.columns else F.col(legacy)
    return df.withColumn(column, value).drop(legacy)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table stored as Parquet, JSON lines or CSV with a header."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return spark.read.parquet(path)
