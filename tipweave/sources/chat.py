"""Chat exports: text files and archives to one row per message."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tipweave.functions.text import clean_sender, drop_edit_markers, strip
from tipweave.operators.sequence import renumber

# The header of an exported message, the attachment mark, the media placeholder.
HEADER = r"(?U)^(\d{1,2}/\d{1,2}/\d{4}),\s*(\d{1,2}:\d{2})\s*-\s*(.+?):\s*(.*)$"
HEADER_NO_COLON = r"(?U)^(\d{1,2}/\d{1,2}/\d{4}),\s*(\d{1,2}:\d{2})\s*-\s*([^:]+):\s*(.*?)\s*$"
MEDIA_PLACEHOLDER = "<Media omitted>"
LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def read_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Every line of every chat file with its place: file, byte offset of its block, number."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("chat_id"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_id"),
            F.posexplode(F.split("value", LINE_BREAKS)).alias("part", "line"),
        )
    )


def stitch(lines: DataFrame, compact: bool = True, keep_preamble: bool = False) -> DataFrame:
    """Lines to messages; a line without a header belongs to the message before it.

    ``compact`` strips continuation lines, drops blank ones and drops empty messages; otherwise
    bodies keep their lines as they are and empty bodies stay. Lines before the first header of a
    file are dropped unless ``keep_preamble``.

    A file is numbered block by block: headers are counted inside each block, and the counts of
    the earlier blocks (one row per block) are added. No task sees more than one block.
    """
    header = HEADER if compact else HEADER_NO_COLON
    text = strip(F.col("line")) if compact else F.col("line")
    marked = lines.withColumn("is_header", F.col("line").rlike(header))
    headers = marked.groupBy("chat_id", "block").agg(
        F.sum(F.col("is_header").cast("long")).alias("_n")
    )
    earlier = (
        Window.partitionBy("chat_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = headers.select(
        "chat_id", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy("chat_id", "block")
        .orderBy("line_id", "part")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = (
        marked.withColumn("_local", F.sum(F.col("is_header").cast("long")).over(inside))
        .join(offsets, ["chat_id", "block"])
        .withColumn("message_no", F.col("_offset") + F.col("_local"))
    )
    pieces = numbered.select(
        "chat_id",
        "message_no",
        F.when(
            F.col("is_header"),
            F.struct(
                F.regexp_extract("line", header, 1).alias("day"),
                F.regexp_extract("line", header, 2).alias("time"),
                F.regexp_extract("line", header, 3).alias("sender"),
            ),
        ).alias("head"),
        F.struct(
            "block",
            "line_id",
            "part",
            F.when(F.col("is_header"), F.regexp_extract("line", header, 4))
            .otherwise(text)
            .alias("text"),
        ).alias("piece"),
    )
    if compact:
        pieces = pieces.filter(F.col("head").isNotNull() | (F.col("piece.text") != ""))
    if not keep_preamble:
        pieces = pieces.filter("message_no > 0")
    messages = pieces.groupBy("chat_id", "message_no").agg(
        F.max("head").alias("head"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
    )
    body = strip(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n"))
    date_str = F.concat_ws(" " if compact else ", ", "head.day", "head.time")
    sender = strip(F.col("head.sender")) if compact else clean_sender(F.col("head.sender"))
    out = messages.select(
        "chat_id",
        "message_no",
        F.try_to_timestamp(
            F.concat_ws(" ", "head.day", "head.time"), F.lit("d/M/yyyy H:mm")
        ).alias("ts"),
        F.when(F.col("head").isNotNull(), date_str).alias("date_str"),
        sender.alias("sender"),
        body.alias("body"),
    )
    if compact:
        out = out.filter("body <> ''")
    return renumber(out, ["chat_id"], "message_no", "msg_seq").drop("message_no")


def read_chat(
    spark: SparkSession, path: str, compact: bool = True, keep_preamble: bool = False
) -> DataFrame:
    return stitch(read_lines(spark, path), compact, keep_preamble)


def since_year(messages: DataFrame, min_year: int | None) -> DataFrame:
    """Messages of that year and later; without a readable year a message is dropped."""
    if min_year is None:
        return messages
    return messages.filter(F.year("ts") >= min_year)


def worth_scanning(messages: DataFrame) -> DataFrame:
    """Drop empty and very short bodies and media placeholders; clean export marks."""
    kept = messages.filter((F.length("body") >= 10) & (F.col("body") != MEDIA_PLACEHOLDER))
    return kept.withColumn("body", drop_edit_markers(F.col("body")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Text members of zipped exports in a folder, see ``open_archives``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return open_archives(files.select("path", "content"))


def open_archives(files: DataFrame) -> DataFrame:
    """Text members of archives ``(path, content)``: ``(archive, member_no, member, content)``.

    One archive is opened by one task; a member is decoded with bad bytes replaced.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for no, info in enumerate(z.infolist()):
                        if info.filename.lower().endswith((".txt", ".vcf")):
                            yield pd.DataFrame(
                                {
                                    "archive": [archive],
                                    "member_no": [no],
                                    "member": [info.filename],
                                    "content": [z.read(info).decode("utf-8", errors="replace")],
                                }
                            )

    return files.select("path", "content").mapInPandas(
        members, "archive string, member_no long, member string, content string"
    )


def archive_lines(members: DataFrame) -> DataFrame:
    """Chat lines of archive members in the shape of ``read_lines``.

    Only the first text member of each archive is a chat, as in a folder export.
    """
    chats = members.filter(F.lower("member").endswith(".txt"))
    first = chats.groupBy("archive").agg(F.min("member_no").alias("member_no"))
    lines = chats.join(first, ["archive", "member_no"], "left_semi").select(
        F.concat_ws("!", "archive", "member").alias("chat_id"),
        F.lit(0).cast("long").alias("block"),
        F.posexplode(F.split("content", rf"\r\n|[\r\n]|{LINE_BREAKS}")).alias("line_id", "line"),
    )
    return lines.select(
        "chat_id", "block", F.col("line_id").cast("long"), F.lit(0).alias("part"), "line"
    )
