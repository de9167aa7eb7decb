"""Archives, array files, compaction, orders that show in the rows, mentions of a stream."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tipweave.operators import duplicates as dup
from tipweave.operators import overlay as ov
from tipweave.operators import search as se
from tipweave.operators.sequence import placed
from tipweave.queries.catalogue import overlay_inputs
from tipweave.queries.chat import as_messages, export_lines, with_attachments
from tipweave.queries.entities import KEYED_SQL, entries
from tipweave.queries.registry import SQL, query, table
from tipweave.runtime import fresh_path
from tipweave.sinks.catalogue import compact, read_current
from tipweave.sources.catalogue import ENTRY_SCHEMA, read_json
from tipweave.sources.chat import archive_lines, open_archives, stitch
from tipweave.streaming.messages import stream_mentions

#: Turns of a conversation in one archive, records in one array file.
IN_ARCHIVE, IN_FILE = 64, 1000


def _zipped(turns: pd.DataFrame) -> pd.DataFrame:
    """One archive: a card, the chat, and a second text that is no chat."""
    turns = turns.sort_values("turn")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.VCF", "BEGIN:VCARD\nEND:VCARD\n")
        z.writestr("chat.txt", "\r\n".join(turns["value"]))
        z.writestr("later.txt", "1/1/2020, 1:05 - user 0 0: not read")
        z.writestr("image.bin", b"\x00\xff")
    return pd.DataFrame({"path": [turns["path"].iat[0]], "content": [packed.getvalue()]})


@query("archive_roundtrip", SQL["chat_parse_roundtrip"])
def archive_roundtrip(spark, folder):
    """Conversations as zipped exports of a few turns each, opened, stitched and taken apart."""
    lines = export_lines(table(spark, folder, "conversations"))
    part = F.floor(F.col("turn") / IN_ARCHIVE).cast("string")
    named = lines.withColumn("path", F.concat_ws("-", F.col("conv_id").cast("string"), part))
    files = named.groupBy("path").applyInPandas(_zipped, "path string, content binary")
    parsed = stitch(archive_lines(open_archives(files)))
    sender = F.split("sender", " ")
    return parsed.select(
        sender[1].cast("long").alias("conv_id"),
        sender[2].cast("long").alias("turn"),
        sender[0].alias("role"),
        "date_str",
        "body",
    )


@query("json_array_roundtrip", SQL["json_roundtrip"])
def json_array_roundtrip(spark, folder):
    """Array files with a few elements that are no objects, which are dropped."""
    record = F.to_json(
        F.struct(
            F.col("c_name").alias("name"),
            F.concat(F.lit("050"), F.col("c_custkey").cast("string")).alias("phone"),
            F.col("c_mktsegment").alias("field"),
            (F.col("c_acctbal") > 0).alias("local_flag"),
        )
    )
    arrays = (
        table(spark, folder, "customer")
        .groupBy(F.floor(F.col("c_custkey") / IN_FILE).alias("file"))
        .agg(F.array_join(F.collect_list(record), ",\n").alias("records"))
        .select("file", F.concat(F.lit("[7, "), "records", F.lit(', "odd", null]')).alias("value"))
    )
    path = fresh_path(spark, "arrays")
    arrays.write.partitionBy("file").text(path)
    return read_json(spark, path, ENTRY_SCHEMA, {"local_flag": "from_local"}).select(
        "name", "phone", "field", "from_local"
    )


@query("compacted_catalogue", SQL["stored_entries"])
def compacted_catalogue(spark, folder):
    """The merged catalogue as the new version of a stored one, read back."""
    base, added, changes = overlay_inputs(spark, folder)
    root = fresh_path(spark, "catalogue")
    compact(ov.merge_overlay(base, added, ov.with_display_phone(changes)), root)
    return read_current(spark, root).select(
        "name", "phone", "field", "from_local", "note", "extra_info"
    )


@query(
    "catalogue_order",
    """
    SELECT p_partkey, row_number() OVER (ORDER BY lower(name), name, p_partkey) - 1 AS place
    FROM (SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE upper(p_name) END AS name FROM part)
    """,
)
def catalogue_order(spark, folder):
    name = F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(F.upper("p_name"))
    rows = table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return placed(rows, [*se.name_keys(), F.col("p_partkey")]).select("p_partkey", "place")


@query(
    "facet_places",
    """
    WITH v AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN p_name
        ELSE replace(p_name, 'e', 'é') END AS value FROM part)
    SELECT value, row_number() OVER (ORDER BY lower(strip_accents(value)), value <> strip_accents(value), value DESC) - 1 AS place FROM v
    """,
)
def facet_places(spark, folder):
    """Facet values in the order of a language: accents and case count after all letters."""
    name, kind = F.col("p_name"), F.col("p_size") % 3
    written = F.when(kind == 0, F.upper(name)).when(kind == 1, name).otherwise(
        F.replace(name, F.lit("e"), F.lit("é"))
    )
    values = se.facets(table(spark, folder, "part").withColumn("written", written), "written")
    return placed(values.select("value"), se.facet_keys("fr")).select("value", "place")


@query(
    "report_places",
    f"""
    WITH {KEYED_SQL},
    g AS (SELECT field AS norm_field, nm AS norm_name, count(DISTINCT phone) AS n_phones FROM e
          WHERE phone <> '' AND nm <> '' GROUP BY 1, 2 HAVING count(DISTINCT phone) > 1)
    SELECT norm_field, norm_name, row_number() OVER (ORDER BY n_phones DESC, norm_field, norm_name) - 1 AS place FROM g
    """,
)
def report_places(spark, folder):
    """Groups of one name and several phones, by the place they have in the report."""
    groups = dup.exact_groups(dup.triples(dup.keyed(entries(spark, folder))))
    return placed(groups, dup.report_keys("norm_name")).select("norm_field", "norm_name", "place")


@query(
    "mention_stream",
    """
    SELECT CAST(conv_id AS VARCHAR) AS chat_id, turn AS msg_seq, 'Contact ' || conv_id || '-' || turn || '.vcf' AS vcf_name
    FROM conversations WHERE role = 'assistant'
    """,
)
def mention_stream(spark, folder):
    """Mentions of a message stream in several batches, written as they come."""
    messages = with_attachments(as_messages(spark, folder))
    log, out = fresh_path(spark, "messages"), fresh_path(spark, "mentions")
    messages.repartition(4, "chat_id", "msg_seq").write.parquet(log)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(log)
    found = stream_mentions(stream).select("chat_id", "msg_seq", "vcf_name")
    sink = found.writeStream.format("parquet").option("checkpointLocation", fresh_path(spark, "offsets"))
    sink.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
