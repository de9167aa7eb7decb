"""Text and JSON reports over catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phone import is_valid
from tipweave.functions.text import blank, cap
from tipweave.operators.mining import uncategorised

# How much of a note a report shows.
STUB_NOTE, EMPTY_NOTE = 200, 350


def entry_stub(entries: DataFrame) -> DataFrame:
    return entries.select(
        "name",
        "phone",
        blank(F.col("field")).alias("field"),
        "from_local",
        cap(blank(F.col("note")), STUB_NOTE, "…").alias("note_preview"),
    )


def without_category(entries: DataFrame) -> DataFrame:
    return uncategorised(entries).select(
        blank(F.col("name")).alias("name"),
        F.substring(blank(F.col("note")), 1, EMPTY_NOTE).alias("note"),
    )


def duplicate_lines(groups: DataFrame, phones: DataFrame, kind: str, label: str) -> DataFrame:
    """Report lines of duplicate groups: one per group and one per phone, in report order.

    The lists stay in rows, so a group of any size is written as it is.
    """
    head = groups.select(
        "group_id",
        (-F.col("n_phones")).alias("_rank"),
        "norm_field",
        F.col(label).alias("_label"),
        F.lit("").alias("_phone"),
        F.concat_ws(
            "\t", F.lit(kind), F.col(label), "norm_field", F.col("n_phones").cast("string")
        ).alias("line"),
    )
    body = phones.join(groups, "group_id").select(
        "group_id",
        (-F.col("n_phones")).alias("_rank"),
        "norm_field",
        F.col(label).alias("_label"),
        F.col("norm_phone").alias("_phone"),
        F.concat(F.lit("    "), "norm_phone").alias("line"),
    )
    return head.unionByName(body).orderBy("_rank", "norm_field", "_label", "group_id", "_phone")


def duplicate_groups(exact: DataFrame, extended: DataFrame) -> DataFrame:
    """Both kinds of groups in one table, biggest first within a kind."""
    columns = ["match_kind", "label", "norm_field", "n_phones", "n_entries"]
    both = exact.select(
        F.lit("exact_name").alias("match_kind"), F.col("norm_name").alias("label"), *columns[2:]
    ).unionByName(
        extended.select(
            F.lit("extended_prefix_or_subsequence").alias("match_kind"), "label", *columns[2:]
        )
    )
    return both.orderBy("match_kind", F.desc("n_phones"), "norm_field", "label")


def suggestion_lines(suggested: DataFrame, phrases: DataFrame) -> DataFrame:
    """Lines of the keyword report: phrase and category pairs, then phrase counters."""
    pairs = suggested.select(
        F.lit(0).alias("section"),
        "n",
        "phrase",
        F.format_string("  %4d  '%s' -> %s", "n", "phrase", "field").alias("line"),
    )
    counters = phrases.select(
        F.lit(1).alias("section"), "n", "phrase", F.format_string("  %4d  %s", "n", "phrase").alias("line")
    )
    return pairs.unionByName(counters).orderBy("section", F.desc("n"), "phrase")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def rejected_phones(contacts: DataFrame) -> DataFrame:
    """Numbers that are no valid national number, with the first name and file they came with."""
    bad = contacts.filter((F.col("phone") != "") & ~is_valid(F.col("phone")))
    return bad.groupBy("phone").agg(
        F.min(F.struct("vcf_filename", "name")).alias("_first")
    ).select("phone", "_first.name", "_first.vcf_filename")


def write_rejected_phones(rejected: DataFrame, path: str) -> None:
    """Tab-separated rows, and a header file with their number beside them."""
    rejected.orderBy("phone").write.mode("overwrite").option("sep", "\t").csv(f"{path}/rows")
    rejected.agg(
        F.concat(F.lit("# "), F.count(F.lit(1)).cast("string"), F.lit(" unique numbers"))
    ).write.mode("overwrite").text(f"{path}/header")
