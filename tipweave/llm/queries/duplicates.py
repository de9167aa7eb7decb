"""Queries that find near and partial duplicates."""

from __future__ import annotations

from tipweave.llm import simhash, unit_dedup
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op7_simhash")
def near(spark, folder):
    return simhash.components_of(table(spark, folder, "documents"))


@query("op10_unit_dedup")
def passages(spark, folder):
    docs = table(spark, folder, "documents")
    return unit_dedup.without_repeats(docs).select(
        "doc_id", "text", "n_chars", "cuts", "cut_chars"
    )
