"""The query that scores documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipweave.llm import toxicity
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op2_toxicity")
def toxic(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, table(spark, folder, "labels"))
    return found.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )
