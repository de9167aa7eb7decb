"""A training corpus from raw documents: five stages, each one operator over all that is left.

1. toxicity: documents that score at least ``toxicity.THRESHOLD`` go.
2. line dedup: boilerplate lines of a source go from its documents; every document stays.
3. near-dedup: one document of each group of near copies stays, the one with the smallest id.
4. mixing: documents are taken by target weights of their sources; those taken twice occur twice.
5. packing: the documents' tokens are packed into sequences of at most 1024.

Each stage is written as Parquet and read again, so a lost executor repeats at most one stage.
Defined cases are those of the operators; columns beyond those of documents are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tipweave.llm import line_dedup, mixing, near_texts, packing, toxicity
from tipweave.llm.tables import stored, table

#: Model fitting and graph rounds can't be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Copies count once, near copies too: near-dedup comes later, and must find one of each whole.
    return line_dedup.drop_boilerplate(docs, copies=False).drop("dropped_lines")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, ["doc_id", "source"], with_ids=False).select(
        "doc_id", "source", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", clean),
    ("line dedup", lines),
    ("near-dedup", near),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
