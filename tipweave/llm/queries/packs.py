"""The query that packs documents into sequences."""

from __future__ import annotations

import public_tokenizers

from tipweave.llm import packing
from tipweave.llm.queries.registry import query
from tipweave.llm.tables import table


@query("op4_packing")
def packs(spark, folder):
    docs = table(spark, folder, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, ["doc_id"], with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
