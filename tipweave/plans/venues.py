"""Venues: chat messages, bulletins and a curated list to one catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.operators.evidence import keep_evident
from tipweave.operators.search import by_name
from tipweave.operators.sequence import numbered
from tipweave.operators.venues import VenueRules, assemble, strict_rows, union_sources
from tipweave.runtime import durable
from tipweave.sources.bulletin import seed_since
from tipweave.sources.chat import since_year


def build_venues(
    messages: DataFrame,
    r: VenueRules,
    min_year: int | None = None,
    bulletin: DataFrame | None = None,
    seed: DataFrame | None = None,
    websites: DataFrame | None = None,
    evidence: DataFrame | None = None,
    verified: DataFrame | None = None,
) -> DataFrame:
    """All sources in order, merged, in name order.

    The bulletin counts only without a year filter; ``verified`` rows replace the rule rows;
    ``evidence`` is a table of verdicts that venues without a website must pass.
    """
    sources = []
    if bulletin is not None and min_year is None:
        sources.append(bulletin)
    sources.append(
        verified if verified is not None else strict_rows(since_year(messages, min_year), r)
    )
    if seed is not None:
        sources.append(seed_since(seed, "note", min_year).drop("source_year"))
    rows = union_sources(sources)
    for c in ("chat_id", "msg_seq", "name_no"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None))
    seq = numbered(rows, ["src_rank", "chat_id", "msg_seq", "name_no", "id"])
    # The merge reads its rows several times; the chats are read and searched once.
    found = durable(seq.drop("src_rank", "chat_id", "msg_seq", "name_no"))
    out = assemble(found, r, websites)
    if evidence is not None:
        out = keep_evident(out, evidence)
    return by_name(out)
