"""New messages to mentions and venue rows, without state.

The context of a mention needs three later messages, which a micro-batch may not have yet; the
batch job adds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tipweave.operators.mentions import find_mentions
from tipweave.operators.venues import VenueRules, strict_rows
from tipweave.sources.chat import since_year


def stream_mentions(messages: DataFrame, min_year: int | None = None) -> DataFrame:
    return find_mentions(since_year(messages, min_year))


def stream_venues(messages: DataFrame, rules: VenueRules, min_year: int | None = None) -> DataFrame:
    return strict_rows(since_year(messages, min_year), rules)
