"""What readers see: the catalogue with user changes and votes, ready to search."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tipweave.operators.overlay import merge_overlay, public_entries, public_venues
from tipweave.operators.votes import with_votes


def served_contacts(
    base: DataFrame, added: DataFrame, changes: DataFrame, votes: DataFrame
) -> DataFrame:
    merged = merge_overlay(base, added, changes)
    return public_entries(with_votes(merged, votes, "entry", "item_key"))


def served_venues(venues: DataFrame, votes: DataFrame) -> DataFrame:
    return with_votes(public_venues(venues), votes, "venue", "id")
