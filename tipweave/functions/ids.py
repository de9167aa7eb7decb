"""Ids derived from content, so that a repeated or retried job gives the same ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipweave.functions.text import blank, strip


def content_id(text: Column, prefix: str = "r-", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def evidence_key(name: Column, location: Column) -> Column:
    raw = F.concat(strip(blank(name)), F.lit("\n"), strip(blank(location)))
    return F.substring(F.sha2(raw, 256), 1, 20)
