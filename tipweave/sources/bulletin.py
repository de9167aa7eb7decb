"""Lists of venues inside longer texts, and the curated seed list."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.functions.ids import content_id
from tipweave.functions.phrases import contains_any
from tipweave.functions.text import cap, fold_spaces, strip, strip_chars, year_in_text

# Trailing phone of an item, quotes around names.
ITEM_PHONE = r"(0\d{1,2}[-\d\s]{6,}|05\d[-\d\s]{7,}|08-\d{4}-\d{3,})$"
ITEM_QUOTES = " \"'״"


def bulletin_items(
    texts: DataFrame,
    row_id: str,
    text: str,
    start: str,
    end: str,
    topical: Sequence[str],
    skip_prefix: str = ">>>",
    salt: str = "bulletin:",
) -> DataFrame:
    """Items between a start and an end marker: ``name - type, place, place phone``.

    The name ends at the first spaced dash. Of the rest, a trailing phone is taken off; the first
    comma part is the type, the others the location. Only topical items stay.
    """
    section = rf"(?s){re.escape(start)}(.*?){re.escape(end)}"
    lines = texts.filter(F.contains(F.col(text), F.lit(start))).select(
        row_id,
        F.posexplode(F.split(F.regexp_extract(text, section, 1), r"\r\n|[\r\n]")).alias(
            "item_no", "raw"
        ),
    ).withColumn("line", strip(F.col("raw")))
    dash = F.when(F.contains("line", F.lit(" – ")), " – ").when(
        F.contains("line", F.lit(" - ")), " - "
    )
    # An item is its line but for white space, so a word of a topical phrase is in the line as well:
    # what cannot be topical is not parsed.
    likely = contains_any(F.col("raw"), [max(p.split(), key=len) for p in topical if p.split()])
    split = lines.filter(likely if topical else F.lit(False)).filter(
        (F.col("line") != "") & ~F.col("line").startswith(skip_prefix) & dash.isNotNull()
    ).withColumn("_at", F.position(dash, F.col("line")))
    name = fold_spaces(
        strip_chars(F.substring(F.col("line"), F.lit(1), F.col("_at") - 1), ITEM_QUOTES)
    )
    rest = fold_spaces(F.substring(F.col("line"), F.col("_at") + 3, F.length("line")))
    parsed = split.select(row_id, "item_no", name.alias("_name"), rest.alias("_rest")).withColumn(
        "_phone", F.regexp_extract("_rest", ITEM_PHONE, 1)
    )
    before_phone = F.substring(
        F.col("_rest"), F.lit(1), F.length("_rest") - F.length("_phone")
    )
    body = F.when(
        F.col("_phone") != "",
        strip(F.regexp_replace(strip(before_phone), r",+$", "")),
    ).otherwise(F.col("_rest"))
    parts = F.filter(F.transform(F.split(body, ","), strip), lambda p: p != "")
    shaped = parsed.withColumn("_body", body).withColumn("_parts", parts)
    kind = F.when(F.size("_parts") >= 1, F.element_at("_parts", 1)).otherwise(F.col("_body"))
    place = F.array_join(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts"), F.lit(1))), ", ")
    items = shaped.select(
        row_id,
        "item_no",
        F.col("_name").alias("name"),
        kind.alias("restaurant_type"),
        place.alias("location"),
        fold_spaces(F.col("_phone")).alias("phone"),
    )
    blob = F.concat_ws(" ", "name", "restaurant_type", "location")
    return items.filter(contains_any(blob, topical)).select(
        row_id,
        "item_no",
        content_id(F.concat(F.lit(salt), "name", "location")).alias("id"),
        cap(F.col("name"), 120).alias("name"),
        cap(F.col("restaurant_type"), 150).alias("restaurant_type"),
        cap(F.col("location"), 200).alias("location"),
        cap(F.col("phone"), 250).alias("phone"),
    )


def seed_since(seed: DataFrame, source_line: str, min_year: int | None) -> DataFrame:
    """Seed rows of that year and later; rows whose source line names no year stay."""
    dated = seed.withColumn("source_year", year_in_text(F.col(source_line)))
    if min_year is None:
        return dated
    return dated.filter(F.col("source_year").isNull() | (F.col("source_year") >= min_year))
