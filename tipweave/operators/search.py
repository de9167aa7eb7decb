"""Reading the catalogue: search, facets, displayed columns, run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phone import COUNTRY_CODE, digits
from tipweave.functions.text import SPACE, blank, cap, strip

# What the views search and how much they show.
NO_CATEGORY = ("__no_field__", "__no_type__")
CONTACT_COLUMNS = ("name", "phone", "phones", "field", "extra_info", "note")
VENUE_COLUMNS = ("name", "restaurant_type", "location", "note", "extra_info", "website")
CARD_COLUMNS = ("name", "restaurant_type", "location", "note", "extra_info")
CONTACT_NOTE_SHOWN, VENUE_NOTE_SHOWN, EXTRA_SHOWN = 400, 300, 500


def _haystack(df: DataFrame, columns: Sequence[str]) -> Column:
    parts = []
    for c in columns:
        if c not in df.columns:
            continue
        is_list = df.schema[c].dataType.typeName() == "array"
        parts.append(
            F.coalesce(F.array_join(c, " "), F.lit("")) if is_list else blank(F.col(c))
        )
    return F.lower(F.concat_ws(" ", *parts))


def search(
    catalogue: DataFrame,
    query: str = "",
    category: str = "",
    columns: Sequence[str] = CONTACT_COLUMNS,
    category_column: str = "field",
    fold: bool = False,
) -> DataFrame:
    """Rows of a category whose columns, read as one text, contain the query.

    The category test is plain equality, so it reaches the file scan; ``fold`` also evens out white
    space on both sides, as the card view does.
    """
    out = catalogue
    if category in NO_CATEGORY:
        out = out.filter(strip(blank(F.col(category_column))) == "")
    elif category:
        out = out.filter(F.col(category_column) == category)
    hay = _haystack(out, columns)
    wanted = query.strip().lower()
    if fold:
        hay = strip(F.regexp_replace(hay, rf"(?U){SPACE}+", " "))
        wanted = " ".join(wanted.split())
    return out.filter(F.contains(hay, F.lit(wanted))) if wanted else out


def facets(catalogue: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values with their number of rows."""
    value = strip(blank(F.col(column)))
    return (
        catalogue.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("value <> ''")
    )


def facet_keys(locale: str | None = None) -> list[Column]:
    """Sort keys of facet values; with ``locale`` in the order of that language."""
    value = F.col("value")
    return [F.collate(value, locale), value] if locale else [value]


def facet_order(values: DataFrame, locale: str | None = None) -> DataFrame:
    return values.orderBy(*facet_keys(locale))


def category_list(catalogue: DataFrame, other: str, column: str = "field") -> DataFrame:
    """Distinct categories in order, and ``other`` at the end if it is not among them."""
    spark = catalogue.sparkSession
    found = catalogue.select(strip(blank(F.col(column))).alias("value")).filter("value <> ''")
    with_other = found.distinct().withColumn("place", F.lit(0)).unionByName(
        spark.createDataFrame([(other, 1)], "value string, place int")
    )
    return with_other.groupBy("value").agg(F.min("place").alias("place")).orderBy("place", "value")


def show_contacts(catalogue: DataFrame) -> DataFrame:
    listed = F.when(F.size("phones") > 0, F.col("phones")).otherwise(
        F.filter(F.array(blank(F.col("phone"))), lambda p: p != "")
    )

    def link(p: Column) -> Column:
        d = digits(p)
        return F.when(
            d != "", F.concat(F.lit(f"+{COUNTRY_CODE}"), F.regexp_replace(d, "^0", ""))
        ).otherwise("")

    return catalogue.select(
        "*",
        F.array_join(listed, " · ").alias("phones_shown"),
        F.array_join(F.transform(listed, link), " ").alias("phone_links"),
        cap(blank(F.col("note")), CONTACT_NOTE_SHOWN, "…").alias("note_shown"),
    )


def show_venues(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(
        "*",
        cap(blank(F.col("note")), VENUE_NOTE_SHOWN, "…").alias("note_shown"),
        cap(blank(F.col("extra_info")), EXTRA_SHOWN, "…").alias("extra_shown"),
    )


def name_keys() -> list[Column]:
    return [F.lower("name"), F.col("name")]


def by_name(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(*name_keys())


def shown_of_total(catalogue: DataFrame, found: Column) -> DataFrame:
    return catalogue.agg(
        F.count_if(found).alias("shown"), F.count(F.lit(1)).alias("total")
    )
