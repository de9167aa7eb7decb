"""Is a venue known on the web? Evidence tables instead of a live search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.ids import evidence_key
from tipweave.functions.text import blank, cap, strip
from tipweave.runtime import join_facts

# Words that say nothing about a venue.
STOP_TOKENS = (
    "מסעדה", "מסעדת", "המסעדה", "בית", "קפה", "ב", "וב", "של", "ליד", "the", "and", "or",
)
QUERY_LENGTH = 240


def has_website(website: Column) -> Column:
    return F.lower(strip(blank(website))).rlike("^https?://")


def name_tokens(name: Column, stop: Sequence[str] = STOP_TOKENS, min_length: int = 2) -> Column:
    bare = F.regexp_replace(blank(name), r"\([^)]*\)", " ")
    plain = F.regexp_replace(bare, r"(?U)[^\w\s\x{0590}-\x{05FF}\-]", " ")
    return F.filter(
        F.split(F.lower(plain), r"(?U)\s+"),
        lambda t: (F.length(t) >= min_length) & ~t.isin(list(stop)),
    )


def query_text(name: Column, location: Column, suffix: Sequence[str] = ()) -> Column:
    parts = [strip(blank(name)), strip(blank(location)), *[F.lit(s) for s in suffix]]
    filled = F.filter(F.array(*parts), lambda p: p != "")
    return cap(F.array_join(filled, " "), QUERY_LENGTH)


def judge(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Verdict per evidence key from search results ``(key, title, snippet)``.

    A name without tokens passes on any result; otherwise a token must occur in a result. Rows and
    results meet on the key, and a verdict is a maximum, so no result list is gathered.
    """
    asked = (
        rows.withColumn("key", evidence_key(F.col("name"), F.col("location")))
        .groupBy("key")
        .agg(F.min(F.struct("name", "location")).alias("_row"))
        .select("key", "_row.*")
        .withColumn("_tokens", name_tokens(F.col("name")))
    )
    blob = F.lower(F.concat_ws(" ", blank(F.col("title")), blank(F.col("snippet"))))
    hit = (F.size("_tokens") == 0) | F.exists("_tokens", lambda t: F.contains(blob, t))
    return (
        asked.join(results.select(F.col("key"), "title", "snippet", F.lit(1).alias("_r")), "key", "left")
        .groupBy("key", "name", "location")
        .agg(
            F.coalesce(F.bool_or(F.col("_r").isNotNull() & hit), F.lit(False)).alias("ok"),
            F.count("_r").alias("hits"),
        )
    )


def cache_misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows to be judged: no website of their own and no cached verdict."""
    open_rows = rows.filter(~has_website(F.col("website"))).withColumn(
        "key", evidence_key(F.col("name"), F.col("location"))
    )
    return open_rows.join(cache.select("key").distinct(), "key", "left_anti")


def keep_evident(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows with a website, or with a positive verdict."""
    known = cache.groupBy("key").agg(F.bool_or("ok").alias("_ok"))
    keyed = rows.withColumn("key", evidence_key(F.col("name"), F.col("location")))
    judged = join_facts(keyed, known, "key", "left")
    return judged.filter(has_website(F.col("website")) | F.coalesce("_ok", F.lit(False))).drop(
        "key", "_ok"
    )


def keep_mentioned(
    rows: DataFrame, row_id: str, name: str, corpus: DataFrame, text: str, min_length: int = 2
) -> DataFrame:
    """Rows one of whose name tokens is a word of the corpus, or that have no token at all.

    Only distinct words meet: the corpus is reduced to its vocabulary first, so a frequent word
    costs one row on that side.
    """
    vocabulary = corpus.select(
        F.explode(F.array_distinct(name_tokens(F.col(text), min_length=min_length))).alias("token")
    ).distinct()
    tokens = rows.select(row_id, name_tokens(F.col(name), min_length=min_length).alias("_tokens"))
    asked = tokens.select(row_id, F.explode(F.array_distinct("_tokens")).alias("token"))
    found = asked.join(vocabulary, "token", "left_semi").select(row_id).distinct()
    bare = tokens.filter(F.size("_tokens") == 0).select(row_id)
    return rows.join(found.union(bare), row_id, "left_semi")
