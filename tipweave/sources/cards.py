"""Contact cards (vCard text) to one row per contact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipweave.functions.phone import national
from tipweave.functions.text import blank, let, name_from_first_letter, non_blank, strip

# Fixed value: a run of at least nine phone characters, searched in the whole line.
PHONE_RUN = r"[0-9\-+\s]{9,}"


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Card files as (file_path, content)."""
    return (
        spark.read.option("pathGlobFilter", "*.{vcf,VCF}")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    )


def parse_cards(files: DataFrame) -> DataFrame:
    """One row per card: the last FN, the first usable phone, the last ORG, NOTE and TITLE.

    A file may hold several cards; each becomes a row. The lines of a card are an array inside its
    row, so parsing is a map and shuffles nothing.
    """
    cards = files.select(
        "file_path",
        F.posexplode(F.split("content", r"(?i)(?=BEGIN:VCARD)")).alias("card_no", "card"),
    ).filter(F.upper("card").contains("BEGIN:VCARD"))
    lines = F.transform(
        F.split("card", r"\r\n|[\r\n]"),
        lambda raw: let(
            strip(raw),
            lambda line: F.struct(raw.alias("raw"), line.alias("line"), _property(line).alias("prop")),
        ),
    )

    def last_value(name: str):
        own = F.filter("lines", lambda x: _is_other(x) & x["prop"].startswith(name))
        return _value(F.try_element_at(own, F.lit(-1))["line"])

    fn = F.try_element_at(F.filter("lines", lambda x: x["line"].startswith("FN:")), F.lit(-1))
    n_line = F.try_element_at(F.filter("lines", lambda x: x["raw"].startswith("N:")), F.lit(1))
    parts = F.split(F.substring(n_line["raw"], 3, 1 << 30), ";")
    given = strip(
        F.concat_ws(" ", F.try_element_at(parts, F.lit(3)), F.try_element_at(parts, F.lit(2)))
    )
    numbers = F.transform(
        F.filter("lines", _is_phone), lambda x: national(F.regexp_extract(x["line"], PHONE_RUN, 0))
    )
    return cards.select("file_path", "card_no", lines.alias("lines")).select(
        "file_path",
        "card_no",
        _value(fn["line"]).alias("fn"),
        F.coalesce(non_blank(given), F.try_element_at(parts, F.lit(2))).alias("n_name"),
        F.try_element_at(F.filter(numbers, lambda p: p != ""), F.lit(1)).alias("phone"),
        *[last_value(n).alias(c) for n, c in (("ORG", "org"), ("NOTE", "note_vcf"), ("TITLE", "title_vcf"))],
    )


def _property(line: Column) -> Column:
    return F.when(line.contains(":"), F.upper(F.substring_index(line, ":", 1))).otherwise("")


def _value(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"(?s)^[^:]*:", ""))


def _is_phone(x: Column) -> Column:
    in_name = x["prop"].contains("TEL") & ~x["prop"].contains("LABEL")
    return in_name & ~x["line"].startswith("FN:")


def _is_other(x: Column) -> Column:
    return ~x["line"].startswith("FN:") & ~_is_phone(x)


def contacts(cards: DataFrame) -> DataFrame:
    """Cards with a phone, named by FN, else N, else the file stem, with their lookup keys."""
    base = F.regexp_extract(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))),
                            r"([^/!]*)$", 1)
    stem = F.regexp_replace(base, r"\.(vcf|VCF)", "")
    named = name_from_first_letter(F.coalesce(non_blank(blank(F.col("fn"))), blank(F.col("n_name"))))
    display = F.coalesce(non_blank(named), non_blank(name_from_first_letter(stem)), stem)
    return cards.filter(F.col("phone") != "").select(
        "file_path",
        "card_no",
        F.lower(base).alias("file_key"),
        F.lower(stem).alias("stem_key"),
        display.alias("name"),
        "phone",
        blank(F.col("org")).alias("org"),
        blank(F.col("note_vcf")).alias("note_vcf"),
        blank(F.col("title_vcf")).alias("title_vcf"),
        base.alias("vcf_filename"),
    )


def archive_cards(members: DataFrame) -> DataFrame:
    """Card members of zipped exports in the shape of ``read_cards``."""
    return members.filter(F.lower("member").endswith(".vcf")).select(
        F.concat_ws("!", "archive", "member").alias("file_path"), "content"
    )


def lookup(contacts_df: DataFrame) -> DataFrame:
    """(key, contact) with one contact per key: under equal keys the last file wins.

    The winner is found by an aggregate that combines before the shuffle, so a file name that
    occurs in very many exports is no hot group.
    """
    record = F.struct("name", "phone", "org", "note_vcf", "title_vcf", "vcf_filename")
    keyed = contacts_df.select(
        F.explode(F.array_distinct(F.array("file_key", "stem_key"))).alias("key"),
        F.struct("file_path", "card_no").alias("place"),
        record.alias("contact"),
    )
    return keyed.groupBy("key").agg(F.max_by("contact", "place").alias("contact"))
