"""Attachment mentions in chats: extraction, context, contact lookup, gate, note, first entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phone import is_valid, national
from tipweave.functions.phrases import contains_any
from tipweave.functions.text import (
    DIRECTION_MARKS,
    blank,
    cap,
    name_from_first_letter,
    non_blank,
    strip,
)
from tipweave.operators.sequence import around
from tipweave.runtime import join_facts

# The attachment mark and the sizes of context, messages and notes.
# The pattern starts at a line start or where the last match ended: tried anywhere, it would read
# every line once per letter.
ATTACHED = r"(?imdU)(?:^|\G)(.+?\.vcf)\s*\(file attached\)"
BEFORE, AFTER = 5, 3
SHOWN_MESSAGE = 400
NOTE_MESSAGE, NOTE_REQUEST, NOTE_LENGTH = 150, 200, 350

ORDER = ("chat_id", "msg_seq", "pos")


def find_mentions(messages: DataFrame) -> DataFrame:
    """One row per attachment named in a message, in reading order."""
    names = F.regexp_extract_all("body", F.lit(ATTACHED), F.lit(1))
    return (
        messages.filter(F.col("body").rlike(ATTACHED))
        .select("chat_id", "msg_seq", "sender", "body", F.posexplode(names).alias("pos", "raw"))
        .withColumn("vcf_name", strip(F.translate("raw", DIRECTION_MARKS, "")))
        .withColumn("mention_id", F.concat_ws("#", "chat_id", "msg_seq", "pos"))
        .drop("raw")
    )


def with_context(
    mentions: DataFrame, messages: DataFrame, before: int = BEFORE, after: int = AFTER
) -> DataFrame:
    payload = F.struct("date_str", "sender", "body")
    return around(
        messages, mentions, ["chat_id"], "msg_seq", "mention_id", payload, before, after
    )


def render_context(ctx: Column, max_len: int = SHOWN_MESSAGE) -> Column:
    def line(m: Column) -> Column:
        text = strip(F.replace(blank(m["body"]), F.lit("\n"), F.lit(" ")))
        shown = F.when(
            F.length(text) > max_len, F.concat(F.substring(text, 1, max_len - 3), F.lit("..."))
        ).otherwise(text)
        return F.concat(F.lit("- ["), m["date_str"], F.lit("] "), m["sender"], F.lit(": "), shown)

    return F.array_join(F.transform(ctx, line), "\n")


def bodies(ctx: Column) -> Column:
    return F.transform(ctx, lambda m: m["body"])


def with_contacts(mentions: DataFrame, keyed_contacts: DataFrame) -> DataFrame:
    """Contact by file name, else by name without the suffix; mentions of unknown cards drop."""
    full = strip(F.lower("vcf_name"))
    named = mentions.withColumn("key", full).filter(F.col("key").isNotNull())
    contacts = keyed_contacts.select("key", "contact")
    by_file = named.join(contacts, "key")
    # Only what the first join leaves over is looked up again, by a key of its own.
    rest = named.join(contacts, "key", "left_anti")
    by_stem = rest.withColumn("key", F.replace("key", F.lit(".vcf"), F.lit(""))).join(contacts, "key")
    found = by_file.unionByName(by_stem).filter(F.col("contact").isNotNull()).drop("key")
    stem = strip(F.replace("vcf_name", F.lit(".vcf"), F.lit("")))
    name = name_from_first_letter(F.coalesce(non_blank(F.col("contact.name")), stem))
    return found.withColumn("name", F.coalesce(non_blank(name), stem))


def valid_candidates(found: DataFrame) -> DataFrame:
    """Mentions whose contact has a valid phone, with the phone key used for grouping."""
    return (
        found.filter(is_valid(F.col("contact.phone")))
        .withColumn("phone", F.col("contact.phone"))
        .withColumn("phone_key", national(F.col("contact.phone")))
    )


def nearest_request(ctx_before: Column, markers: Sequence[str]) -> Column:
    asks = F.filter(bodies(ctx_before), lambda t: contains_any(t, markers))
    return F.try_element_at(asks, F.lit(-1))


def build_note(body: Column, ctx_before: Column, markers: Sequence[str]) -> Column:
    """The message itself unless it carries the card, then the nearest earlier request."""
    own = F.when((body != "") & ~F.contains(body, F.lit(".vcf")), F.substring(body, 1, NOTE_MESSAGE))
    asked = F.replace(
        F.substring(nearest_request(ctx_before, markers), 1, NOTE_REQUEST), F.lit("\n"), F.lit(" ")
    )
    return cap(strip(F.concat_ws(" | ", own, asked)), NOTE_LENGTH, "...")


def mentions_place(body: Column, ctx: Sequence[Column], markers: Sequence[str]) -> Column:
    """Is any of the place markers in the message or the messages around it?"""
    around_it = F.exists(F.concat(*[bodies(c) for c in ctx]), lambda t: contains_any(t, markers))
    return contains_any(body, markers) | around_it


def gate_columns(recommend: Sequence[str], request: Sequence[str]) -> dict[str, Column]:
    """Verdict by rule, as columns of a mention with its context.

    A mention is included if recommending words are in or near the message, or a request before it.
    """
    said = contains_any(F.col("body"), recommend)
    near = F.exists(
        F.concat(bodies(F.col("ctx_before")), bodies(F.col("ctx_after"))),
        lambda t: contains_any(t, recommend),
    )
    asked = F.exists(bodies(F.col("ctx_before")), lambda t: contains_any(t, request))
    reason = (
        F.when(said, "recommended in the message")
        .when(near, "recommended near the message")
        .when(asked, "answers a request")
        .otherwise("no recommendation or request")
    )
    return {
        "include": said | near | asked,
        "field": F.lit(""),
        "reason": reason,
        "error": F.lit(None).cast("string"),
    }


def rule_gate(
    mentions: DataFrame, recommend: Sequence[str], request: Sequence[str]
) -> DataFrame:
    """A table of verdicts by rule, of the shape an outside judge delivers."""
    columns = gate_columns(recommend, request)
    return mentions.select("mention_id", *[c.alias(n) for n, c in columns.items()])


def include_all(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        "mention_id",
        F.lit(True).alias("include"),
        F.lit("").alias("field"),
        F.lit("").alias("reason"),
        F.lit(None).cast("string").alias("error"),
    )


def first_included(candidates: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The first included mention of every phone.

    Only the order columns go through the minimum, which combines before the shuffle; the rows
    themselves are then found by their full key, which no two rows share.
    """
    kept = candidates.filter("include AND error IS NULL")
    firsts = kept.groupBy("phone_key").agg(F.min(F.struct(*order)).alias("_first"))
    keys = firsts.select("phone_key", "_first.*")
    return kept.join(keys, ["phone_key", *order], "left_semi")


def later_mentions(
    candidates: DataFrame, entries: DataFrame, order: Sequence[str] = ORDER
) -> DataFrame:
    """Mentions after the entry of their phone; these fold in whatever their own verdict is."""
    firsts = entries.select("phone_key", F.struct(*order).alias("_first"))
    return (
        join_facts(candidates, firsts, "phone_key")
        .filter(F.struct(*order) > F.col("_first"))
        .drop("_first")
    )
