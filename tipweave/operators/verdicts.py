"""Answers of an outside judge: lenient reading, joining, falling back to the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.ids import content_id
from tipweave.functions.text import blank, cap, fold_spaces, non_blank, strip
from tipweave.operators.messages import asks_recommendation, commerce_cue, is_tribute, recommends
from tipweave.operators.names import (
    clean_name,
    foreign_script_not_in_source,
    is_generic_label,
    is_plausible,
    loose_candidate_ok,
)
from tipweave.operators.venues import (
    EXTRA_CAP,
    LOCATION_CAP,
    NOTE_CAP,
    SNIPPET,
    VenueRules,
    guess_place,
    guess_type,
    place_near_name,
)

# Patterns of the parts of an answer that is no clean object.
_TEXT = r"""["']?%s["']?\s*:\s*"((?:[^"\\]|\\.)*)\""""
_INCLUDE = r"""(?i)["']?include["']?\s*[:=]\s*(true|false)\b"""
VENUES_SCHEMA = (
    "struct<venues: array<struct<"
    "name: string, location: string, restaurant_type: string, extra_info: string>>>"
)


def json_object(raw: Column) -> Column:
    """The outermost braces of an answer, preferring those inside a fenced block."""
    text = strip(blank(raw))
    fenced = F.regexp_extract(text, r"(?s)```\s*(?:json)?\s*(\{.*?)```", 1)
    return F.regexp_extract(F.coalesce(non_blank(fenced), text), r"(?s)(\{.*\})", 1)


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def read_verdict(raw: Column) -> Column:
    """``struct(include, field, reason, error)`` of an answer.

    A readable object is taken as it is; otherwise the parts are picked out of the text.
    """
    text = strip(blank(raw))
    found = json_object(raw)
    parsed = F.from_json(found, "struct<include: string, field: string, reason: string>")
    readable = F.try_parse_json(F.when(found != "", found)).isNotNull()
    # A text counts by being there, even the text "false"; other values by being no zero.
    value = blank(parsed["include"])
    written = found.rlike(r'"include"\s*:\s*"')
    truth = F.when(written, value != "").otherwise(
        ~F.lower(value).isin("", "false", "null", "[]", "{}")
        & (F.coalesce(value.try_cast("double"), F.lit(1.0)) != 0)
    )
    blob = F.coalesce(non_blank(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), text)
    loose = F.lower(F.coalesce(
        non_blank(F.regexp_extract(blob, _INCLUDE, 1)), non_blank(F.regexp_extract(text, _INCLUDE, 1))
    ))

    def picked(key: str) -> Column:
        taken = _unescape(F.regexp_extract(blob, "(?s)" + _TEXT % key, 1))
        return strip(F.when(readable, blank(parsed[key])).otherwise(taken))

    include = F.coalesce(F.when(readable, truth).otherwise(loose == "true"), F.lit(False))
    judged = (readable | loose.isNotNull()) & (text != "")
    return F.struct(
        F.when(judged, include).alias("include"),
        # Only an included mention has a category.
        F.when(judged, F.when(include, picked("field")).otherwise("")).alias("field"),
        F.when(judged, picked("reason")).alias("reason"),
        F.when(text == "", "empty answer").when(~judged, "no verdict in the answer").alias("error"),
    )


def read_venues(raw: Column) -> Column:
    """Venues of an answer with a name, as an array of structs; unreadable answers give none."""
    found = F.from_json(json_object(raw), VENUES_SCHEMA)["venues"]
    tidy = F.transform(
        found,
        lambda v: F.struct(
            *[
                strip(blank(v[c])).alias(c)
                for c in ("name", "location", "restaurant_type", "extra_info")
            ]
        ),
    )
    return F.filter(tidy, lambda v: v["name"] != "")


def with_verdicts(mentions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict columns joined to the mentions; a mention that was never judged is not included."""
    v = verdicts.select(
        "mention_id", "include", F.col("field").alias("judged_field"), "reason", "error"
    )
    return mentions.join(v, "mention_id", "left").withColumn(
        "include", F.coalesce("include", F.lit(False))
    )


def candidates_to_judge(
    messages: DataFrame, strict: DataFrame, loose: DataFrame | None = None
) -> DataFrame:
    """Messages to be judged: those with rule rows, with the names as hints, and loose ones."""
    ranked = strict.groupBy("chat_id", "msg_seq", F.lower("name").alias("_k")).agg(
        F.min(F.struct("name_no", "name")).alias("_first")
    )
    hints = ranked.groupBy("chat_id", "msg_seq").agg(
        F.transform(F.array_sort(F.collect_list("_first")), lambda f: f["name"]).alias("hints")
    )
    with_hints = messages.join(hints, ["chat_id", "msg_seq"]).withColumn("is_loose", F.lit(False))
    if loose is None:
        return with_hints
    extra = loose.join(hints, ["chat_id", "msg_seq"], "left_anti")
    return with_hints.unionByName(
        extra.withColumns(
            {"hints": F.lit(None).cast("array<string>"), "is_loose": F.lit(True)}
        )
    )


def verified_rows(judged: DataFrame, r: VenueRules, label: str, salt: str = "llm2:") -> DataFrame:
    """Venue rows from judged messages (``body, sender, date_str, is_loose, answer``).

    Names are cleaned and checked again; blank places, types and texts come from the message.
    """
    body = F.col("body")
    loose = F.col("is_loose")
    fit = judged.filter(
        ~loose
        | (
            ~asks_recommendation(body, r.messages)
            & ~is_tribute(body, r.messages)
            & commerce_cue(body, r.messages)
        )
    )
    rows = fit.select(
        "*",
        guess_type(body, r.types).alias("_type"),
        guess_place(body, r.places).alias("_place"),
        F.posexplode(read_venues(F.col("answer"))).alias("name_no", "_v"),
    ).withColumn(
        "_name",
        fold_spaces(F.coalesce(clean_name(F.col("_v.name"), r.names, r.scrub), F.col("_v.name"))),
    )
    name = F.col("_name")
    asks = fold_spaces(body).endswith("?") & ~recommends(body, r.messages)
    ok = rows.filter(
        F.length(name).between(2, 120)
        & ~foreign_script_not_in_source(name, body)
        & is_plausible(name, r.names)
        & ~is_generic_label(name, r.names)
        & (~loose | loose_candidate_ok(name, body, asks, r.names))
    )
    place = F.coalesce(
        non_blank(F.col("_v.location")),
        non_blank(place_near_name(body, name, r.places)),
        F.col("_place"),
    )
    return ok.select(
        "chat_id",
        "msg_seq",
        "name_no",
        content_id(
            F.concat(F.lit(salt), name, F.col("date_str"), F.substring("sender", 1, 20))
        ).alias("id"),
        name.alias("name"),
        cap(F.coalesce(non_blank(F.col("_v.restaurant_type")), F.col("_type")), 150).alias(
            "restaurant_type"
        ),
        cap(place, LOCATION_CAP).alias("location"),
        cap(F.concat_ws(" · ", F.lit(label), "sender", "date_str"), NOTE_CAP).alias("note"),
        cap(
            F.coalesce(non_blank(F.col("_v.extra_info")), F.substring(body, 1, SNIPPET)), EXTRA_CAP
        ).alias("extra_info"),
    )


def rows_with_fallback(
    verified: DataFrame, strict: DataFrame, answers: DataFrame
) -> DataFrame:
    """Verified rows, and the rule rows of those messages whose answer is an error."""
    failed = answers.filter("error IS NOT NULL").select("chat_id", "msg_seq")
    kept = strict.join(failed, ["chat_id", "msg_seq"], "left_semi")
    return verified.join(failed, ["chat_id", "msg_seq"], "left_anti").unionByName(
        kept, allowMissingColumns=True
    )
