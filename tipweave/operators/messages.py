"""What a chat message is about: phrase and pattern predicates, and why a message is rejected.

All predicates are map-only expressions over one message. Rules are data (``MessageRules``); the
tables shipped in ``tipweave.rules.hebrew`` are one instance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipweave.functions.phrases import any_true, contains_all, contains_any
from tipweave.functions.text import fold_spaces, let


@dataclass(frozen=True)
class MessageRules:
    exclude: Sequence[str] = ()
    off_topic: Sequence[str] = ()
    off_topic_pairs: Sequence[tuple[str, str]] = ()
    polite_signs: Sequence[str] = ()
    polite_word: str = ""
    request: Sequence[str] = ()
    strong: Sequence[str] = ()
    anchors: Sequence[str] = ()
    anchor_patterns: Sequence[str] = ()
    venue_patterns: Sequence[str] = ()
    venue_tail: tuple[str, Sequence[str]] | None = None
    named_topic: Sequence[str] = ()
    loose_topic: Sequence[str] = ()
    gossip: Sequence[str] = ()
    area_patterns: Sequence[str] = ()
    opening_day: str = ""
    opening_words: Sequence[str] = ()
    where_word: str = ""
    praise: Sequence[str] = ()
    food: Sequence[str] = ()
    commerce_patterns: Sequence[str] = ()
    tribute_pairs: Sequence[tuple[str, str]] = ()


def _matches(text: Column, patterns: Sequence[str]) -> Column:
    return any_true(text.rlike(p) for p in patterns)


def excluded(body: Column, r: MessageRules) -> Column:
    return contains_any(body, r.exclude, casefold=True)


def off_topic(body: Column, r: MessageRules) -> Column:
    b = fold_spaces(body)
    pairs = any_true(contains_all(b, pair) for pair in r.off_topic_pairs)
    return contains_any(b, r.off_topic, casefold=True) | pairs


def asks_recommendation(body: Column, r: MessageRules) -> Column:
    """A polite sign counts as the polite word, so ``a tip? (folded hands)`` is a request."""
    b = fold_spaces(body)
    for sign in r.polite_signs:
        b = F.regexp_replace(b, sign, f" {r.polite_word} ")
    return contains_any(fold_spaces(b) if r.polite_signs else b, r.request)


def recommends(body: Column, r: MessageRules) -> Column:
    return contains_any(body, r.strong)


def anchored(body: Column, r: MessageRules) -> Column:
    return contains_any(body, r.anchors) | _matches(body, r.anchor_patterns)


def names_venue(body: Column, r: MessageRules) -> Column:
    found = _matches(body, r.venue_patterns)
    if r.venue_tail:
        pattern, junk = r.venue_tail
        tail = F.regexp_extract(body, pattern, 1)
        junk_tail = any_true(tail.startswith(j) for j in junk)
        found = found | ((tail != "") & ~junk_tail)
    return found


def qualifies(body: Column, r: MessageRules) -> Column:
    return names_venue(body, r) | (recommends(body, r) & anchored(body, r))


def _asks(body: Column, r: MessageRules) -> Column:
    return ~recommends(body, r) & F.contains(body, F.lit("?"))


def asks_opinion(body: Column, r: MessageRules) -> Column:
    b = fold_spaces(body)
    return _asks(body, r) & _matches(b, r.named_topic) & contains_any(b, r.gossip)


def asks_in_area(body: Column, r: MessageRules) -> Column:
    return _asks(body, r) & _matches(fold_spaces(body), r.area_patterns)


def asks_opening(body: Column, r: MessageRules) -> Column:
    if not r.opening_day:
        return F.lit(False)
    b = fold_spaces(body)
    return (
        _asks(body, r)
        & F.contains(b, F.lit(r.opening_day))
        & contains_any(b, r.opening_words)
        & _matches(b, r.loose_topic)
    )


def asks_where(body: Column, r: MessageRules) -> Column:
    if not r.where_word:
        return F.lit(False)
    b = fold_spaces(body)
    return _asks(body, r) & F.contains(b, F.lit(r.where_word)) & _matches(b, r.loose_topic)


def ends_as_question(body: Column, r: MessageRules) -> Column:
    return ~recommends(body, r) & fold_spaces(body).endswith("?")


def reject_reason(body: Column, r: MessageRules) -> Column:
    """First filter that rejects the message, null if none does."""
    checks = {
        "excluded": excluded,
        "off_topic": off_topic,
        "request": asks_recommendation,
        "where": asks_where,
        "opinion": asks_opinion,
        "area": asks_in_area,
        "opening": asks_opening,
        "question": ends_as_question,
    }
    return let(
        body,
        lambda b: F.coalesce(*[F.when(check(b, r), F.lit(name)) for name, check in checks.items()]),
    )


def loose_context(body: Column, r: MessageRules, permissive: bool = False) -> Column:
    if permissive:
        praised = contains_any(body, r.praise) & contains_any(body, r.food)
        return names_venue(body, r) | anchored(body, r) | praised
    return qualifies(body, r)


def commerce_cue(body: Column, r: MessageRules) -> Column:
    return names_venue(body, r) | _matches(fold_spaces(body), r.commerce_patterns)


def is_tribute(body: Column, r: MessageRules) -> Column:
    b = fold_spaces(body)
    return any_true(contains_all(b, pair) for pair in r.tribute_pairs)
