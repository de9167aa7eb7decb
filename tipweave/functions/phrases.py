"""Phrase predicates: does any phrase of a set occur in a text?"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHAIN_LIMIT = 12


def alternation(phrases: Iterable[str]) -> str:
    """One regex for a phrase set, with shared beginnings written once.

    A plain ``a|b|c`` of some hundred phrases tries every phrase at every position; with shared
    beginnings a position is left after the first letter in most cases.
    """
    tree: dict = {}
    for phrase in sorted(set(phrases)):
        node = tree
        for ch in phrase:
            if "" in node:
                break
            node = node.setdefault(ch, {})
        else:
            node.clear()
            node[""] = {}
    return _render(tree)


def _render(node: dict) -> str:
    if "" in node or not node:
        return ""
    parts = [re.escape(ch) + _render(child) for ch, child in node.items()]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def contains_any(text: Column, phrases: Iterable[str], casefold: bool = False) -> Column:
    """Short sets become a chain of ``contains``; long ones a single regex."""
    wanted = [p for p in dict.fromkeys(p.lower() if casefold else p for p in phrases) if p]
    hay = F.lower(text) if casefold else text
    if not wanted:
        return F.lit(False)
    if len(wanted) <= _CHAIN_LIMIT:
        return reduce(lambda a, b: a | b, [F.contains(hay, F.lit(p)) for p in wanted])
    return hay.rlike(alternation(wanted))


def contains_all(text: Column, phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(p)) for p in phrases])


def any_true(conditions: Iterable[Column]) -> Column:
    found = list(conditions)
    return reduce(lambda a, b: a | b, found) if found else F.lit(False)


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    wanted = [p for p in prefixes if p]
    return text.rlike("^" + alternation(wanted)) if wanted else F.lit(False)


def equals_any(text: Column, values: Iterable[str]) -> Column:
    wanted = list(dict.fromkeys(values))
    return text.isin(wanted) if wanted else F.lit(False)
