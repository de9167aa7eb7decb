"""Rule tables to rule objects. A table is read once; its size is checked before it is."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.operators.category import NormRule
from tipweave.operators.dictionary import Rule, inline_rules
from tipweave.runtime import rows_if_small

MAX_ROWS = 20_000


def _rows(df: DataFrame) -> list:
    rows = rows_if_small(df, MAX_ROWS)
    if rows is None:
        raise ValueError(f"a rule table of more than {MAX_ROWS} rows cannot be a plan constant")
    return rows


def phrase_sets(table: DataFrame) -> dict[str, list[str]]:
    """``(set_name, phrase)`` to lists, in the order of an optional ``place`` column."""
    place = F.col("place") if "place" in table.columns else F.lit(0)
    rows = _rows(table.select("set_name", "phrase", place.alias("place")))
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: r.place):
        out.setdefault(r.set_name, []).append(r.phrase)
    return out


def extended(rules, sets: dict[str, list[str]]):
    """Rules with the phrases of the sets added to the fields of the same names."""
    known = {f.name for f in fields(rules)}
    unknown = set(sets) - known
    if unknown:
        raise ValueError(f"no such rule sets: {sorted(unknown)}")
    return replace(rules, **{k: (*getattr(rules, k), *v) for k, v in sets.items()})


def keyword_rules(table: DataFrame, guards: dict[str, str] | None = None) -> list[Rule]:
    """``(priority, keyword, label[, guard])`` to rules, with guards of well-known keywords."""
    rules = inline_rules(table)
    if rules is None:
        raise ValueError("keyword table too big to inline: use dictionary.label_rows")
    guards = guards or {}
    return [replace(r, guard=r.guard or guards.get(r.keyword)) for r in rules]


def aliases(table: DataFrame) -> list[tuple[str, str]]:
    """``(canonical, alias[, place])`` to pairs."""
    place = F.col("place") if "place" in table.columns else F.lit(0)
    rows = _rows(table.select("canonical", "alias", place.alias("place")))
    return [(r.canonical, r.alias) for r in sorted(rows, key=lambda r: r.place)]


def norm_rules(table: DataFrame) -> list[NormRule]:
    """``(rule_id, target, scope, include, exclude)`` in rule order."""
    rows = _rows(table.select("rule_id", "target", "scope", "include", "exclude"))
    return [
        NormRule(r.target, tuple(r.scope), tuple(r.include), tuple(r.exclude or ()))
        for r in sorted(rows, key=lambda r: r.rule_id)
    ]
