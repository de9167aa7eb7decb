"""Contacts: chat messages and cards to a catalogue of recommended contacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.functions.text import blank, non_blank
from tipweave.operators import category as cat
from tipweave.operators import mentions as m
from tipweave.operators.dictionary import Rule
from tipweave.operators.duplicates import apply_merge
from tipweave.operators.notes import fold_notes, note_heads, note_texts
from tipweave.operators.sequence import numbered
from tipweave.operators.verdicts import with_verdicts
from tipweave.runtime import durable
from tipweave.sources.cards import lookup


@dataclass(frozen=True)
class ContactRules:
    request_markers: Sequence[str]
    place_markers: Sequence[str]
    keywords: Sequence[Rule]
    guards: Sequence[cat.Guard] = ()
    sub_labels: Sequence[cat.SubRule] = ()
    recommend: Sequence[str] = field(default_factory=tuple)
    limit: int | None = None
    spellings: dict[str, str] = field(default_factory=dict)


def candidates(messages: DataFrame, contacts: DataFrame, r: ContactRules) -> DataFrame:
    """Mentions of known contacts with a valid phone, their context and note."""
    found = m.find_mentions(messages)
    if r.limit is not None:
        found = found.orderBy(*m.ORDER).limit(r.limit)
    known = durable(m.valid_candidates(m.with_contacts(found, lookup(contacts))))
    seen = m.with_context(known, messages)
    return seen.withColumn(
        "note", m.build_note(F.col("body"), F.col("ctx_before"), r.request_markers)
    )


def build_contacts(
    messages: DataFrame,
    contacts: DataFrame,
    r: ContactRules,
    verdicts: DataFrame | None = None,
    use_judged_field: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(entries, note_parts)``: one entry per phone, with its folded note.

    Without ``verdicts`` the rule gate decides. The candidates are cut off with a checkpoint, as
    entries, folds and labels all start from them.
    """
    all_candidates = durable(candidates(messages, contacts, r))
    if verdicts is None:
        gate = m.gate_columns(r.recommend, r.request_markers)
        gate["judged_field"] = gate.pop("field")
        judged = all_candidates.withColumns(gate)
    else:
        judged = with_verdicts(all_candidates, verdicts)
    first = m.first_included(judged)
    later = m.later_mentions(judged, first)
    kept = durable(fold_notes(first, later, "phone_key", m.ORDER, "note"))
    texts = note_texts(kept, "phone_key", m.ORDER, "note")
    heads = note_heads(kept, "phone_key", m.ORDER, "note").withColumnRenamed("note", "_head")
    grown = (
        kept.groupBy("phone_key").agg((F.count(F.lit(1)) > 1).alias("_folded"))
    )
    stem = F.regexp_replace("contact.vcf_filename", r"\.(vcf|VCF)", "")
    at_first = cat.entry_category(
        F.col("name"),
        stem,
        F.concat_ws(" ", "contact.title_vcf", "contact.org"),
        F.col("note"),
        m.bodies(F.col("ctx_before")),
        m.bodies(F.col("ctx_after")),
        r.keywords,
        r.spellings,
    )
    if use_judged_field:
        at_first = F.coalesce(non_blank(blank(F.col("judged_field"))), at_first)
    local = m.mentions_place(
        F.col("body"), [F.col("ctx_before"), F.col("ctx_after")], r.place_markers
    )
    entries = (
        first.withColumn("_first_field", cat.guarded(at_first, F.col("name"), F.col("note"), r.guards))
        .withColumn("from_local", local)
        .drop("note")
        .join(texts, "phone_key")
        .join(heads, "phone_key")
        .join(grown, "phone_key")
    )
    again = cat.cascade(
        [
            cat.from_text(F.col("name"), r.keywords, r.spellings),
            cat.from_note(F.col("_head"), r.keywords, cat.NOTE_HEAD, r.spellings),
            F.col("_first_field"),
        ]
    )
    final = F.when(
        F.col("_folded"), cat.guarded(again, F.col("name"), F.col("_head"), r.guards)
    ).otherwise(F.col("_first_field"))
    labelled = entries.withColumn("field", final)
    out = labelled.select(
        *m.ORDER,
        "phone_key",
        "name",
        "phone",
        "field",
        "from_local",
        "note",
        cat.sub_label(F.col("name"), F.col("note"), F.col("field"), r.sub_labels).alias("extra_info"),
    )
    return out, texts


def merge_contacts(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of ``build_contacts`` with duplicate contacts merged.

    ``(catalogue, phones, notes)`` as from ``duplicates.apply_merge``, in chat order.
    """
    ordered = numbered(entries, list(m.ORDER)).drop(*m.ORDER)
    return apply_merge(durable(ordered), "seq")
