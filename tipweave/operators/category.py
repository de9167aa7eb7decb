"""Categories of entries: cascade over sources, guards, sub-labels, normaliser rules, clean-up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phrases import contains_all, contains_any
from tipweave.functions.text import blank, fold_spaces, let, non_blank, only_emoji, strip, unify_spelling
from tipweave.operators.dictionary import Rule, first_label, voted_label
from tipweave.runtime import rows_if_small

# How much of a folded note or of the context counts.
NOTE_HEAD = 420
SUBLABEL_NOTE = 600


def _tidy(text: Column, spellings: dict[str, str] | None) -> Column:
    return unify_spelling(fold_spaces(text), spellings or {})


def from_text(
    text: Column, rules: Sequence[Rule], spellings: dict[str, str] | None = None
) -> Column:
    return let(_tidy(text, spellings), lambda t: first_label(t, rules))


def from_note(
    note: Column,
    rules: Sequence[Rule],
    max_chars: int | None = NOTE_HEAD,
    spellings: dict[str, str] | None = None,
) -> Column:
    return let(_tidy(note, spellings), lambda t: voted_label(t, rules, max_chars))


def from_context(
    texts: Column,
    rules: Sequence[Rule],
    max_chars: int = NOTE_HEAD,
    spellings: dict[str, str] | None = None,
) -> Column:
    joined = _tidy(F.array_join(texts, " "), spellings)
    return let(F.right(joined, F.lit(max_chars)), lambda t: first_label(t, rules))


def cascade(sources: Sequence[Column]) -> Column:
    """First source with a label; later sources are evaluated only where earlier ones are empty."""
    return F.coalesce(*[non_blank(s) for s in sources], F.lit(""))


def entry_category(
    name: Column,
    stem: Column,
    title_org: Column,
    note: Column,
    before: Column,
    after: Column,
    rules: Sequence[Rule],
    spellings: dict[str, str] | None = None,
) -> Column:
    return cascade(
        [
            from_text(name, rules, spellings),
            from_text(stem, rules, spellings),
            from_text(title_org, rules, spellings),
            from_note(note, rules, NOTE_HEAD, spellings),
            from_context(before, rules, NOTE_HEAD, spellings),
            from_context(after, rules, NOTE_HEAD, spellings),
        ]
    )


@dataclass(frozen=True)
class Guard:
    """Keep ``label`` only if a marker is in the name or note; ``head`` limits the note."""

    label: str
    markers: Sequence[str]
    head: int | None = NOTE_HEAD


def guarded(label: Column, name: Column, note: Column, guards: Sequence[Guard]) -> Column:
    n, whole = fold_spaces(name), fold_spaces(note)

    def seen(g: Guard) -> Column:
        text = whole if g.head is None else F.substring(whole, 1, g.head)
        return contains_any(F.concat_ws(" ", n, text), g.markers, casefold=True)

    return let(
        label,
        lambda x: F.coalesce(
            *[F.when((x == g.label) & ~seen(g), F.lit("")) for g in guards], x
        ),
    )


# --- sub-labels -------------------------------------------------------------------------------


@dataclass(frozen=True)
class SubRule:
    """Within ``category``, in priority order: all of ``all_of`` and none of ``none_of`` in scope.

    ``scope`` is ``name``, ``note`` (name and note head) or ``raw`` (lower case, whole note).
    An empty ``label`` stops the search.
    """

    category: str
    priority: int
    scope: str
    all_of: Sequence[str]
    label: str
    none_of: Sequence[str] = ()


def sub_label(
    name: Column,
    note: Column,
    category: Column,
    rules: Sequence[SubRule],
    note_chars: int | None = SUBLABEL_NOTE,
) -> Column:
    """Sub-label of an entry. Only the rules of its own category are tried."""
    n = fold_spaces(name)
    head = blank(note) if note_chars is None else F.substring(blank(note), 1, note_chars)
    scopes = {
        "name": n,
        "note": strip(F.concat_ws(" ", n, fold_spaces(head))),
        "raw": F.lower(F.concat_ws(" ", blank(name), blank(note))),
    }
    by_category: dict[str, list[SubRule]] = {}
    for r in sorted(rules, key=lambda r: r.priority):
        by_category.setdefault(r.category, []).append(r)
    cat = strip(blank(category))
    out = F.lit("")
    for wanted, own in by_category.items():
        tries = []
        for r in own:
            text = scopes[r.scope]
            cond = contains_all(text, r.all_of)
            if r.none_of:
                cond = cond & ~contains_any(text, r.none_of)
            tries.append(F.when(cond, F.lit(r.label)))
        out = F.when(cat == wanted, F.coalesce(*tries, F.lit(""))).otherwise(out)
    return out


def sub_rules(table: DataFrame, max_rows: int = 5_000) -> list[SubRule]:
    """Sub-label rules from ``(category, priority, scope, all_of, none_of, label)``."""
    rows = rows_if_small(
        table.select("category", "priority", "scope", "all_of", "label", "none_of"), max_rows
    )
    if rows is None:
        raise ValueError(f"more than {max_rows} sub-label rules: use match_sub_rules")
    return [
        SubRule(r.category, r.priority, r.scope, tuple(r.all_of), r.label, tuple(r.none_of or ()))
        for r in rows
    ]


def match_sub_rules(
    entries: DataFrame, row_id: str, table: DataFrame, note_chars: int | None = SUBLABEL_NOTE
) -> DataFrame:
    """Sub-labels for rule tables of any size: an equi-join on the category, then containment.

    The rows of one category may be many; the join splits them, and the best rule is a minimum.
    """
    n = fold_spaces(F.col("name"))
    head = F.col("note") if note_chars is None else F.substring(F.col("note"), 1, note_chars)
    texts = entries.select(
        row_id,
        strip(blank(F.col("field"))).alias("category"),
        n.alias("_name"),
        strip(F.concat_ws(" ", n, fold_spaces(head))).alias("_note"),
        F.lower(F.concat_ws(" ", blank(F.col("name")), blank(F.col("note")))).alias("_raw"),
    )
    text = F.when(F.col("scope") == "name", F.col("_name")).when(
        F.col("scope") == "raw", F.col("_raw")
    ).otherwise(F.col("_note"))
    fits = F.forall("all_of", lambda w: F.contains(text, w)) & ~F.exists(
        F.coalesce("none_of", F.array().cast("array<string>")), lambda w: F.contains(text, w)
    )
    best = (
        texts.join(table, "category")
        .filter(fits)
        .groupBy(row_id)
        .agg(F.min_by("label", "priority").alias("sub_label"))
    )
    return entries.join(best, row_id, "left").withColumn("sub_label", blank(F.col("sub_label")))


# --- clean-up and normaliser rules ------------------------------------------------------------


def drop_null_words(category: Column) -> Column:
    c = blank(category)
    return F.when(F.lower(strip(c)) == "null", "").otherwise(c)


def drop_emoji_only(category: Column) -> Column:
    return F.when(only_emoji(category), "").otherwise(category)


# Marks the start and the end of a scope text, so that phrases can ask for them.
START, END = "\u0002", "\u0003"


@dataclass(frozen=True)
class NormRule:
    """Set the category to ``target`` where a phrase of ``include`` is in a scope column.

    A phrase may begin with ``START`` or end with ``END``. ``unless`` maps a phrase to a longer
    word it must not be part of. ``exclude`` is looked for in name and category together, or in
    the category alone if that is the whole scope. ``unless_name_says`` skips rows whose name
    alone gives another category.
    """

    target: str
    scope: Sequence[str] = ("name", "field")
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    unless: Sequence[tuple[str, str]] = ()
    unless_name_says: bool = False


def normalise(
    entries: DataFrame, rules: Sequence[NormRule], name_rules: Sequence[Rule] = ()
) -> DataFrame:
    """Apply the rules in order; each sees the category the earlier ones left.

    The rules are one constant array folded over the category, so the expression stays the same
    size however many rules there are.
    """
    if not rules:
        return entries
    texts = F.struct(
        strip(blank(F.col("name"))).alias("name"),
        (strip(blank(F.col("note"))) if any("note" in r.scope for r in rules) else F.lit("")).alias(
            "note"
        ),
        (
            from_text(F.col("name"), name_rules)
            if any(r.unless_name_says for r in rules)
            else F.lit("")
        ).alias("by_name"),
    )
    table = F.array(*[_rule_struct(r) for r in rules])
    out = let(
        texts, lambda t: F.aggregate(table, blank(F.col("field")), lambda f, r: _apply_rule(f, t, r))
    )
    return entries.withColumn("field", out)


def _rule_struct(r: NormRule) -> Column:
    words = [(w, "") for w in r.include] + list(r.unless)
    return F.struct(
        F.lit(r.target).alias("target"),
        *[F.lit(s in r.scope).alias(s) for s in ("name", "field", "note")],
        F.arrays_zip(
            F.lit([w for w, _ in words]).alias("word"), F.lit([u for _, u in words]).alias("unless")
        ).alias("include"),
        F.lit(list(r.exclude) or [""]).alias("exclude"),
        F.lit(r.unless_name_says).alias("by_name"),
    )


def _apply_rule(current: Column, texts: Column, r: Column) -> Column:
    def has(text: Column) -> Column:
        framed = F.concat(F.lit(START), text, F.lit(END))
        return F.exists(
            r["include"],
            lambda i: F.contains(framed, i["word"])
            & ((i["unless"] == "") | ~F.contains(text, i["unless"])),
        )

    hit = (
        (r["field"] & has(strip(current)))
        | (r["name"] & has(texts["name"]))
        | (r["note"] & has(texts["note"]))
    )
    checked = F.when(r["name"], F.concat_ws(" ", texts["name"], current)).otherwise(current)
    barred = F.exists(r["exclude"], lambda w: (w != "") & F.contains(checked, w))
    fits = ~r["by_name"] | texts["by_name"].isin("") | (texts["by_name"] == r["target"])
    return F.when(hit & ~barred & fits, r["target"]).otherwise(current)


def fill_empty(
    entries: DataFrame, rules: Sequence[Rule], spellings: dict[str, str] | None = None
) -> DataFrame:
    """Category for entries without one: from the name, else by vote over the note."""
    name, note = F.col("name"), F.col("note")
    found = cascade(
        [from_text(name, rules, spellings), from_note(note, rules, NOTE_HEAD, spellings)]
    )
    empty = strip(blank(F.col("field"))) == ""
    return entries.withColumn("field", F.when(empty, found).otherwise(F.col("field")))


def refresh_sub_labels(entries: DataFrame, rules: Sequence[SubRule]) -> DataFrame:
    return entries.withColumn(
        "extra_info", sub_label(F.col("name"), F.col("note"), F.col("field"), rules)
    )


def shadowed_rules(rules: DataFrame) -> DataFrame:
    """Rules that can never be the first match: an earlier keyword is part of theirs.

    Found by an equi-join on the substrings of each keyword, which are few as keywords are short.
    """
    later = rules.filter("guard IS NULL" if "guard" in rules.columns else "true").select(
        "priority", "keyword", "label"
    )
    size = F.length("keyword")
    parts = F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.transform(
                    F.sequence(F.lit(1), size - i + 1), lambda n: F.substring("keyword", i, n)
                ),
            )
        )
    )
    pieces = later.withColumn("_part", F.explode(parts))
    earlier = later.select(
        F.col("priority").alias("by_priority"),
        F.col("keyword").alias("_part"),
        F.col("label").alias("by_label"),
    )
    return (
        pieces.join(earlier, "_part")
        .filter(F.col("by_priority") < F.col("priority"))
        .groupBy("priority", "keyword", "label")
        .agg(F.min(F.struct("by_priority", "by_label")).alias("_by"))
        .select("priority", "keyword", "label", "_by.by_priority", "_by.by_label")
    )
