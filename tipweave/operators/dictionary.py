"""Text against a rule dictionary: first matching label, label vote, longest alias.

A rule table is a DataFrame ``(priority, keyword, label, guard)``. A table of at most
``MAX_INLINE_RULES`` rows is read once and becomes a constant of the plan: matching is then a map
over the texts with no join, no row blow-up and no shuffle. A bigger table is matched by an
equi-join on character grams (``match_by_grams``), which gives the same matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phrases import any_true, contains_any
from tipweave.functions.text import blank, let, occurrences
from tipweave.runtime import durable, is_small, rows_if_small

MAX_INLINE_RULES = 2_000
MAX_BROADCAST_RULES = 200_000
#: More rules than this are looked for by one pattern first, as most texts hold none of them.
FEW_RULES = 64
GRAM = 3
LONG_GRAMS = (4, 5, 6, 8, 12, 16)
#: Rows of 64 bits that tell which runs a big rule table may hold.
SKETCH_WORDS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """``guard`` is a regex that counts the keyword only where it is a word of its own."""

    priority: int
    keyword: str
    label: str
    guard: str | None = None


def inline_rules(rules: DataFrame, max_rows: int = MAX_INLINE_RULES) -> list[Rule] | None:
    """The rules in priority order, or None if the table is too big to be a plan constant."""
    wanted = rules.select(
        F.col("priority").cast("long").alias("priority"),
        "keyword",
        "label",
        F.col("guard") if "guard" in rules.columns else F.lit(None).cast("string").alias("guard"),
    ).filter("keyword <> ''")
    rows = rows_if_small(wanted, max_rows)
    if rows is None:
        return None
    return sorted((Rule(*r) for r in rows), key=lambda r: r.priority)


def _constant(rules: Sequence[Rule], casefold: bool) -> Column:
    def word(r: Rule) -> str:
        return r.keyword.lower() if casefold else r.keyword

    return F.arrays_zip(
        F.lit([r.priority for r in rules]).alias("priority"),
        F.lit([word(r) for r in rules]).alias("keyword"),
        F.lit([r.label for r in rules]).alias("label"),
    )


def _hits(text: Column, rules: Sequence[Rule], casefold: bool) -> Column:
    """Array of (priority, label, n) of the rules found in the text.

    The rules are looked for in a lambda, so the text is put in lower case before it, once."""
    return let(F.lower(text), lambda hay: _found(hay, rules, True)) if casefold else _found(text, rules, False)


def _found(hay: Column, rules: Sequence[Rule], casefold: bool) -> Column:
    plain = [r for r in rules if not r.guard]
    guarded = [r for r in rules if r.guard]
    found = []
    if plain:
        present = F.filter(_constant(plain, casefold), lambda r: F.contains(hay, r["keyword"]))
        found.append(
            F.transform(
                present,
                lambda r: F.struct(
                    r["priority"].cast("long").alias("priority"),
                    r["label"].alias("label"),
                    occurrences(hay, r["keyword"]).cast("long").alias("n"),
                ),
            )
        )
    if guarded:
        counted = [
            F.struct(
                F.lit(r.priority).cast("long").alias("priority"),
                F.lit(r.label).alias("label"),
                F.regexp_count(hay, F.lit(r.guard)).cast("long").alias("n"),
            )
            for r in guarded
        ]
        found.append(F.filter(F.array(*counted), lambda h: h["n"] > 0))
    return found[0] if len(found) == 1 else F.concat(*found)


def _anything(text: Column, rules: Sequence[Rule], casefold: bool) -> Column:
    """False only if no rule is found; few rules are looked for one by one at once."""
    if len(rules) <= FEW_RULES:
        return F.lit(True)
    plain = contains_any(text, [r.keyword for r in rules if not r.guard], casefold)
    hay = F.lower(text) if casefold else text
    return plain | any_true(hay.rlike(r.guard) for r in rules if r.guard)


def first_label(text: Column, rules: Sequence[Rule]) -> Column:
    """Label of the first rule found, as written; if none, of the first found in lower case."""
    if not rules:
        return F.lit("")
    t = blank(text)

    def best(casefold: bool) -> Column:
        hits = F.transform(
            _hits(t, rules, casefold),
            lambda h: F.struct(h["priority"].alias("priority"), h["label"].alias("label")),
        )
        return F.when(_anything(t, rules, casefold), F.array_min(hits)["label"])

    return F.coalesce(best(False), best(True), F.lit(""))


def voted_label(text: Column, rules: Sequence[Rule], max_chars: int | None = None) -> Column:
    """Label with most occurrences in lower case; on a tie the label of the earliest rule.

    ``max_chars`` keeps only the head of folded notes, where later chat topics would outvote the
    first; None counts over the whole text.
    """
    if not rules:
        return F.lit("")
    t = blank(text) if max_chars is None else F.substring(blank(text), 1, max_chars)

    def winner(hits: Column) -> Column:
        def tally(label: Column) -> Column:
            own = F.filter(hits, lambda h: h["label"] == label)
            total = F.aggregate(own, F.lit(0).cast("long"), lambda acc, h: acc + h["n"])
            earliest = F.array_min(F.transform(own, lambda h: h["priority"]))
            return F.struct(total.alias("n"), (-earliest).alias("rank"), label.alias("label"))

        labels = F.array_distinct(F.transform(hits, lambda h: h["label"]))
        return F.array_max(F.transform(labels, tally))["label"]

    found = let(_hits(t, rules, True), winner)
    return F.coalesce(F.when(_anything(t, rules, True), found), F.lit(""))


def grams(text: Column, sizes: Sequence[int]) -> Column:
    """Distinct runs of letters of the given sizes, read in one pass per size."""
    runs = [
        F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes
    ]
    return F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])


def match_by_grams(
    texts: DataFrame, row_id: str, text: str, rules: DataFrame, gram: int = GRAM
) -> DataFrame:
    """All (row, rule) pairs where the keyword occurs in the text, for rule tables of any size.

    Both sides meet on one run of letters of the keyword, the one that the fewest rules share; then
    the occurrence is checked. A run is as long as the keyword has room for: up to ``gram`` any
    size, above that one of ``LONG_GRAMS``, as there are too few short runs for many rules. Of the
    texts only runs of sizes that the rules have are made, and a rule table too big for a broadcast
    is sent only those that its sketch holds.
    Returns ``row_id, priority, label, keyword, n``.
    """
    candidates = _candidates(texts, row_id, text, rules, gram)
    # A guarded keyword counts where its guard matches, which is where the keyword stands alone.
    n = F.when(F.col("guard").isNull(), occurrences(F.col(text), F.col("keyword"))).otherwise(
        F.regexp_count(F.col(text), F.coalesce("guard", F.lit("")))
    )
    # Sorted, as short texts are far smaller as files than in the driver, which a broadcast passes.
    return (
        candidates.join(texts.select(row_id, text).hint("merge"), row_id)
        .filter(F.contains(text, F.col("keyword")))
        .withColumn("n", n.cast("long") * F.col("_times"))
        .filter("n > 0")
        .select(row_id, "priority", "label", "keyword", "n")
    )


def _candidates(texts: DataFrame, row_id: str, text: str, rules: DataFrame, gram: int) -> DataFrame:
    """The rows of ``texts`` by id, with each rule whose run they hold."""
    guard = F.col("guard") if "guard" in rules.columns else F.lit(None).cast("string")
    numbered = (
        rules.filter("keyword <> ''")
        .groupBy(F.col("priority").cast("long").alias("priority"), "label", "keyword", guard.alias("guard"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    own = F.array("keyword")
    for size in [*range(2, gram + 1), *[g for g in LONG_GRAMS if g > gram]]:
        own = F.when(F.length("keyword") >= size, grams(F.col("keyword"), [size])).otherwise(own)
    offered = numbered.withColumn("_gram", F.explode(own))
    shared = offered.groupBy("_gram").agg(F.count(F.lit(1)).alias("_sharing"))
    anchors = durable(
        offered.join(shared.hint("merge"), "_gram")
        .groupBy("priority", "label", "keyword", "guard", "_times")
        .agg(F.min_by("_gram", F.struct("_sharing", "_gram")).alias("_gram"))
    )
    sizes = sorted(r[0] for r in anchors.select(F.length("_gram")).distinct().collect())
    # The exploded side is far bigger than the planner can know, so the rule side is the one to
    # build from: in every task if it is small, else per partition of the grams.
    spread = texts.select(row_id, F.explode(grams(F.col(text), sizes or [gram])).alias("_gram"))
    if is_small(anchors, MAX_BROADCAST_RULES):
        return spread.join(F.broadcast(anchors), "_gram").drop("_gram")
    return _sketched(spread, anchors).join(anchors.hint("shuffle_hash"), "_gram").drop("_gram")


def _sketched(spread: DataFrame, anchors: DataFrame) -> DataFrame:
    """The runs that the anchors may hold: all that they hold, and few others.

    Each anchor sets one bit, by its hash; the bits are a table of at most ``SKETCH_WORDS`` rows of
    64, which every task can have. Very many anchors set them all, and then all runs are sent.
    """
    slot = F.pmod(F.xxhash64("_gram"), F.lit(64 * SKETCH_WORDS))
    placed = {"_word": F.shiftright(slot, 6), "_at": (slot % 64).cast("int")}
    marked = anchors.withColumns(placed).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_bits")
    )
    return (
        spread.withColumns(placed).join(F.broadcast(marked), "_word")
        .filter(F.expr("shiftright(_bits, _at) & 1L = 1L"))
        .drop("_word", "_at", "_bits")
    )


def vote_from_matches(matches: DataFrame, row_id: str) -> DataFrame:
    """(row_id, label) by most occurrences, ties to the earliest rule."""
    totals = matches.groupBy(row_id, "label").agg(
        F.sum("n").alias("n"), F.min("priority").alias("first")
    )
    return totals.groupBy(row_id).agg(
        F.max(F.struct("n", -F.col("first"), "label"))["label"].alias("label")
    )


def first_from_matches(matches: DataFrame, row_id: str) -> DataFrame:
    return matches.groupBy(row_id).agg(
        F.min(F.struct("priority", "label"))["label"].alias("label")
    )


def label_rows(df: DataFrame, row_id: str, text: str, rules: DataFrame, mode: str) -> DataFrame:
    """Add ``label`` to every row; ``mode`` is ``first`` or ``vote``.

    ``row_id`` must be unique. A small rule table is inlined, a big one joined by grams.
    """
    small = inline_rules(rules)
    if small is not None:
        label = first_label if mode == "first" else voted_label
        return df.withColumn("label", label(F.col(text), small))
    lowered = rules.withColumn("keyword", F.lower("keyword"))
    folded = df.select(row_id, F.lower(blank(F.col(text))).alias("_folded"))
    loose = match_by_grams(folded, row_id, "_folded", lowered)
    if mode == "vote":
        best = vote_from_matches(loose, row_id)
    else:
        plain = df.select(row_id, blank(F.col(text)).alias("_plain"))
        exact = first_from_matches(match_by_grams(plain, row_id, "_plain", rules), row_id)
        best = (
            exact.withColumnRenamed("label", "_exact")
            .join(first_from_matches(loose, row_id), row_id, "full")
            .select(row_id, F.coalesce("_exact", "label").alias("label"))
        )
    return df.join(best, row_id, "left").withColumn("label", blank(F.col("label")))


def longest_alias(text: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Longest canonical place among those with an alias in the text; ties in table order."""
    if not aliases:
        return F.lit("")
    order: dict[str, int] = {}
    for canonical, _ in aliases:
        order.setdefault(canonical, len(order))
    table = F.arrays_zip(
        F.lit([a for _, a in aliases]).alias("alias"),
        F.lit([c for c, _ in aliases]).alias("canonical"),
        F.lit([-len(c) for c, _ in aliases]).alias("size"),
        F.lit([order[c] for c, _ in aliases]).alias("place"),
    )
    t = blank(text)
    found = F.filter(table, lambda a: F.contains(t, a["alias"]))
    ranked = F.transform(
        found,
        lambda a: F.struct(
            a["size"].alias("size"), a["place"].alias("place"), a["canonical"].alias("canonical")
        ),
    )
    best = F.array_min(ranked)["canonical"]
    return F.coalesce(F.when(contains_any(t, [a for _, a in aliases]), best), F.lit(""))
