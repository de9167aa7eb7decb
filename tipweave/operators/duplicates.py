"""Duplicate contacts: same category, different phones, equal or related names.

Works on distinct ``(field, folded name, phone)`` triples, so copies of a row cost nothing, and
never lists the pairs of a group: related *names* are found by equi-joins, and the phones of two
related names are linked through a few edges that connect exactly the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.functions.phone import sort_key
from tipweave.functions.phrases import equals_any
from tipweave.functions.text import blank, fold_name, strip, words
from tipweave.operators.components import connected_components
from tipweave.operators.notes import SEPARATOR, note_texts
from tipweave.runtime import durable, join_facts

# The letter that may lead a name part, and names that say a trade only.
LEAD_LETTER = "ל"
GENERIC_NAMES = ("ניקוי ספות",)
NAMES_IN_LABEL = 4
# Names with more words are met by single words, as their pairs of words would be too many.
MOST_PAIRED = 24


def keyed(entries: DataFrame, seq: str = "seq") -> DataFrame:
    """Entries with the folded name and category used for grouping."""
    return entries.select(
        "*",
        fold_name(F.col("name")).alias("norm_name"),
        strip(blank(F.col("field"))).alias("norm_field"),
        blank(F.col("phone")).alias("norm_phone"),
        F.col(seq).cast("long").alias("_seq"),
    )


def triples(k: DataFrame) -> DataFrame:
    """Distinct ``norm_field, norm_name, norm_phone`` with their rows ``n`` and first ``seq``.

    The one pass over the entries: all groups are found from this table, which is kept.
    """
    return durable(
        k.groupBy("norm_field", "norm_name", "norm_phone").agg(
            F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first")
        )
    )


# --- exact groups ---------------------------------------------------------------------------


def exact_groups(t: DataFrame, generic: Sequence[str] = GENERIC_NAMES) -> DataFrame:
    """``norm_field, norm_name, n_phones, n_entries, first_seq`` of names with several phones."""
    named = t.filter((F.col("norm_name") != "") & ~equals_any(F.col("norm_name"), generic))
    return (
        named.groupBy("norm_field", "norm_name")
        .agg(
            F.count_if(F.col("norm_phone") != "").alias("n_phones"),
            F.sum("n").alias("n_entries"),
            F.min("first").alias("first_seq"),
        )
        .filter("n_phones >= 2")
    )


# --- related names --------------------------------------------------------------------------


def _bare(tokens: Column) -> Column:
    return F.transform(
        tokens,
        lambda t: F.when(
            t.startswith(LEAD_LETTER) & (F.length(t) >= 2), F.substring(t, 2, 1 << 30)
        ).otherwise(t),
    )


def _in_order(short: Column, long: Column) -> Column:
    """Do all short tokens occur in the long ones in this order?"""
    found = F.aggregate(
        long,
        F.lit(0),
        lambda i, t: F.when(F.try_element_at(short, i + 1) == t, i + 1).otherwise(i),
    )
    return found == F.size(short)


def _ordered_pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(
        F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    F.slice(tokens, i + 1, n - i),
                    lambda b: F.concat_ws(" ", F.element_at(tokens, i), b),
                ),
            )
        )
    )


def _inside(shorts: DataFrame, longs: DataFrame, blocks: Column) -> DataFrame:
    """Ordered subsequences: each short name meets the long ones on its rarest block."""
    offered = longs.withColumn("_block", F.explode(blocks))
    common = offered.groupBy("norm_field", "_block").agg(F.count(F.lit(1)).alias("_n"))
    wanted = shorts.withColumn("_block", F.explode(blocks))
    rarest = (
        wanted.join(common, ["norm_field", "_block"], "left")
        .groupBy("norm_field", F.col("norm_name").alias("short_name"))
        .agg(
            F.min_by("_block", F.struct(F.coalesce("_n", F.lit(0)), "_block")).alias("_block"),
            F.first("_bare").alias("_short"),
        )
    )
    return (
        rarest.join(
            offered.select(
                "norm_field",
                "_block",
                F.col("norm_name").alias("long_name"),
                F.col("_bare").alias("_long"),
            ),
            ["norm_field", "_block"],
        )
        .filter(
            (F.length("short_name") < F.length("long_name"))
            & (F.size("_short") < F.size("_long"))
            & _in_order(F.col("_short"), F.col("_long"))
        )
        .select("norm_field", "short_name", "long_name")
    )


def related_names(t: DataFrame, generic: Sequence[str] = GENERIC_NAMES) -> DataFrame:
    """``norm_field, short_name, long_name`` of related distinct names.

    Prefix: every name is looked up by each of its own leading parts, so a name adds at most as
    many rows as it has words. Ordered subsequence: short and long names meet on the ordered pair
    of words of the short name that the fewest names have (on its rarest word if the long name has
    very many words), and are then checked.
    """
    names = (
        t.filter((F.col("norm_name") != "") & ~equals_any(F.col("norm_name"), generic))
        .select("norm_field", "norm_name")
        .distinct()
        .withColumn("_tokens", words(F.col("norm_name")))
        .filter(F.size("_tokens") >= 2)
    )
    heads = names.withColumn(
        "_head",
        F.explode(
            F.transform(
                F.when(F.size("_tokens") > 2, F.sequence(F.lit(2), F.size("_tokens") - 1)).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda n: F.array_join(F.slice("_tokens", 1, n), " "),
            )
        ),
    ).select("norm_field", F.col("_head").alias("short_name"), F.col("norm_name").alias("long_name"))
    known = names.select("norm_field", F.col("norm_name").alias("short_name"))
    prefixes = heads.join(known, ["norm_field", "short_name"])

    bare = names.select(
        "norm_field", "norm_name", F.filter(_bare(F.col("_tokens")), lambda t: t != "").alias("_bare")
    ).filter(F.size("_bare") >= 3)
    few_words = F.size("_bare") <= MOST_PAIRED
    paired = bare.filter(few_words)
    by_pair = _inside(paired, paired, _ordered_pairs(F.col("_bare")))
    by_word = _inside(bare, bare.filter(~few_words), F.array_distinct("_bare"))
    inside = by_pair.unionByName(by_word)
    return prefixes.unionByName(inside).distinct()


# --- from related names to groups of rows ---------------------------------------------------


_HUB = "\u0002"


def _node(field: Column, name: Column, phone: Column) -> Column:
    return F.md5(F.concat_ws("\u0001", field, name, phone).cast("binary"))


def _links(nodes: DataFrame, related: DataFrame) -> DataFrame:
    """Edges with the components of "related names, different phones", linear in names and rows.

    Rows of two related names are linked unless they have the same phone. So a name with one phone
    is linked as a row; a name with three or more is linked whole, or whole but for the one phone
    that all its partners have; two names that share exactly two phones link crosswise.
    """
    names = nodes.groupBy("norm_field", "norm_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("norm_phone").alias("p"),
        F.max("norm_phone").alias("q"),
    )

    def side(tag: str) -> DataFrame:
        return names.select(
            "norm_field",
            F.col("norm_name").alias(f"{tag}_name"),
            *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "p", "q")],
        )

    pairs = durable(
        related.select(
            "norm_field",
            F.col("short_name").alias("a_name"),
            F.col("long_name").alias("b_name"),
        )
        .join(side("a"), ["norm_field", "a_name"])
        .join(side("b"), ["norm_field", "b_name"])
    )
    f = F.col("norm_field")

    def row(tag: str, phone: str) -> Column:
        return _node(f, F.col(f"{tag}_name"), F.col(f"{tag}_{phone}"))

    def hub(tag: str) -> Column:
        return _node(f, F.col(f"{tag}_name"), F.lit(_HUB))

    def edge(condition: str, u: Column, v: Column) -> Column:
        return F.when(F.expr(condition), F.struct(u.alias("u"), v.alias("v")))

    same_two = "a_n = 2 AND b_n = 2 AND a_p = b_p AND a_q = b_q"
    whole = f"a_n >= 2 AND b_n >= 2 AND NOT ({same_two})"
    direct = F.array(
        edge("a_n = 1 AND b_n = 1 AND a_p <> b_p", row("a", "p"), row("b", "p")),
        edge("a_n = 1 AND b_n = 2 AND a_p <> b_p", row("a", "p"), row("b", "p")),
        edge("a_n = 1 AND b_n = 2 AND a_p <> b_q", row("a", "p"), row("b", "q")),
        edge("b_n = 1 AND a_n = 2 AND b_p <> a_p", row("b", "p"), row("a", "p")),
        edge("b_n = 1 AND a_n = 2 AND b_p <> a_q", row("b", "p"), row("a", "q")),
        edge(same_two, row("a", "p"), row("b", "q")),
        edge(same_two, row("a", "q"), row("b", "p")),
        edge(whole, hub("a"), hub("b")),
        edge("a_n = 1 AND b_n >= 3", row("a", "p"), hub("b")),
        edge("b_n = 1 AND a_n >= 3", row("b", "p"), hub("a")),
    )
    edges = pairs.select(F.explode(F.array_compact(direct)).alias("e")).select("e.*")

    def use(condition: str, name: str, phone: Column) -> Column:
        return F.when(
            F.expr(condition), F.struct(F.col(name).alias("norm_name"), phone.alias("norm_phone"))
        )

    no_phone = F.lit(None).cast("string")
    uses = pairs.select(
        "norm_field",
        F.explode(
            F.array_compact(
                F.array(
                    use(whole, "a_name", no_phone),
                    use(whole, "b_name", no_phone),
                    use("a_n = 1 AND b_n >= 3", "b_name", F.col("a_p")),
                    use("b_n = 1 AND a_n >= 3", "a_name", F.col("b_p")),
                )
            )
        ).alias("x"),
    ).select("norm_field", "x.*").distinct()
    keys = ["norm_field", "norm_name"]
    owned = nodes.withColumn("_own", F.lit(True))
    hubs = (
        uses.join(owned, [*keys, "norm_phone"], "left")
        .groupBy(*keys)
        .agg(
            F.bool_or(F.col("_own").isNull()).alias("_other"),
            F.min("norm_phone").alias("_p"),
            F.max("norm_phone").alias("_q"),
        )
        .select(*keys, F.when(~F.col("_other") & (F.col("_p") == F.col("_q")), F.col("_p")).alias("_spared"))
    )
    spokes = (
        join_facts(nodes, hubs, keys)
        .filter(F.col("_spared").isNull() | (F.col("norm_phone") != F.col("_spared")))
        .select(
            _node(f, F.col("norm_name"), F.col("norm_phone")).alias("u"),
            _node(f, F.col("norm_name"), F.lit(_HUB)).alias("v"),
        )
    )
    return edges.union(spokes)


def extended_members(t: DataFrame, generic: Sequence[str] = GENERIC_NAMES) -> DataFrame:
    """``component, norm_field, norm_name, norm_phone`` of every row triple in a related group."""
    nodes = t.filter((F.col("norm_name") != "") & (F.col("norm_phone") != "")).select(
        "norm_field", "norm_name", "norm_phone"
    )
    related = related_names(t, generic)
    parts = connected_components(_links(nodes, related))
    placed = nodes.withColumn(
        "node", _node(F.col("norm_field"), F.col("norm_name"), F.col("norm_phone"))
    )
    return durable(placed.join(parts, "node").drop("node"))


def extended_groups(t: DataFrame, members: DataFrame) -> DataFrame:
    """Groups of several phones and names, without groups that repeat one of another category.

    ``component, norm_field, n_phones, n_names, n_entries, first_seq, label``.
    """
    m = members.join(t, ["norm_field", "norm_name", "norm_phone"])
    code = F.xxhash64("norm_phone", "norm_name")
    stats = (
        m.groupBy("component", "norm_field")
        .agg(
            F.count_distinct("norm_phone").alias("n_phones"),
            F.count_distinct("norm_name").alias("n_names"),
            F.sum("n").alias("n_entries"),
            F.min("first").alias("first_seq"),
            F.count(F.lit(1)).alias("_triples"),
            F.bit_xor(code).alias("_xor"),
            F.sum(code.cast("decimal(38,0)")).alias("_sum"),
        )
        .filter("n_phones >= 2 AND n_names >= 2")
    )
    ranked = (
        members.select("component", "norm_name")
        .distinct()
        .withColumn(
            "_rn", F.row_number().over(Window.partitionBy("component").orderBy("norm_name"))
        )
        .filter(F.col("_rn") <= NAMES_IN_LABEL)
    )
    in_order = F.array_sort(F.collect_list(F.struct("_rn", "norm_name")))
    labels = ranked.groupBy("component").agg(
        F.array_join(F.transform(in_order, lambda n: n["norm_name"]), SEPARATOR).alias("_label")
    )
    groups = stats.join(labels, "component")
    fields = t.filter("norm_name <> ''").groupBy("norm_field").agg(
        F.min("first").alias("field_seq")
    )
    groups = groups.join(fields, "norm_field")
    firsts = groups.groupBy("_triples", "_xor", "_sum").agg(
        F.min_by("component", F.struct("field_seq", "first_seq")).alias("component")
    )
    kept = groups.join(firsts.select("component"), "component", "left_semi")
    label = F.concat(
        F.col("_label"), F.when(F.col("n_names") > NAMES_IN_LABEL, SEPARATOR + "…").otherwise("")
    )
    return kept.select(
        "component", "norm_field", "n_phones", "n_names", "n_entries", "first_seq", "field_seq",
        label.alias("label"),
    )


def all_groups(t: DataFrame, generic: Sequence[str] = GENERIC_NAMES) -> tuple[DataFrame, DataFrame]:
    """Exact and extended groups together.

    Returns ``(groups, members)``: groups with their rank in discovery order (later groups win a
    phone), members as ``group_id`` with the row triple.
    """
    exact = exact_groups(t, generic)
    exact_id = F.concat(F.lit("x"), _node(F.col("norm_field"), F.col("norm_name"), F.lit("")))
    members = extended_members(t, generic)
    extended = durable(extended_groups(t, members))
    groups = exact.select(
        exact_id.alias("group_id"),
        F.struct(F.lit(0).alias("kind"), F.col("first_seq").alias("a"), F.lit(0).cast("long").alias("b")).alias("rank"),
    ).unionByName(
        extended.select(
            F.concat(F.lit("y"), "component").alias("group_id"),
            F.struct(F.lit(1).alias("kind"), F.col("field_seq").alias("a"), F.col("first_seq").alias("b")).alias("rank"),
        )
    )
    of_exact = t.filter("norm_name <> ''").join(
        exact.select("norm_field", "norm_name", exact_id.alias("group_id")),
        ["norm_field", "norm_name"],
    )
    of_extended = members.join(extended.select("component"), "component", "left_semi").select(
        "norm_field", "norm_name", "norm_phone", F.concat(F.lit("y"), "component").alias("group_id")
    )
    columns = ["group_id", "norm_field", "norm_name", "norm_phone"]
    return groups, of_exact.select(columns).unionByName(of_extended.select(columns))


def merge_members(k: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One merged record per group, its phones, and its notes.

    Returns ``merged`` (scalars), ``phones`` (``group_id, phone`` with the sort key) and ``notes``
    (``group_id, note``). Members are the rows of the group's triples.
    """
    rows = members.join(k, ["norm_field", "norm_name", "norm_phone"])
    name, extra, field = blank(F.col("name")), strip(blank(F.col("extra_info"))), blank(F.col("field"))
    back = -F.col("_seq")
    has_field, has_extra = strip(field) != "", extra != ""
    phones = rows.filter("norm_phone <> ''").groupBy("group_id", "norm_phone").agg(
        F.first(sort_key(F.col("norm_phone"))).alias("sort_key")
    )
    primary = phones.groupBy("group_id").agg(
        F.min_by("norm_phone", "sort_key").alias("phone"), F.count(F.lit(1)).alias("n_phones")
    )
    merged = rows.groupBy("group_id").agg(
        F.max_by(name, F.struct(F.length(name), back)).alias("name"),
        F.min_by(F.when(has_field, field), F.when(has_field, F.col("_seq"))).alias("field"),
        F.bool_or(F.coalesce(F.col("from_local"), F.lit(False))).alias("from_local"),
        F.max_by(
            F.when(has_extra, extra), F.when(has_extra, F.struct(F.length(extra), back))
        ).alias("extra_info"),
    )
    merged = merged.join(primary, "group_id").select(
        "group_id", "name", "phone", "n_phones", blank(F.col("field")).alias("field"),
        "from_local", blank(F.col("extra_info")).alias("extra_info"),
    )
    said = (
        rows.withColumn("_note", strip(blank(F.col("note"))))
        .filter("_note <> ''")
        .groupBy("group_id", "_note")
        .agg(F.min("_seq").alias("_seq"))
    )
    ordered = said.select(
        "group_id", "_seq", F.lit(0).alias("_tie"), F.col("_note").alias("note")
    )
    return merged, phones, note_texts(ordered, "group_id", ["_seq", "_tie"], "note")


def apply_merge(entries: DataFrame, seq: str = "seq", generic: Sequence[str] = GENERIC_NAMES):
    """Merge duplicates of a catalogue: ``(catalogue, phones, notes)``.

    Every phone of a merged group is taken over by the last group that has it; the merged record
    stands at the first row of the catalogue it replaces, other rows stay as they are. ``group_id``
    is null for rows that were not merged.
    """
    k = keyed(entries, seq)
    groups, members = all_groups(triples(k), generic)
    holders = members.filter("norm_phone <> ''").join(groups, "group_id")
    owner = holders.groupBy("norm_phone").agg(F.max_by("group_id", "rank").alias("group_id"))
    # Rows without a phone have no owner; they stay out of the join, where they would all meet.
    called, silent = k.filter("norm_phone <> ''"), k.filter("norm_phone = ''")
    placed = join_facts(called, owner, "norm_phone", "left").unionByName(
        silent.withColumn("group_id", F.lit(None).cast("string"))
    )
    positions = placed.filter("group_id IS NOT NULL").groupBy("group_id").agg(
        F.min("_seq").alias("_seq")
    )
    live = durable(members.join(positions, "group_id", "left_semi"))
    merged, phones, notes = merge_members(k, live)
    out = merged.join(positions, "group_id").join(notes, "group_id", "left")
    columns = ["group_id", "name", "phone", "field", "from_local", "note", "extra_info", "_seq"]
    untouched = placed.filter("group_id IS NULL").select(columns)
    catalogue = untouched.unionByName(
        out.withColumn("note", blank(F.col("note"))).select(columns)
    ).withColumnRenamed("_seq", seq)
    return catalogue, phones, notes


def nest_phones(catalogue: DataFrame, phones: DataFrame) -> DataFrame:
    """Catalogue with ``phones`` as an array where a record has more than one."""
    sizes = phones.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    listed = phones.join(sizes.filter(F.col("_n") > 1), "group_id", "left_semi")
    in_order = F.array_sort(F.collect_list(F.struct("sort_key", "norm_phone")))
    lists = listed.groupBy("group_id").agg(
        F.transform(in_order, lambda p: p["norm_phone"]).alias("phones")
    )
    return catalogue.join(lists, "group_id", "left")


def report_keys(label: str) -> list[Column]:
    return [F.desc("n_phones"), F.col("norm_field"), F.col(label)]


def report_order(groups: DataFrame, label: str) -> DataFrame:
    return groups.orderBy(*report_keys(label))
