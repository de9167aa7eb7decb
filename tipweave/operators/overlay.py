"""User changes on top of a base catalogue.

Changes are a log, one row per changed column: ``key, seq, op, column, value, phones`` with ``op``
one of ``edit``, ``flag``, ``note``, ``delete``. New rows are a table of their own. The log is
reduced to the latest value per key and column before it meets the catalogue; all reductions are
aggregates that combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain, cycle, repeat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipweave.functions.phone import digits, last10
from tipweave.functions.text import blank, non_blank, strip
from tipweave.operators.components import connected_components
from tipweave.runtime import durable, durable_counted, join_facts

#: Rows of a component that one aggregate settles.
SETTLED = 2048
EDITABLE = ("name", "phone", "phone_display", "field", "extra_info", "recommender", "note")
VENUE_COLUMNS = (
    "name", "restaurant_type", "location", "note", "extra_info", "website", "recommender",
)

CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("phones", T.ArrayType(T.StringType())),
    ]
)


def entry_key(phone: Column) -> Column:
    return last10(phone)


def phone_keys(phone: Column, phone_display: Column, phones: Column) -> Column:
    """All phone keys of an entry."""
    extra = F.coalesce(phones, F.array().cast("array<string>"))
    keys = F.transform(F.concat(F.array(phone, phone_display), extra), last10)
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def with_display_phone(changes: DataFrame) -> DataFrame:
    """Setting the phone also sets the shown phone, unless the same change sets that itself."""
    phone = changes.filter("op = 'edit' AND column = 'phone'")
    own = changes.filter("op = 'edit' AND column = 'phone_display'").select("key", "seq")
    follow = phone.join(own, ["key", "seq"], "left_anti").withColumn(
        "column", F.lit("phone_display")
    )
    return changes.unionByName(follow)


def _edit_aggregates(columns: Sequence[str]) -> list[Column]:
    aggs = []
    for c in (*columns, "phones"):
        mine = (F.col("op") == "edit") & (F.col("column") == c)
        value = F.col("phones") if c == "phones" else strip(blank(F.col("value")))
        newest = F.max_by(F.when(mine, F.struct(value.alias("v"))), F.when(mine, F.col("seq")))
        aggs += [newest.isNotNull().alias(f"has_{c}"), newest["v"].alias(f"new_{c}")]
    return aggs


def latest_edits(changes: DataFrame, columns: Sequence[str] = EDITABLE) -> DataFrame:
    """One row per key: ``has_<column>`` and the latest ``<column>`` of every edited column."""
    return changes.filter("op = 'edit'").groupBy("key").agg(*_edit_aggregates(columns))


def latest_changes(changes: DataFrame, columns: Sequence[str] = EDITABLE) -> DataFrame:
    """All that the log says about a key, in one pass: edits, flag, note, deletion."""

    def newest(op: str) -> Column:
        mine = F.col("op") == op
        return F.max_by(F.when(mine, F.struct("value")), F.when(mine, F.col("seq")))["value"]

    return changes.groupBy("key").agg(
        *_edit_aggregates(columns),
        newest("flag").alias("_flag"),
        newest("note").alias("_note"),
        F.bool_or(F.col("op") == "delete").alias("_deleted"),
    )


def merge_overlay(
    base: DataFrame,
    added: DataFrame,
    changes: DataFrame,
    collapse_blank_keys: bool = False,
) -> DataFrame:
    """The catalogue as users see it.

    Deleted keys remove every copy; of several rows with a key the first stays, base rows before
    added ones; an edit to empty wins over the base value; a note of the overlay wins over an
    edited note, and that over the row's own. ``item_key`` is the key after a phone edit, as votes
    follow it. Rows without a key stay apart unless ``collapse_blank_keys``.

    ``base`` and ``added`` need ``seq`` and the entry columns; ``phones`` may be null.
    """
    rows = base.withColumns({"src_rank": F.lit(0), "is_added": F.lit(False)}).unionByName(
        added.withColumns({"src_rank": F.lit(1), "is_added": F.lit(True)}),
        allowMissingColumns=True,
    )
    if "phone_display" not in rows.columns:
        rows = rows.withColumn("phone_display", F.lit(None).cast("string"))
    if "recommender" not in rows.columns:
        rows = rows.withColumn("recommender", F.lit(None).cast("string"))
    rows = rows.withColumns(
        {
            "key": entry_key(F.col("phone")),
            "phone_display": F.when(
                F.col("is_added"), F.coalesce("phone_display", "phone")
            ).otherwise(F.col("phone_display")),
        }
    )
    columns = [c for c in rows.columns if c not in ("key", "src_rank", "seq")]
    order = F.struct("src_rank", "seq")
    keyed = rows if collapse_blank_keys else rows.filter("key <> ''")
    first = (
        keyed.groupBy("key")
        .agg(F.min(order).alias("_order"), F.min_by(F.struct(*columns), order).alias("_row"))
        .select("key", "_order.*", "_row.*")
    )
    # Both sides are grouped by key already, so this join moves nothing.
    joined = first.join(latest_changes(changes), "key", "left").filter(
        ~F.coalesce("_deleted", F.lit(False))
    )
    if not collapse_blank_keys:
        joined = joined.unionByName(rows.filter("key = ''"), allowMissingColumns=True)

    def edited(c: str) -> Column:
        return F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c))

    phones = F.when(
        F.col("has_phones"), F.when(F.size("new_phones") > 1, F.col("new_phones"))
    ).otherwise(F.col("phones"))
    note = F.coalesce(
        non_blank(F.col("_note")), non_blank(F.col("new_note")), edited("note"), F.lit("")
    )
    phone = edited("phone")
    return joined.select(
        F.coalesce(non_blank(last10(phone)), F.col("key")).alias("item_key"),
        edited("name").alias("name"),
        phone.alias("phone"),
        edited("phone_display").alias("phone_display"),
        phones.alias("phones"),
        edited("field").alias("field"),
        F.coalesce(F.col("_flag").try_cast("boolean"), F.col("from_local"), F.lit(False)).alias(
            "from_local"
        ),
        note.alias("note"),
        edited("extra_info").alias("extra_info"),
        edited("recommender").alias("recommender"),
        "is_added",
        "src_rank",
        "seq",
    )


def stored_rows(merged: DataFrame) -> DataFrame:
    """Columns kept on disk: the shown phone, trimmed texts, phones only if several."""
    return merged.select(
        "seq",
        "src_rank",
        blank(F.col("name")).alias("name"),
        F.coalesce("phone_display", "phone", F.lit("")).alias("phone"),
        F.when(F.size("phones") > 1, F.col("phones")).alias("phones"),
        blank(F.col("field")).alias("field"),
        F.coalesce("from_local", F.lit(False)).alias("from_local"),
        strip(blank(F.col("note"))).alias("note"),
        strip(blank(F.col("extra_info"))).alias("extra_info"),
        strip(blank(F.col("recommender"))).alias("recommender"),
    )


def prepare_additions(requests: DataFrame) -> DataFrame:
    """Valid new rows: a name and a phone are needed; digits stand in for a missing phone."""
    name, phone = strip(blank(F.col("name"))), strip(blank(F.col("phone")))
    shown = F.coalesce(non_blank(strip(blank(F.col("phone_display")))), phone)
    phones = F.when(
        F.size("phones") > 1,
        F.filter(F.transform("phones", strip), lambda p: p != ""),
    )
    return requests.filter((name != "") & ((phone != "") | (shown != ""))).withColumns(
        {
            "name": name,
            "phone": F.coalesce(non_blank(phone), digits(shown)),
            "phone_display": shown,
            "phones": phones,
            "note": F.lit(""),
        }
    )


def accept_additions(
    requests: DataFrame, catalogue: DataFrame, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` new rows.

    A row is refused if it shares a phone key with the catalogue, or with an earlier row of the
    batch that is itself accepted; keys meet in equi-joins. Within a batch an earlier row that was
    refused must not block a later one, so order matters along chains of rows that share keys.

    Rows that are first for all of their keys are accepted at once, and what shares a key with them
    is refused: that settles hot keys. What is left falls into components; of each, the first
    ``SETTLED`` rows are settled in order by one aggregate, as no later row has a say in them. So a
    chain takes one pass for every ``SETTLED`` rows, and most batches one in all.
    """
    keys = phone_keys(F.col("phone"), F.col("phone_display"), F.col("phones"))
    wanted = requests.select(seq, F.explode(keys).alias("phone_key"))
    taken = catalogue.select(F.explode(keys).alias("phone_key")).distinct()
    clash = wanted.join(taken, "phone_key", "left_semi").select(seq).distinct()
    open_rows, left = durable_counted(wanted.join(clash, seq, "left_anti").distinct())
    accepted = None
    # Most batches are done by the cheap way alone.
    for settle in chain(repeat(_first_of_all, 2), cycle((_in_order, _first_of_all))):
        if not left:
            break
        won, done = settle(open_rows, seq)
        accepted = won if accepted is None else accepted.unionByName(won)
        won_keys = durable(open_rows.join(won, seq).select("phone_key").distinct())
        losers = open_rows.join(won_keys, "phone_key", "left_semi").select(seq)
        gone = durable(losers.unionByName(done).distinct())
        open_rows, left = durable_counted(open_rows.join(gone, seq, "left_anti"))
    if accepted is None:
        return requests.filter("false"), requests
    return (
        requests.join(accepted, seq, "left_semi"),
        requests.join(accepted, seq, "left_anti"),
    )


def _first_of_all(open_rows: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """Rows that no earlier row shares a key with, twice: as accepted and as settled."""
    first = open_rows.groupBy("phone_key").agg(F.min(seq).alias("_first"))
    ranked = join_facts(open_rows, first, "phone_key")
    wins = ranked.groupBy(seq).agg(F.bool_and(F.col("_first") == F.col(seq)).alias("_wins"))
    won = durable(wins.filter("_wins").select(seq))
    return won, won


def _in_order(open_rows: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """The first rows of each component, settled one after another: accepted ones, and all."""
    row, key = F.concat(F.lit("r"), F.col(seq)), F.concat(F.lit("k"), F.col("phone_key"))
    parts = connected_components(open_rows.select(row.alias("u"), key.alias("v")))
    listed = open_rows.groupBy(seq).agg(F.collect_set("phone_key").alias("_keys"))
    placed = listed.withColumn("node", row).join(durable(parts), "node")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(seq))
    early = durable(placed.withColumn("_rank", rank).filter(F.col("_rank") <= SETTLED))
    kind = open_rows.schema[seq].dataType.simpleString()
    none = F.struct(
        F.array().cast("array<string>").alias("taken"), F.array().cast(f"array<{kind}>").alias("won")
    )

    def step(state: Column, now: Column) -> Column:
        return F.when(F.arrays_overlap(state["taken"], now["_keys"]), state).otherwise(
            F.struct(
                F.concat(state["taken"], now["_keys"]).alias("taken"),
                F.concat(state["won"], F.array(now[seq])).alias("won"),
            )
        )

    in_order = F.array_sort(F.collect_list(F.struct(seq, "_keys")))
    won = early.groupBy("component").agg(F.aggregate(in_order, none, step)["won"].alias("won"))
    return durable(won.select(F.explode("won").alias(seq))), early.select(seq)


def merge_venue_changes(venues: DataFrame, added: DataFrame, changes: DataFrame) -> DataFrame:
    """Add, update and delete venues by id; an update that would blank the name is not applied."""
    deleted = changes.filter("op = 'delete'").select(F.col("key").alias("id")).distinct()
    named = changes.filter(~((F.col("column") == "name") & (strip(blank(F.col("value"))) == "")))
    edits = latest_edits(named, VENUE_COLUMNS).withColumnRenamed("key", "id")
    new = added.filter(strip(blank(F.col("name"))) != "")
    rows = venues.unionByName(new, allowMissingColumns=True).join(deleted, "id", "left_anti")
    joined = rows.join(edits, "id", "left")
    others = [c for c in rows.columns if c not in VENUE_COLUMNS]
    return joined.select(
        *others,
        *[
            F.when(F.col(f"has_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
            for c in VENUE_COLUMNS
            if c in rows.columns
        ],
    )


def public_entries(merged: DataFrame) -> DataFrame:
    return merged.drop("note")


def public_venues(venues: DataFrame) -> DataFrame:
    return venues.drop(*[c for c in venues.columns if c.startswith("_")])
