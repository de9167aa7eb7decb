"""Venues: names out of messages, place and type, merge keys, merge of rows, websites."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.functions.ids import content_id
from tipweave.functions.phrases import contains_any, equals_any
from tipweave.functions.text import (
    DASHES,
    blank,
    cap,
    fold_spaces,
    let,
    non_blank,
    strip,
    strip_trailing_note,
)
from tipweave.operators.dictionary import longest_alias
from tipweave.operators.messages import MessageRules, qualifies, reject_reason
from tipweave.operators.names import NameRules, clean_name, is_junk_capture, is_plausible
from tipweave.runtime import join_facts
from tipweave.sources.chat import worth_scanning

# Length caps of catalogue columns.
TYPE_CAP, LOCATION_CAP, NOTE_CAP, EXTRA_CAP = 200, 250, 400, 600
SNIPPET = 550
ATTRIBUTES = ("restaurant_type", "location", "note", "extra_info")


@dataclass(frozen=True)
class NamePattern:
    """``regex`` with the name in group ``group``; patterns are tried in list order.

    ``lead`` patterns take the name before a dash and hide the text they matched from the others;
    ``always`` patterns look at hidden text too. ``first_not`` lists first words that are no name,
    ``not_starting`` beginnings of the captured text that are none, and ``needs`` phrases of which
    the captured text must have one.
    """

    regex: str
    group: int = 1
    lead: bool = False
    always: bool = False
    first_not: Sequence[str] = ()
    not_starting: Sequence[str] = ()
    needs: Sequence[str] = ()


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,stop:int,name:string>>")


def _spans(text: Column, p: NamePattern) -> Column:
    """Matches as (start, stop, name), found left to right."""
    whole = F.regexp_extract_all(text, F.lit(f"({p.regex})"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group))
    pairs = F.arrays_zip(whole.alias("whole"), names.alias("name"))
    start = F.struct(
        F.lit(1).alias("at"),
        _no_spans().alias("out"),
    )

    def step(acc: Column, m: Column) -> Column:
        at = F.position(m["whole"], text, acc["at"])
        stop = at + F.length(m["whole"])
        found = F.struct(at.alias("start"), stop.alias("stop"), strip(m["name"]).alias("name"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _good(p: NamePattern) -> Callable[[Column], Column]:
    def check(m: Column) -> Column:
        name = m["name"]
        ok = name != ""
        if p.first_not:
            ok = ok & ~equals_any(F.substring_index(fold_spaces(name), " ", 1), p.first_not)
        for junk in p.not_starting:
            ok = ok & ~fold_spaces(name).startswith(junk)
        if p.needs:
            ok = ok & contains_any(name, p.needs)
        return ok

    return check


def extract_names(body: Column, patterns: Sequence[NamePattern], r: NameRules) -> Column:
    """Names in a message in pattern order, first spelling of each kept."""
    with_leads = any(p.lead for p in patterns)

    def spans(p: NamePattern) -> Column:
        if with_leads:
            return F.when(body.rlike(p.regex), _spans(body, p)).otherwise(_no_spans())
        names = F.regexp_extract_all(body, F.lit(p.regex), F.lit(p.group))
        return F.transform(names, lambda n: F.struct(strip(n).alias("name")))

    def names(leads: Column | None) -> Column:
        found = []
        for p in patterns:
            if p.lead:
                found.append(F.transform(leads, lambda m: fold_spaces(m["name"])))
                continue
            own = F.filter(spans(p), _good(p))
            if leads is not None and not p.always:
                own = F.filter(
                    own,
                    lambda m: ~F.exists(
                        leads, lambda h: (m["start"] >= h["start"]) & (m["start"] < h["stop"])
                    ),
                )
            found.append(F.transform(own, lambda m: m["name"]))
        everything = F.concat(*found) if len(found) > 1 else found[0]
        return first_spellings(F.filter(everything, lambda n: ~is_junk_capture(n, r)))

    if not with_leads:
        return names(None)
    (lead,) = [p for p in patterns if p.lead]
    accepted = F.filter(
        F.filter(spans(lead), _good(lead)), lambda m: ~is_junk_capture(m["name"], r)
    )
    return let(accepted, names)


def first_spellings(names: Column) -> Column:
    """Distinct names in order; names that differ in case only count as one."""
    keyed = F.transform(
        names, lambda n, i: F.struct(strip(F.lower(n)).alias("key"), i.alias("i"), n.alias("name"))
    )

    def firsts(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r["key"])
        return let(
            keys,
            lambda ks: F.transform(
                F.filter(rows, lambda r: F.array_position(ks, r["key"]) == r["i"] + 1),
                lambda r: r["name"],
            ),
        )

    return let(keyed, firsts)


@dataclass(frozen=True)
class PlaceRules:
    """``aliases`` are (canonical, alias) pairs in table order."""

    aliases: Sequence[tuple[str, str]] = ()
    bounded: Sequence[tuple[str, str]] = ()
    near_name: Sequence[tuple[str, str, int]] = ()
    prefix: str = ""
    settlement: tuple[str, str] | None = None


def guess_place(body: Column, r: PlaceRules) -> Column:
    """Longest place named in the text; ``bounded`` places must stand as a word of their own."""

    def best(found: Column) -> Column:
        named = [
            F.when(body.rlike(pattern) & (F.length(found) < len(place)), F.lit(place))
            for place, pattern in sorted(r.bounded, key=lambda b: -len(b[0]))
        ]
        return F.coalesce(*named, found)

    return F.substring(let(longest_alias(body, r.aliases), best), 1, 200)


def place_near_name(body: Column, name: Column, r: PlaceRules) -> Column:
    """Place within a few letters of the name, for names with several branches in one message."""
    tries = [
        F.when(
            name.rlike(name_rx)
            & body.rlike(
                rf"(?s)(?:{name_rx}).{{0,{window}}}\Q{place}\E|\Q{place}\E.{{0,{window}}}(?:{name_rx})"
            ),
            F.lit(place),
        )
        for name_rx, place, window in r.near_name
    ]
    return F.coalesce(*tries, F.lit(""))


def split_place(name: Column, r: PlaceRules) -> Column:
    """``(name, location)`` of "<name> in <place>"; without a known place location is empty."""
    s = fold_spaces(name)
    ordered = sorted(r.aliases, key=lambda a: -len(a[1]))
    out = F.lit(None)
    if ordered and r.prefix:
        table = F.arrays_zip(
            F.lit([f" {r.prefix}{alias}" for _, alias in ordered]).alias("suffix"),
            F.lit([canonical for canonical, _ in ordered]).alias("place"),
        )
        fits = F.filter(
            table,
            lambda t: s.endswith(t["suffix"])
            & (F.length(fold_spaces(_head(s, F.length(t["suffix"])))) >= 2),
        )
        out = let(
            F.try_element_at(fits, F.lit(1)),
            lambda hit: F.when(
                hit.isNotNull(),
                F.struct(
                    fold_spaces(_head(s, F.length(hit["suffix"]))).alias("name"),
                    hit["place"].alias("location"),
                ),
            ),
        )
    plain = F.struct(s.alias("name"), F.lit("").alias("location"))
    if not r.settlement:
        return F.coalesce(out, plain)
    pattern, label = r.settlement
    brand = fold_spaces(F.regexp_extract(s, pattern, 1))
    tail = strip(
        F.regexp_replace(fold_spaces(F.regexp_extract(s, pattern, 2)), r"\s*[-–—].*$", "")
    )
    settled = F.when(
        (F.length(brand) >= 2) & (F.length(tail) >= 2),
        F.struct(brand.alias("name"), F.concat(F.lit(label + " "), tail).alias("location")),
    )
    return F.coalesce(out, settled, plain)


def _head(s: Column, drop: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - drop)


def expand_place(location: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """Short forms to full place names, longest first, then equal parts merged."""
    s = fold_spaces(location)
    for canonical, alias in sorted(
        (a for a in aliases if a[0] != a[1]), key=lambda a: -len(a[1])
    ):
        s = F.replace(s, F.lit(alias), F.lit(canonical))
    parts = F.transform(F.split(fold_spaces(s), r"\s*\|\s*"), fold_spaces)
    return cap(F.array_join(first_spellings(F.filter(parts, lambda p: p != "")), " | "), LOCATION_CAP)


def guess_type(body: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First (pattern, type) that fits the text."""
    return F.coalesce(*[F.when(body.rlike(p), F.lit(t)) for p, t in rules], F.lit(""))


def clean_type(kind: Column, qualifier_patterns: Sequence[str]) -> Column:
    """Remove qualifiers from each part of the type and join what is left."""

    def bare(p: Column) -> Column:
        for q in qualifier_patterns:
            p = F.regexp_replace(p, q, " ")
        return F.btrim(fold_spaces(p), F.lit(" /|,-"))

    parts = F.filter(F.split(fold_spaces(kind), r"\s*[/|]\s*"), lambda p: strip(p) != "")
    left = F.filter(F.transform(parts, bare), lambda p: p != "")
    return cap(F.array_join(left, " / "), TYPE_CAP)


@dataclass(frozen=True)
class VenueRules:
    messages: MessageRules
    names: NameRules
    patterns: Sequence[NamePattern]
    places: PlaceRules = PlaceRules()
    types: Sequence[tuple[str, str]] = ()
    qualifiers: Sequence[str] = ()
    brands: Sequence[tuple[str, str]] = ()
    spellings: Sequence[tuple[str, str]] = ()
    scrub: tuple | None = None
    source_label: str = ""


def strict_rows(messages: DataFrame, r: VenueRules, salt: str = "scan:") -> DataFrame:
    """Venue rows of messages that pass every filter and name a venue by pattern.

    A chain of map-only steps: the cheap tests come first, the extraction runs on what is left.
    """
    body = F.col("body")
    kept = worth_scanning(messages).filter(
        reject_reason(body, r.messages).isNull() & qualifies(body, r.messages)
    )
    named = kept.select(
        "*",
        guess_place(body, r.places).alias("_place"),
        guess_type(body, r.types).alias("_type"),
        F.posexplode(extract_names(body, r.patterns, r.names)).alias("name_no", "raw_name"),
    )
    cleaned = named.withColumn(
        "_clean", clean_name(F.col("raw_name"), r.names, r.scrub)
    ).filter("_clean IS NOT NULL")
    split = cleaned.withColumn("_split", split_place(F.col("_clean"), r.places))
    name = F.col("_split.name")
    location = F.coalesce(
        non_blank(F.col("_split.location")),
        non_blank(place_near_name(body, name, r.places)),
        F.col("_place"),
    )
    source = F.concat_ws(" · ", F.lit(r.source_label), "sender", "date_str")
    return split.select(
        "chat_id",
        "msg_seq",
        "name_no",
        content_id(
            F.concat(F.lit(salt), name, F.col("date_str"), F.substring("sender", 1, 20))
        ).alias("id"),
        name.alias("name"),
        cap(F.col("_type"), 150).alias("restaurant_type"),
        location.alias("location"),
        cap(source, NOTE_CAP).alias("note"),
        cap(F.substring(body, 1, SNIPPET), EXTRA_CAP).alias("extra_info"),
    )


# --- merge ------------------------------------------------------------------------------------


def merge_name(name: Column, spellings: Sequence[tuple[str, str]] = ()) -> Column:
    """Name for merging: trailing parenthesis, dashes and apostrophes evened out, lower case."""
    n = F.translate(strip_trailing_note(name), "׳ʼ", "''")
    n = fold_spaces(F.regexp_replace(n, DASHES, " "))
    for written, unified in spellings:
        n = F.replace(n, F.lit(written), F.lit(unified))
    return F.lower(n)


def merge_key(
    name: Column,
    brands: Sequence[tuple[str, str]] = (),
    spellings: Sequence[tuple[str, str]] = (),
) -> Column:
    """Key of the first brand pattern that fits, else the merge name, else the lowered name."""
    n = strip(blank(name))
    by_brand = [F.when(n.rlike(p), F.lit(key)) for p, key in brands]
    return F.coalesce(*by_brand, non_blank(merge_name(n, spellings)), F.lower(n))


def display_rank(name: Column) -> Column:
    """Smaller is better: no trailing parenthesis, no dash, short, then alphabetical."""
    n = blank(name)
    penalty = F.when(strip(n).rlike(r"\([^)]+\)\s*$"), 10).otherwise(0) + F.when(
        F.contains(n, F.lit(" — ")), 5
    ).otherwise(0)
    return F.struct(penalty.alias("penalty"), F.length(n).alias("length"), n.alias("name"))


def merge_rows(
    rows: DataFrame,
    seq: str = "seq",
    brands: Sequence[tuple[str, str]] = (),
    spellings: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """One row per venue: same merge key and compatible locations.

    Locations are compatible if equal or if one is blank, so a key falls apart only if it has
    several names and no blank location, and then by location. That needs two facts per key, found
    by an aggregate that combines before the shuffle. A value list of a merged row is cut at a
    fixed length, so only its leading distinct values are ever brought together.
    """
    location = F.lower(fold_spaces(F.col("location")))
    k = rows.withColumn("_key", merge_key(F.col("name"), brands, spellings)).withColumns(
        {"_name": non_blank(merge_name(F.col("name"), spellings)), "_location": location}
    )
    facts = k.groupBy("_key").agg(
        (F.coalesce(F.min("_name") == F.max("_name"), F.lit(False))).alias("_one_name"),
        F.max(F.col("_location") == "").alias("_any_blank"),
    )
    placed = join_facts(k, facts, "_key").withColumn(
        "_part", F.when(F.col("_one_name") | F.col("_any_blank"), "").otherwise(F.col("_location"))
    )
    group = ["_key", "_part"]
    columns = [c for c in rows.columns if c != seq]
    stats = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(seq).alias(seq),
        F.min_by("name", display_rank(F.col("name"))).alias("_display"),
        F.min_by(F.struct(*columns), seq).alias("_row"),
    )
    values = (
        placed.select(
            *group,
            seq,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(a).alias("attribute"), strip(blank(F.col(a))).alias("value"))
                        for a in ATTRIBUTES
                    ]
                )
            ).alias("_v"),
        )
        .select(*group, seq, "_v.*")
        .filter("value <> ''")
        .groupBy(*group, "attribute", "value")
        .agg(F.min(seq).alias(seq))
    )
    leading = values.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group, "attribute").orderBy(seq, "value"))
    ).filter(F.col("_rn") <= EXTRA_CAP + 1)

    def joined(attribute: str) -> Column:
        own = F.collect_list(
            F.when(F.col("attribute") == attribute, F.struct("_rn", "value"))
        )
        return F.array_join(F.transform(F.array_sort(own), lambda v: v["value"]), " | ")

    lists = leading.groupBy(*group).agg(*[joined(a).alias(f"_{a}") for a in ATTRIBUTES])
    merged = stats.join(lists, group, "left")
    text = {a: blank(F.col(f"_{a}")) for a in ATTRIBUTES}
    new_id = content_id(
        F.concat(
            F.lit("merged:"), "_key", "_display", F.substring(text["location"], 1, 40)
        )
    )
    many = {
        "id": new_id,
        "name": F.col("_display"),
        "restaurant_type": cap(text["restaurant_type"], TYPE_CAP),
        "location": cap(text["location"], LOCATION_CAP),
        "note": cap(text["note"], NOTE_CAP, "..."),
        "extra_info": cap(text["extra_info"], EXTRA_CAP, "..."),
    }
    return merged.select(
        seq,
        *[
            F.when(F.col("_n") == 1, F.col(f"_row.{c}")).otherwise(many[c]).alias(c)
            if c in many
            else F.when(F.col("_n") == 1, F.col(f"_row.{c}")).alias(c)
            for c in columns
        ],
        F.col("_n").alias("n_merged"),
    )


def with_websites(venues: DataFrame, websites: DataFrame) -> DataFrame:
    """Website by final display name; a known name sets it, also to blank, others keep theirs.

    The dimension is keyed by name; the planner broadcasts it if its size allows.
    """
    sites = websites.groupBy("name").agg(F.max("website").alias("_site"))
    kept = blank(F.col("website")) if "website" in venues.columns else F.lit("")
    return (
        venues.join(sites.withColumn("_known", F.lit(True)), "name", "left")
        .withColumn("website", F.when(F.col("_known"), blank(F.col("_site"))).otherwise(kept))
        .drop("_site", "_known")
    )


def website_audit(venues: DataFrame, websites: DataFrame) -> DataFrame:
    """Names without a website row, and website rows without a venue."""
    names = venues.select("name").distinct()
    known = websites.select("name").distinct()
    missing = names.join(known, "name", "left_anti").withColumn("finding", F.lit("unknown"))
    stale = known.join(names, "name", "left_anti").withColumn("finding", F.lit("stale"))
    return missing.unionByName(stale)


def assemble(
    rows: DataFrame, r: VenueRules, websites: DataFrame | None = None, seq: str = "seq"
) -> DataFrame:
    """Plausible rows, places expanded, merged, types cleaned, websites set."""
    ok = rows.filter(is_plausible(F.col("name"), r.names)).withColumn(
        "location", expand_place(F.col("location"), r.places.aliases)
    )
    merged = merge_rows(ok, seq, r.brands, r.spellings).withColumn(
        "restaurant_type", clean_type(F.col("restaurant_type"), r.qualifiers)
    )
    return with_websites(merged, websites) if websites is not None else merged


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Venue sources one after the other, in the order given."""
    ranked = [
        df.withColumn("src_rank", F.lit(i)) for i, df in enumerate(sources)
    ]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
