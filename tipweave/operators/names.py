"""Is a text a plausible venue name? Cleaning, rejection rules, evidence in the message."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipweave.functions.phrases import (
    any_true,
    contains_all,
    contains_any,
    equals_any,
    starts_with_any,
)
from tipweave.functions.text import (
    SPACE,
    blank,
    drop_edit_markers,
    emoji_count,
    fold_spaces,
    let,
    strip,
    strip_chars,
    words,
)

# Characters and sizes of names.
OUTER_NOISE = " \"'״׳-–—"
QUOTES = " \"'״׳-–"
SHORTEST, LONGEST, LONGEST_CURATED = 2, 50, 76
MOST_WORDS, MOST_WORDS_CURATED = 7, 12
MOST_EMOJI = 4
RAW_LENGTHS = (2, 55)
CLEAN_LENGTH = 120
EAST_ASIAN = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"


@dataclass(frozen=True)
class NameRules:
    chat_patterns: Sequence[str] = ()
    chat_phrases: Sequence[str] = ()
    lead_patterns: Sequence[str] = ()
    sentence_patterns: Sequence[str] = ()
    spam_patterns: Sequence[str] = ()
    reject_phrases: Sequence[str] = ()
    generic_exact: Sequence[str] = ()
    solo_words: Sequence[str] = ()
    category_patterns: Sequence[str] = ()
    descriptor_leads: Sequence[str] = ()
    place_prefix: str = ""
    category_words: Sequence[str] = ()
    category_followers: Sequence[str] = ()
    venue_nouns: Sequence[str] = ()
    tail_patterns: Sequence[str] = ()
    direction_patterns: Sequence[str] = ()
    bad_names: Sequence[str] = ()
    months: Sequence[str] = ()
    clean_patterns: Sequence[tuple[str, str]] = ()
    junk_exact: Sequence[str] = ()
    junk_prefixes: Sequence[str] = ()
    junk_phrases: Sequence[str] = ()
    junk_patterns: Sequence[str] = ()
    junk_pairs: Sequence[tuple[str, str]] = ()
    generic_labels: Sequence[str] = ()
    label_patterns: Sequence[str] = ()
    generic_cuisine: Sequence[str] = ()


def strip_outer(c: Column) -> Column:
    s = strip_chars(strip(blank(c)), OUTER_NOISE)
    s = strip(F.regexp_replace(s, rf"(?U)^[*\s]*\*{SPACE}*|{SPACE}*\*[*\s]*$", ""))
    return strip(F.regexp_replace(s, rf"(?U){SPACE}+", " "))


def core_name(c: Column) -> Column:
    bare = F.regexp_replace(strip_outer(c), rf"(?U){SPACE}*\([^)]{{0,80}}\){SPACE}*$", "")
    return F.lower(strip(bare))


def _any_pattern(s: Column, patterns: Sequence[str]) -> Column:
    return s.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def is_chat_junk(c: Column, r: NameRules) -> Column:
    s = strip_outer(c)
    return (
        (strip(blank(c)) == "")
        | _any_pattern(s, r.chat_patterns)
        | contains_any(s, r.chat_phrases, casefold=True)
    )


def reject_rule(name: Column, r: NameRules) -> Column:
    """First rule that rejects the name, null for a plausible one."""
    return let(
        strip_outer(name),
        lambda s: let(words(s), lambda parts: _first_failed(s, parts, r)),
    )


def _first_failed(s: Column, parts: Column, r: NameRules) -> Column:
    curated = F.contains(s, F.lit(" — ")) | F.contains(s, F.lit(" / "))
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    n_words = F.size(parts)
    longest = F.when(curated, LONGEST_CURATED).otherwise(LONGEST)
    most_words = F.when(curated, MOST_WORDS_CURATED).otherwise(MOST_WORDS)
    category = ~curated & (
        (
            equals_any(first, r.category_words)
            & ((n_words >= 5) | ((n_words >= 3) & equals_any(second, r.category_followers)))
        )
        | (equals_any(first, r.venue_nouns) & (n_words >= 6))
    )
    described = (
        (n_words >= 2)
        & equals_any(first, r.descriptor_leads)
        & (second.startswith(r.place_prefix) if r.place_prefix else F.lit(False))
    )
    checks = [
        ("too_short", F.length(s) < SHORTEST),
        ("chat_junk", is_chat_junk(s, r)),
        ("too_long", F.length(s) > longest),
        ("bad_start", s.rlike(r"^[\s()?*/.:;!,]+")),
        ("leading_place", _any_pattern(s, r.lead_patterns)),
        ("sentence", _any_pattern(s, r.sentence_patterns)),
        ("spam", _any_pattern(s, r.spam_patterns)),
        ("question", ~curated & F.contains(s, F.lit("?"))),
        ("phrase", contains_any(s, r.reject_phrases, casefold=True)),
        ("early_question", F.contains(F.substring(s, 1, 3), F.lit("?"))),
        (
            "generic",
            equals_any(core_name(s), [g.lower() for g in r.generic_exact])
            & ~F.contains(s, F.lit("(")),
        ),
        ("solo_word", equals_any(F.lower(s), [w.lower() for w in r.solo_words])),
        ("category_pattern", _any_pattern(s, r.category_patterns)),
        ("too_many_words", n_words > most_words),
        ("emoji", emoji_count(s) > MOST_EMOJI),
        ("descriptor", described),
        ("category_phrase", category),
        ("only_parenthesis", s.rlike(r"^\([^)]*\)\s*$") & (F.length(s) < 40)),
        ("open_parenthesis", s.rlike(r"^\)\s+")),
        ("directions", _any_pattern(s, r.direction_patterns) & (F.length(s) > 25)),
        ("event", _any_pattern(s, r.tail_patterns)),
    ]
    return F.coalesce(*[F.when(cond, F.lit(rule)) for rule, cond in checks])


def is_plausible(name: Column, r: NameRules) -> Column:
    return reject_rule(name, r).isNull()


def is_junk_capture(c: Column, r: NameRules) -> Column:
    """Fragments that the extraction patterns catch although they are no name."""
    s = fold_spaces(c)
    return (
        (s == "")
        | is_chat_junk(s, r)
        | equals_any(s, r.junk_exact)
        | starts_with_any(s, r.junk_prefixes)
        | contains_any(s, r.junk_phrases)
        | _any_pattern(s, r.junk_patterns)
        | any_true(contains_all(s, pair) for pair in r.junk_pairs)
    )


def scrub_foreign_letters(
    c: Column, script: str, letters: str, repairs: Sequence[tuple[str, str]] = (), passes: int = 10
) -> Column:
    """Remove stray lower-case runs of another script from a name written in ``script``.

    ``repairs`` are (pattern, text) pairs for letters that stand for one of the script; they come
    first. Each pass removes a run at the start, at the end, between words and inside words; up to
    ten passes are the rule, and a pass that finds nothing changes nothing.
    """
    whole = strip(blank(c))
    for pattern, new in repairs:
        whole = F.regexp_replace(whole, pattern, new)
    t = whole
    for _ in range(passes):
        t = strip(F.regexp_replace(t, rf"^{letters}(?={script})", ""))
        t = strip(F.regexp_replace(t, rf"(?U)(?<={script})\s+{letters}\s*$", ""))
        t = F.regexp_replace(t, rf"(?U)(?<={script})\s+{letters}(?=\s+{script})", " ")
        t = F.regexp_replace(t, rf"(?<={script}){letters}(?={script})", " ")
        t = fold_spaces(t)
    scrubbed = F.when(c.rlike(letters), t).otherwise(fold_spaces(whole))
    return F.when(c.rlike(script), scrubbed).otherwise(blank(c))


def clean_name(raw: Column, r: NameRules, scrub: tuple | None = None) -> Column:
    """A tidy plausible name, or null."""
    s = strip_chars(drop_edit_markers(raw), QUOTES)
    s = F.regexp_replace(s, rf"(?U){SPACE}+", " ")
    lengths = F.length(s).between(*RAW_LENGTHS)
    first = F.substring_index(strip(s), " ", 1)
    bad = (
        equals_any(F.lower(s), r.bad_names)
        | equals_any(s, r.months)
        | equals_any(first, r.months)
        | s.rlike(r"^[\d\s\-+.]+$")
    )
    t = strip(F.regexp_replace(s, rf"(?U)^[*\s]*\*{SPACE}*|{SPACE}*\*[*\s]*$", ""))
    for pattern, new in r.clean_patterns:
        t = strip(F.regexp_replace(t, pattern, new))
    if scrub:
        t = let(t, lambda v: scrub_foreign_letters(v, *scrub))
    tidy = let(
        F.substring(t, 1, CLEAN_LENGTH), lambda v: F.when(is_plausible(v, r), v)
    )
    return F.when(lengths & ~bad, tidy)


def is_generic_label(name: Column, r: NameRules) -> Column:
    """Names a verification step may return that only say what kind of place it is."""
    n = F.lower(fold_spaces(name))
    return (n == "") | equals_any(n, r.generic_labels) | _any_pattern(n, r.label_patterns)


def has_evidence(name: Column, body: Column) -> Column:
    """The whole name, or a token of it, occurs in the message (short tokens do not count)."""
    n, b = F.lower(fold_spaces(name)), F.lower(fold_spaces(body))
    tokens = F.regexp_extract_all(n, F.lit(r"([a-z0-9\x{0590}-\x{05F4}]+)"), F.lit(1))
    local = r"^[\x{0590}-\x{05FF}]"
    strong = F.filter(
        tokens, lambda t: F.when(t.rlike(local), F.length(t) >= 2).otherwise(F.length(t) >= 3)
    )
    return F.contains(b, n) | F.exists(strong, lambda t: F.contains(b, t))


def loose_candidate_ok(name: Column, body: Column, asks: Column, r: NameRules) -> Column:
    """Checks for names found in messages without a strict pattern."""
    n = fold_spaces(name)
    return (
        (n != "")
        & ~equals_any(F.lower(n), [g.lower() for g in r.generic_cuisine])
        & ~F.lower(n).rlike(r"(?U)\bfm\b")
        & ~asks
        & has_evidence(n, body)
    )


def foreign_script_not_in_source(name: Column, source: Column) -> Column:
    """East Asian characters in the name that the source text does not have."""
    odd = F.regexp_extract_all(blank(name), F.lit(f"({EAST_ASIAN})"), F.lit(1))
    return (
        (blank(name) != "")
        & (blank(source) != "")
        & F.exists(odd, lambda ch: ~F.contains(source, ch))
    )
