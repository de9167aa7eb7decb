"""String expressions. All are Column -> Column and stay inside generated code.

Regexes carry ``(?U)`` so that white space and digits follow Unicode, not ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the source data defines it, direction marks, name punctuation.
SPACE = r"[\s\x1c-\x1f]"
WHITE = "".join(map(chr, (
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)))
NBSP = "\u00a0"
DIRECTION_MARKS = "\u200e\u200f"
SENDER_MARKS = "\u200e\u200f\u202a\u202c"
NAME_PUNCTUATION = "-–—.,;:!?\"'״׳()[]{}|/\\"
DASHES = r"[\x{2D}\x{2010}-\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}]+"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}]+"
)
EDIT_MARKERS = ("<This message was edited>", "<הודעה זו נערכה>", "<הודעה נערכה>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it.

    Expressions inside lambdas and conditional branches are not shared by the optimizer.
    """
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def strip(c: Column) -> Column:
    """Both ends, any white space (the built-in trim takes plain spaces only)."""
    return F.btrim(c, F.lit(WHITE))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def blank(c: Column) -> Column:
    """Null, missing and empty mean the same in catalogue columns."""
    return F.coalesce(c, F.lit(""))


def non_blank(c: Column) -> Column:
    """Null when empty, for use inside coalesce."""
    return F.when(c != "", c)


def fold_spaces(c: Column) -> Column:
    kept = F.translate(blank(c), NBSP + DIRECTION_MARKS, " ")
    return strip(F.regexp_replace(kept, rf"(?U){SPACE}+", " "))


def fold_name(c: Column) -> Column:
    """Punctuation to spaces, spaces folded, lower case: the key of the duplicate search."""
    spaced = F.translate(fold_spaces(c), NAME_PUNCTUATION, " " * len(NAME_PUNCTUATION))
    return F.lower(strip(F.regexp_replace(spaced, rf"(?U){SPACE}+", " ")))


def unify_spelling(c: Column, variants: dict[str, str]) -> Column:
    for written, unified in variants.items():
        c = F.replace(c, F.lit(written), F.lit(unified))
    return c


def name_from_first_letter(c: Column) -> Column:
    """Drop everything before the first letter; keep the name if no letter is found."""
    whole = strip(blank(c))
    cut = strip(F.regexp_replace(whole, r"^\P{L}+", ""))
    return F.when(cut != "", cut).otherwise(whole)


def clean_sender(c: Column) -> Column:
    bare = F.translate(blank(c), SENDER_MARKS, "")
    return strip(F.regexp_replace(bare, r"(?U)^[\x{202B}\s]+|[\x{202B}\s]+$", ""))


def drop_edit_markers(c: Column) -> Column:
    c = blank(c)
    for marker in EDIT_MARKERS:
        c = F.regexp_replace(c, rf"(?iU){SPACE}*\Q{marker}\E{SPACE}*", " ")
    return fold_spaces(c)


def cap(c: Column, n: int, ellipsis: str = "") -> Column:
    """At most n characters; the ellipsis is added only when something was cut."""
    if not ellipsis:
        return F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping count of a non-empty word."""
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return F.floor(gone / F.length(word))


def words(c: Column) -> Column:
    """Tokens of an already folded text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def strip_trailing_note(c: Column) -> Column:
    """Remove one trailing parenthesis, then trailing asterisks."""
    bare = strip(F.regexp_replace(strip(blank(c)), rf"(?U){SPACE}*\([^)]*\){SPACE}*$", ""))
    return strip(F.regexp_replace(bare, rf"(?U)[*\s]*\*$", ""))


def only_emoji(c: Column) -> Column:
    """True for emoji and white space alone, and for an empty text."""
    return strip(F.regexp_replace(blank(c), EMOJI, "")) == ""


def emoji_count(c: Column) -> Column:
    return F.regexp_count(blank(c), F.lit(r"[\x{10000}-\x{10FFFF}]"))


def ordered_distinct_join(parts: Column, sep: str = " | ") -> Column:
    """Join an ordered array: blanks dropped, first spelling of each part kept."""
    clean = F.filter(F.transform(parts, strip), lambda p: p != "")
    return F.array_join(F.array_distinct(clean), sep)


def year_in_text(c: Column) -> Column:
    """Year of a free-text source line: D/M/Y, else M/Y with a real month, else 20xx."""
    s = blank(c)
    full = F.regexp_extract(s, r"(?U)(\d{1,2})/(\d{1,2})/(\d{4})", 3).try_cast("int")
    month_years = F.transform(
        F.regexp_extract_all(s, F.lit(r"(?<!\d)(\d{1,2}/\d{4})(?!\d)"), F.lit(1)),
        lambda m: F.struct(
            F.split(m, "/")[0].try_cast("int").alias("month"),
            F.split(m, "/")[1].try_cast("int").alias("year"),
        ),
    )
    valid = F.filter(
        month_years, lambda m: m["month"].between(1, 12) & m["year"].between(1990, 2100)
    )
    by_month = F.try_element_at(valid, F.lit(1))["year"]
    bare = F.regexp_extract(s, r"(?U)\b(20\d{2})\b", 1).try_cast("int")
    return F.coalesce(full, by_month, bare)
