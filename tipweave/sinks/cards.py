"""Contact cards as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phone import international, is_mobile
from tipweave.functions.text import blank, non_blank, strip

# Limits of a card and the name of a card without one.
MOST_PHONES, NAME_CAP, TITLE_CAP, EXTRA_CAP = 25, 400, 500, 2000
NO_NAME = "איש קשר"


def escape(c: Column) -> Column:
    c = blank(c)
    for written, escaped in (
        ("\\", "\\\\"), ("\r\n", "\n"), ("\r", "\n"), ("\n", "\\n"), (";", "\\;"), (",", "\\,"),
    ):
        c = F.replace(c, F.lit(written), F.lit(escaped))
    return c


def card_text(name: Column, phones: Column, field: Column, extra: Column) -> Column:
    """vCard 3.0 text, null without a usable phone. The first mobile is the preferred number.

    Of a phone list the first ``MOST_PHONES`` count, blank ones among them; ``split_phones`` drops
    blanks before that cut.
    """
    listed = F.filter(
        F.transform(F.slice(phones, 1, MOST_PHONES), lambda p: strip(blank(p))), lambda p: p != ""
    )
    numbers = F.filter(F.transform(listed, international), lambda p: p != "")
    mobiles = F.transform(numbers, lambda p: is_mobile(p))
    preferred = F.array_position(mobiles, F.lit(True))
    lines = F.transform(
        numbers,
        lambda p, i: F.concat(
            F.lit("TEL;TYPE="),
            F.when(i + 1 == preferred, "CELL,PREF").when(is_mobile(p), "CELL").otherwise("VOICE"),
            F.lit(":"),
            escape(p),
        ),
    )
    shown = escape(
        F.coalesce(non_blank(F.substring(strip(blank(name)), 1, NAME_CAP)), F.lit(NO_NAME))
    )
    title = F.substring(strip(blank(field)), 1, TITLE_CAP)
    more = F.substring(strip(blank(extra)), 1, EXTRA_CAP)
    text = F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VCARD"),
        F.lit("VERSION:3.0"),
        F.concat(F.lit("FN:"), shown),
        F.concat(F.lit("N:;"), shown, F.lit(";;;")),
        lines,
        F.when(title != "", F.concat(F.lit("TITLE:"), escape(title))),
        F.when(more != "", F.concat(F.lit("X-EXTRA-INFO:"), escape(more))),
        F.lit("END:VCARD"),
    )
    return F.when(F.size(numbers) > 0, text)


def split_phones(all_phones: Column) -> Column:
    """The phones of a text that joins them by bars."""
    return F.filter(
        F.transform(F.split(blank(all_phones), r"\|"), lambda p: strip(p)), lambda p: p != ""
    )


def write_cards(cards: DataFrame, card: str, path: str) -> None:
    """One card after the other; a reader finds them by their begin line."""
    cards.filter(F.col(card).isNotNull()).select(card).write.mode("overwrite").option(
        "lineSep", "\r\n"
    ).text(path)
