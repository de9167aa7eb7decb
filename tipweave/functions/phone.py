"""Phone keys and forms. The pipelines join on ``national``; overlays and votes use ``last10``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipweave.functions.text import blank

# Country code, valid national numbers and the mobile lead digit.
COUNTRY_CODE = "972"
VALID_NATIONAL = (r"^05[0-9]\d{7}$", r"^0[23489]\d{8}$", r"^07[234679]\d{7}$", r"^0[23489]\d{7}$")
MOBILE_LEAD = "5"


def digits(c: Column) -> Column:
    return F.regexp_replace(blank(c.cast("string")), r"[^\p{Nd}]", "")


def national(c: Column, country_code: str = COUNTRY_CODE) -> Column:
    d = F.regexp_replace(digits(c), f"^{country_code}", "0")
    return F.when(d.rlike(r"^[2-9]\d{8}$"), F.concat(F.lit("0"), d)).otherwise(d)


def last10(c: Column) -> Column:
    d = digits(c)
    return F.when(d != "", F.right(d, F.lit(10))).otherwise(blank(c.cast("string")))


def international(c: Column) -> Column:
    x = F.regexp_replace(blank(c.cast("string")), r"[^\p{Nd}+]", "")
    return F.when((x == "") | x.startswith("+"), x).otherwise(F.concat(F.lit("+"), x))


def is_valid(c: Column, patterns: tuple[str, ...] = VALID_NATIONAL) -> Column:
    return national(c).rlike("|".join(patterns))


def is_mobile(c: Column, country_code: str = COUNTRY_CODE) -> Column:
    rest = F.regexp_replace(digits(c), f"^(?:{country_code}|0)", "")
    return (F.length(rest) >= 9) & rest.startswith(MOBILE_LEAD)


def sort_key(c: Column) -> Column:
    """Mobiles first, then other national numbers, then the rest; digits break ties."""
    d = digits(c)
    rank = (
        F.when(d.startswith("0" + MOBILE_LEAD) & (F.length(d) >= 9), 0)
        .when(d.startswith("0"), 1)
        .otherwise(2)
    )
    return F.struct(rank.alias("rank"), d.alias("digits"), blank(c).alias("phone"))
