"""Which phrases of uncategorised entries should become keywords?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.functions.phrases import any_true
from tipweave.functions.text import blank, let, strip

TOP_PAIRS, TOP_PHRASES = 80, 40
PHRASE_LENGTH, NOTE_LENGTH = 50, 200


def uncategorised(entries: DataFrame) -> DataFrame:
    return entries.filter(strip(blank(F.col("field"))) == "")


def suggested_keywords(
    entries: DataFrame, patterns: Sequence[tuple[str, str]], text: str, top: int | None = TOP_PAIRS
) -> DataFrame:
    """(phrase, field, n): what the first fitting pattern of each row matched, most frequent first."""
    hits = [
        let(
            F.regexp_extract(F.col(text), f"(?iU)({p})", 1),
            lambda m, label=label: F.when(
                m != "",
                F.struct(
                    F.substring(strip(m), 1, PHRASE_LENGTH).alias("phrase"),
                    F.lit(label).alias("field"),
                ),
            ),
        )
        for p, label in patterns
    ]
    counted = (
        entries.select(F.coalesce(*hits).alias("hit"))
        .filter("hit IS NOT NULL")
        .groupBy("hit.phrase", "hit.field")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = counted.orderBy(F.desc("n"), "phrase", "field")
    return ranked if top is None else ranked.limit(top)


def phrase_counts(
    entries: DataFrame,
    counters: Sequence[tuple],
    top: int | None = TOP_PHRASES,
) -> DataFrame:
    """(phrase, n) for counters ``(phrase, groups[, none_of])``.

    A group is a list of (column, word) tests of which one must hold; all groups must hold, and
    none of ``none_of``. All counters are one aggregate over the rows.
    """
    name = strip(blank(F.col("name")))
    note = F.substring(strip(blank(F.col("note"))), 1, NOTE_LENGTH)
    columns = {"name": name, "note": note}

    def test(pairs):
        return any_true(F.contains(columns[c], F.lit(w)) for c, w in pairs)

    def holds(groups, none_of=()):
        fits = ~test(none_of)
        for group in groups:
            fits = fits & test(group)
        return fits

    sums = [F.count_if(holds(*c[1:])).alias(f"c{i}") for i, c in enumerate(counters)]
    totals = entries.agg(*sums)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(phrase).alias("phrase"), F.col(f"c{i}").alias("n"))
                for i, (phrase, *_) in enumerate(counters)
            ]
        )
    )
    ranked = totals.select(rows.alias("r")).select("r.*").filter("n > 0").orderBy(
        F.desc("n"), "phrase"
    )
    return ranked if top is None else ranked.limit(top)
