"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties,
repeated rows, extra and clashing columns, no rows at all."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, pool: int = 400) -> list[str]:
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    prose = [" ".join(words(rng, 60)) + "." for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(prose)]
    long_text = " ".join(words(rng, 30_000))
    rows += [
        (20, None, "en", "s0", None),
        (21, "", None, "s1", 0),
        (22, " \n\t ", "en", None, 4),
        (None, "no id here, but text", "en", "s2", 20),
        (None, None, None, None, None),
        (24, long_text, "en", "s0", len(long_text)),
        (25, prose[0], "en", "s1", len(prose[0])),
        (25, prose[0], "en", "s1", len(prose[0])),
        (26, "ä ö 漢字 \U0001f600 end", "de", "s2", 13),
        (26, "another text under the same id", "de", "s2", 30),
    ]
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """The table with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("shard", "slot", "score", "root", "node", "rank", "start", "times", "size", "piece")
    return docs.withColumns({n: F.lit(f"mine {n}") for n in names})
