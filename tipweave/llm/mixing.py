"""Mixing sources to target weights by weighted sampling without replacement.

Targets: the sources share ``share`` times all words by their weights; a target stops at ``limit``
times the words of its source and what it leaves goes to the others by weight, until none is above.
That is one water level ``w``: the target of a source is ``min(limit * size, w * weight)``.

Sampling (Efraimidis and Spirakis): a document with quality ``q`` draws the key ``-ln(u) / q``,
``u`` from a seeded hash of its id, and documents are taken from the smallest key on. A target of
at least the source's size takes whole epochs first, every document once in each; the rest is a
prefix of the key order, found by running sums of the words. Documents are taken whole; the one at
the cut is taken if that brings the sum nearer to the target.

Defined cases: a null source is a source, last in order; a null text has no words and a key like
any other; rows that agree in id, source and text are one item whose words count as often as it
occurs, and are taken together; an empty table gives no rows. Reruns agree, as nothing is drawn but
from hashes. Other columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.llm.tables import marked, running, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 23
#: Quality of a text without letters; keeps keys finite.
LEAST_QUALITY = 0.05


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def letter_share(text: Column) -> Column:
    """Quality weight: letters and single spaces among the characters of the text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(LEAST_QUALITY))


def items(docs: DataFrame, seed: int = SEED, quality: Column | None = None) -> DataFrame:
    """``(doc_id, source, __text, size, times_found, __key)`` per distinct document."""
    quality = letter_share(F.col("text")) if quality is None else quality
    rows = docs.select(
        "doc_id", "source", F.xxhash64("text").alias("__text"),
        word_count(F.col("text")).alias("size"), quality.alias("__quality"),
    )
    found = rows.groupBy("doc_id", "source", "__text").agg(
        F.max("size").alias("size"), F.max("__quality").alias("__quality"),
        F.count(F.lit(1)).alias("times_found"),
    )
    digits = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    u = (F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return stored(found.withColumn("__key", -F.log(u) / F.col("__quality")), "items")


def source_targets(
    found: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``(source, source_size, target)``; ``weights`` repeat over the sources in order."""
    sizes = found.groupBy("source").agg(
        F.sum(F.col("size") * F.col("times_found")).alias("source_size")
    )
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"n": F.lit(1)})
    turn = F.array(*[F.lit(w) for w in weights])[(F.col("n_before") % len(weights)).cast("int")]
    weighed = ranked.select(
        "source", "source_size", turn.alias("weight"),
        (limit * F.col("source_size")).cast("double").alias("most"),
    )
    by_level = running(
        weighed, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()],
        {"cap": F.col("most"), "w": F.col("weight"), "words": F.col("source_size")},
    )
    # The level if exactly the sources before this one stop at their limit. It rises up to the first
    # source that needs not stop, which has the level sought, and falls from there on.
    level = (share * F.col("words_total") - F.col("cap_before")) / (
        F.col("w_total") - F.col("w_before")
    )
    reached = by_level.withColumn("level", level).where(
        F.col("level") * F.col("weight") <= F.col("most")
    )
    sought = reached.agg(F.max("level")).first()[0] or 0.0
    return weighed.select(
        "source", "source_size",
        F.least("most", F.lit(float(sought)) * F.col("weight")).alias("target"),
    )


def draw(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT,
    seed: int = SEED, quality: Column | None = None,
) -> DataFrame:
    """``(doc_id, source, __text, size, times_found, source_size, target, times)`` per document."""
    found = items(docs, seed, quality)
    targets = stored(source_targets(found, weights, share, limit), "targets")
    order = [F.col("__key"), F.col("doc_id"), F.col("__text")]
    words = {"words": F.col("size") * F.col("times_found")}
    summed = running(found, order, words, group="source")
    targets = targets.select(marked("source").alias("__source"), "source_size", "target")
    placed = summed.withColumn("__source", marked("source")).join(targets, "__source")
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("words_before") + F.col("size") * F.col("times_found") / 2
    inside = (F.col("size") > 0) & (middle <= rest)
    return placed.select(
        "doc_id", "source", "__text", "size", "times_found", "source_size", "target",
        (epochs + F.when(inside, 1).otherwise(0)).cast("int").alias("times"),
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    drawn = draw(docs, **settings).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__src"),
        F.col("__text").alias("__txt"), F.col("times").alias("__times"),
    )
    drawn = stored(drawn, "drawn")
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = (
        keyed["doc_id"].eqNullSafe(drawn["__id"]) & keyed["source"].eqNullSafe(drawn["__src"])
        & (keyed["__text"] == drawn["__txt"])
    )
    taken = keyed.join(drawn.where("__times > 0"), same)
    return taken.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.explode(F.array_repeat(F.lit(0), F.col("__times"))).alias("__time"),
    ).drop("__time")
