"""Passages that occur before: hashing of units of lines, earliest occurrence kept.

A line is cut after its punctuation into units, so that a passage is found wherever it stands in a
line. Units are normalised (lower case, one space between words) and hashed. The earliest document
(by id) that has a digest keeps it, at its first place there; every other occurrence is a repeat.
Neighbouring repeats form a run, and runs of at least ``min_words`` words are cut out of the text:
words and short lines that recur by chance, or common lines like licences, stay. The original
offsets of what was cut are kept.

A passage seldom starts and ends with a unit. A shorter run, of at least ``ANCHOR_WORDS``, is
therefore compared word by word with the earliest document that has its longest unit, up to
``REACH`` words to both sides of that unit, into the partial units at both ends; if at least
``PASSAGE_WORDS`` words agree, they are cut out. Only the words around such units are sent.

Digests are joined with the table of digests that occur more than once. Both are kept or plain
tables, so Spark can split a digest that occurs everywhere; what is gathered per document is its own
cuts only.

Defined cases: a null text has no units and stays null; documents that share an id count as one
rank, so what only they share stays in each of them, and equal rows fare alike; rows without an id
rank last, as one; a text that is all repeats becomes empty, its row stays. ``n_chars`` is set if
the table has it; ``cuts`` and ``cut_chars`` are added or replaced; other columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.llm.tables import stored

#: Runs of whole units this long are cut as they are; punctuation at their ends goes with them.
MIN_WORDS = 32
#: Shorter runs of at least so many words are compared word by word.
ANCHOR_WORDS = 8
#: Words of a passage that is found word by word.
PASSAGE_WORDS = 50
#: Words compared at each side of a unit.
REACH = 64
#: Units of one id that are looked up together.
TOGETHER = 1000
LAST = 2**63 - 1

_WORD = re.compile(r"[^\s.,;:!?]+")
_UNIT = re.compile(r"[^.,;:!?\n]+[.,;:!?]*")
#: Every unit of every text is sent, so its four numbers travel as two: each field of a row of its
#: own takes several bytes more than what it holds. ``at``: place, start; ``size``: length, words
#: and, as the lowest bit, whether its document has had the digest before.
_UNITS = pa.schema([
    ("rank", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.int64()), ("at", pa.int64()),
    ("size", pa.int64()),
])
_UNITS_SQL = "rank bigint, text_hash bigint, digest bigint, at bigint, size bigint"


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, normalised text)`` of the units that hold a word."""
    for m in _UNIT.finditer(text):
        plain = " ".join(m[0].lower().split())
        if plain:
            yield m.start(), m.end(), plain


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per unit."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        ranks, hashes = batch.column("rank").to_pylist(), batch.column("text_hash").to_pylist()
        rows: list[tuple] = []
        for rank, hashed, text in zip(ranks, hashes, batch.column("text"), strict=True):
            seen: set[int] = set()
            for place, (start, end, plain) in enumerate(units(text.as_py() or "")):
                d = digest(plain) - 2**63
                words = plain.count(" ") + 1
                rows.append((
                    rank, hashed, d, place << 32 | start, end - start << 32 | words << 1 | (d in seen)
                ))
                seen.add(d)
                if len(rows) == 50_000:
                    yield _rows(rows)
                    rows = []
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple], schema: pa.Schema = _UNITS) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _again() -> Column:
    return F.col("size").bitwiseAND(1) == 1


def _unpacked(rows: DataFrame) -> DataFrame:
    """``place``, ``start``, ``end`` and ``words`` in place of ``at`` and ``size``."""
    start = F.col("at").bitwiseAND(2**32 - 1)
    return rows.withColumns({
        "place": F.shiftright("at", 32).cast("int"), "start": start.cast("int"),
        "end": (start + F.shiftright("size", 32)).cast("int"),
        "words": F.shiftright(F.col("size").bitwiseAND(2**32 - 1), 1).cast("int"),
    }).drop("at", "size")


#: What a unit is asked for: its document has it again, or had it first.
AGAIN, EARLIEST = 1, 2
_AROUND = pa.schema([
    ("rank", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int32()),
    ("digest", pa.int64()), ("role", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("words", pa.int32()), ("before", pa.string()), ("after", pa.string()),
])
_AROUND_SQL = (
    "rank bigint, text_hash bigint, place int, digest bigint, role int, start int, end int,"
    " words int, before string, after string"
)


def _look_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted units of each text with the text around them, as far as the words reach."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("rank", "text_hash", "wanted")]
        rows: list[tuple] = []
        for rank, hashed, wanted, text in zip(*columns, batch.column("text"), strict=True):
            body, roles = text.as_py() or "", {w["digest"]: w["role"] for w in wanted}
            found = [(m.start(), m.end()) for m in _WORD.finditer(body)]
            starts = [f[0] for f in found]
            for place, (start, end, plain) in enumerate(units(body)):
                d = digest(plain) - 2**63
                role = roles.get(d, 0)
                if not role:
                    continue
                roles[d] = role & AGAIN  # of the earliest document only the first place counts
                first, last = bisect_left(starts, start), bisect_left(starts, end)
                before, after = found[max(0, first - REACH):first], found[last:last + REACH]
                rows.append((
                    rank, hashed, place, d, role, start, end, last - first,
                    body[before[0][0]:start] if before else "",
                    body[end:after[-1][1]] if after else "",
                ))
                if len(rows) == 5_000:
                    yield _rows(rows, _AROUND)
                    rows = []
        if rows:
            yield _rows(rows, _AROUND)


_MET = pa.schema([
    ("rank", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
    ("words", pa.int64()),
])
_MET_COLUMNS = (
    "rank", "text_hash", "start", "end", "words", "run_start", "run_end", "run_words",
    "before", "after", "b", "a",
)


def _agreeing(mine: list[re.Match], theirs: list[re.Match]) -> int:
    """How many leading words of two lists agree."""
    n = 0
    for m, t in zip(mine, theirs, strict=False):
        if m[0].lower() != t[0].lower():
            break
        n += 1
    return n


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of which at least ``PASSAGE_WORDS`` words agree."""
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in _MET_COLUMNS]
        for rank, hashed, start, end, n, run_start, run_end, run_n, *texts in zip(*columns, strict=True):
            before, after, b, a = ([*_WORD.finditer(t)] for t in texts)
            back, on = _agreeing(before[::-1], b[::-1]), _agreeing(after, a)
            if back + n + on < PASSAGE_WORDS:
                continue
            first = start - len(texts[0]) + before[-back].start() if back else start
            last = end + after[on - 1].end() if on else end
            rows.append((
                rank, hashed, min(first, run_start), max(last, run_end), max(back + n + on, run_n)
            ))
        if rows:
            yield _rows(rows, _MET)


def _word_by_word(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Spans of the short runs that belong to a longer passage of the earliest document.

    Units are asked for by the id of their document, for rows without one by their text as well. The
    text around them is sent as it stands: words apart, with their offsets, take several times that.
    """
    of = F.when(F.col("rank") == LAST, F.col("text_hash")).otherwise(F.lit(0)).alias("of")
    same = F.col("first") == F.col("rank")
    mine = short.select("rank", of, "digest", F.lit(AGAIN).alias("role"))
    theirs = short.select(
        F.col("first").alias("rank"),
        F.when(same & (F.col("rank") == LAST), F.col("text_hash")).otherwise(F.lit(0)).alias("of"),
        "digest", F.lit(EARLIEST).alias("role"),
    )
    asked = stored(
        mine.union(theirs).groupBy("rank", "of", "digest").agg(F.bit_or("role").alias("role")), "asked"
    )
    sizes = stored(asked.groupBy("rank", "of").agg(F.count(F.lit(1)).alias("n")), "sizes")
    part = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / TOGETHER)).alias("part")
    sets = asked.join(sizes, ["rank", "of"]).groupBy("rank", "of", part).agg(
        F.collect_list(F.struct("digest", "role")).alias("wanted")
    )
    found = texts.withColumn("of", of).join(stored(sets, "wanted"), ["rank", "of"])
    # Rows that are equal give equal spans, which become one.
    around = stored(
        found.select("rank", "text_hash", "wanted", "text").mapInArrow(_look_around, _AROUND_SQL),
        "around",
    )
    earliest = around.where(F.col("role") >= EARLIEST).groupBy("rank", "digest").agg(
        F.min_by(F.struct("before", "after"), F.struct("text_hash", "place")).alias("seen")
    )
    earliest = stored(earliest.select(
        F.col("rank").alias("first"), "digest", F.col("seen.before").alias("b"),
        F.col("seen.after").alias("a"),
    ), "earliest")
    own = short.select(
        "rank", "text_hash", "place", "first", F.col("start").alias("run_start"),
        F.col("end").alias("run_end"), F.col("words").alias("run_words"),
    )
    again = around.where(F.col("role") != EARLIEST).drop("role")
    met = own.join(again, ["rank", "text_hash", "place"]).join(earliest, ["first", "digest"])
    return met.select(*_MET_COLUMNS).mapInArrow(
        _compared, "rank bigint, text_hash bigint, start int, end int, words bigint"
    )


def _apart(spans: DataFrame) -> DataFrame:
    """Spans of a text that overlap become one."""
    earlier = Window.partitionBy("rank", "text_hash").orderBy("start", "end")
    until = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(until > F.col("start"), 0).otherwise(1)
    return (
        spans.withColumn("new", new).withColumn("span", F.sum("new").over(earlier))
        .groupBy("rank", "text_hash", "span")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("words").alias("words"))
        .drop("span")
    )


def _ranked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("rank"),
        F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"),
    )


def repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(rank, text_hash, start, end, words)`` of the runs of repeats, in code points."""
    every = _ranked(docs, key, text).mapInArrow(_cut_up, _UNITS_SQL)
    common = stored(
        every.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "first"),
        "common",
    )
    later = every.join(common, "digest").where(_again() | (F.col("rank") > F.col("first")))
    later = later.select("digest", "first", "rank", "text_hash", "at", "size").distinct()
    # Numbered as they are sent: unpacked only behind the shuffle.
    nth = F.row_number().over(Window.partitionBy("rank", "text_hash").orderBy("at"))
    later = _unpacked(later.withColumn("nth", nth))
    longest = F.max_by(F.struct("place", "digest", "first"), F.struct("words", "place"))
    runs = stored(
        later.groupBy("rank", "text_hash", (F.col("place") - F.col("nth")).alias("run"))
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
            longest.alias("unit"),
        )
        .where(F.col("words") >= min(ANCHOR_WORDS, min_words)),
        "runs",
    )
    whole = runs.where(F.col("words") >= min_words)
    short = runs.where(F.col("words") < min_words).select(
        "rank", "text_hash", "start", "end", "words", "unit.*"
    )
    spans = whole.select("rank", "text_hash", "start", "end", "words").unionByName(
        _word_by_word(_ranked(docs, key, text), short)
    )
    return _apart(spans)


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents without what occurs before; ``cuts`` has the offsets of what went."""
    spans = repeats(docs, min_words, key, text).groupBy("rank", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "words"))).alias("__cuts")
    )
    spans = stored(spans, "spans").select(
        F.col("rank").alias("__rank"), F.col("text_hash").alias("__text_hash"), "__cuts"
    )
    keyed = docs.drop("cuts", "cut_chars").withColumns({
        "__rank": F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)),
        "__text_hash": F.xxhash64(text),
    })
    rows = keyed.join(spans, ["__rank", "__text_hash"], "left")
    n, cuts = F.size("__cuts"), F.col("__cuts")
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            F.col(text),
            F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"]) + 1,
            F.when(i == n, F.length(text)).otherwise(F.get(cuts, i)["start"])
            - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"]),
        ),
    )
    kept = F.when(cuts.isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    cut_chars = F.aggregate(cuts, F.lit(0), lambda a, c: a + c["end"] - c["start"])
    out = rows.withColumns({"__kept": kept, "cut_chars": F.coalesce(cut_chars, F.lit(0))})
    out = out.withColumn(text, F.col("__kept")).withColumn("cuts", cuts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("bigint"))
    names = [c for c in docs.columns if c not in ("cuts", "cut_chars")]
    return out.select(*[F.col(f"`{c}`") for c in names], "cuts", "cut_chars")
