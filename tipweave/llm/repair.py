"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant.
Rows are kept, given another role, deleted (blank ones and repeats always), and empty turns are put
between; the cheapest edits win, among equals those whose letters (D, I, K, R) come first in ASCII.

Only four states matter: nothing said yet, system said, user said, assistant said. A row maps the
cost of finishing from after it to the cost from before it, so a run of rows is a 4 by 4 matrix of
costs (minimum of sums) and runs compose. That is what spreads one long conversation over tasks:

1. rows get their place by ranges (`tables.running`); a conversation of n rows is cut in blocks of
   about the square root of n, each one row of letters;
2. blocks become matrices, each in its task; going backward over the blocks of a conversation, as
   many as a block has rows, gives the cost vector at each block's end: the checkpoints;
3. each block recomputes its vectors from its checkpoint and follows the tight edits from each
   state, which gives the state it leaves in; going forward over blocks gives where each starts;
4. each block recomputes its vectors once more and writes its edits.

So no task holds more than the square root of a conversation. Conversations of one block go
straight to the last step.

Defined cases: nulls count as one space in role and text, so such a text is blank and such a role
fits nowhere; turns order the rows, nulls first, then role, text and the copies; rows without a
conversation id are a conversation of their own; repeated rows are rows of their own, and faults of
the kind repeat; an empty table gives no rows. Other columns are ignored, whatever their names. One
text may be of any length a row can hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipweave.llm.tables import marked, running, stored

#: Blocks have at least so many rows.
LEAST_BLOCK = 128
SPACE = r"[\x20\x09-\x0D]"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The next turn after each state where a turn is made up, and where a kept initial leads.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINISH = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
FAR = np.int64(1) << 60
#: Letters of rows: four initials (s, u, a, any other) for each of whole, blank or repeat, truncated.
LETTERS = "ABCDEFGHIJKL"
GONE, CUT = 4, 8
ORDER = "DIKR"


def _keep_table() -> np.ndarray:
    """State after keeping an initial in a state, -1 where it does not fit."""
    out = np.full((4, 4), -1)
    out[START, 0] = SYSTEM
    for state in (START, SYSTEM, ASSISTANT):
        out[state, 1] = USER
    out[USER, 2] = ASSISTANT
    return out


KEEP = _keep_table()


def faults(rows: DataFrame) -> DataFrame:
    """The rows with the key ``talk`` of their conversation (`marked`, never null), ``place`` in it,
    its size ``rows``, and the ``fault``: ``blank``, ``duplicate``, ``truncated`` or null."""
    plain = rows.select(
        marked("conv_id").alias("talk"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        # Rows alike in everything may still fall into several ranges.
        F.xxhash64(F.monotonically_increasing_id()).alias("copy"),
    )
    plain = plain.withColumn("said", F.md5(F.col("text").cast("binary")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said"), F.col("copy")]
    placed = running(plain, order, {"rows": F.lit(1)}, "talk").select(
        "talk", "turn", "role", "text", "said",
        F.col("rows_before").alias("place"), F.col("rows_total").alias("rows"),
    )
    placed = stored(placed, "placed")
    keys = ["talk", "role", "said"]
    again = placed.groupBy(*keys).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    met = placed.join(stored(again.where("n > 1").drop("n"), "repeats"), keys, "left")
    bare = F.regexp_replace("text", f"{SPACE}+$", "")
    fault = (
        F.when(bare == "", "blank")
        .when(F.col("place") > F.col("first"), "duplicate")
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    return met.select("talk", "turn", "role", "text", "place", "rows", fault.alias("fault"))


def _block_size() -> Column:
    return F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("rows"))).cast("bigint")


def blocks_of(rows: DataFrame) -> DataFrame:
    """One row per block: its letters in order, and where it stands; ``rows`` come from `faults`."""
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(
        F.col("fault") == "truncated", CUT
    ).otherwise(0)
    letter = F.substring(F.lit(LETTERS), initial + kind + 1, F.lit(1))
    cut = rows.select(
        "talk", F.floor(F.col("place") / _block_size()).alias("block"), "place",
        letter.alias("letter"), F.ceil(F.col("rows") / _block_size()).alias("blocks"),
    )
    gathered = F.array_sort(F.collect_list(F.struct("place", "letter")))
    return cut.groupBy("talk", "block").agg(
        F.array_join(F.transform(gathered, lambda x: x["letter"]), "").alias("letters"),
        F.min("place").alias("place"), F.max("blocks").alias("blocks"),
    )


def _coded(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode(), np.uint8).astype(np.int64) - ord("A")


def _back(code: int, after: np.ndarray) -> np.ndarray:
    """Costs from before a row, per state (last axis), from those after it."""
    initial, kind = code % 4, code - code % 4
    out = after + DELETE
    if kind != GONE:
        extra = TRUNCATED if kind == CUT else 0
        out = np.minimum(out, after[..., NEXT] + REROLE + extra)
        ok = KEEP[:, initial] >= 0
        out[..., ok] = np.minimum(out[..., ok], after[..., KEEP[ok, initial]] + extra)
    for _ in range(2):  # made-up turns lead from user to assistant and back, so two suffice
        out = np.minimum(out, out[..., NEXT] + INSERT)
    return out


def costs(codes: np.ndarray) -> np.ndarray:
    """4 by 4: the least cost over the rows from a state before to a state after."""
    now = np.full((4, 4), FAR)
    np.fill_diagonal(now, 0)  # [after, before]
    for code in codes[::-1]:
        now = _back(code, now)
    return np.minimum(now, FAR).T


def walk(codes: np.ndarray, end: np.ndarray, state: int, last: bool) -> tuple[str, int]:
    """The least letters of the tight edits from a state, and the state they leave."""
    vectors = [end]
    for code in codes[::-1]:
        vectors.append(_back(code, vectors[-1]))
    vectors.reverse()
    edits = []
    for i, code in enumerate(codes):
        initial, kind = code % 4, code - code % 4
        here, after = vectors[i], vectors[i + 1]
        extra = TRUNCATED if kind == CUT else 0
        while True:
            now = here[state]
            if now == after[state] + DELETE:
                edits.append("D")
            elif now == here[NEXT[state]] + INSERT:
                edits.append("I")
                state = NEXT[state]
                continue
            elif KEEP[state, initial] >= 0 and now == after[KEEP[state, initial]] + extra:
                edits.append("K")
                state = KEEP[state, initial]
            else:
                edits.append("R")
                state = NEXT[state]
            break
    while last and state in (SYSTEM, USER):
        edits.append("I")
        state = NEXT[state]
    return "".join(edits), int(state)


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        df["costs"] = [costs(_coded(x)).ravel().tolist() for x in df["letters"]]
        yield df[["talk", "block", "costs"]]


def _checkpoints(df: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a conversation, backward: cost vector at the end of each."""
    df = df.sort_values("block")
    ends, now = [], FINISH
    for m in df["costs"].to_numpy()[::-1]:
        ends.append(now.tolist())
        now = (np.array(m, np.int64).reshape(4, 4) + now[None, :]).min(1)
    df["end"] = ends[::-1]
    return df[["talk", "block", "end"]]


def _leaving(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        last = df["block"] == df["blocks"] - 1
        df["leaves"] = [
            [walk(_coded(x), np.array(end, np.int64), s, z)[1] for s in range(4)]
            for x, end, z in zip(df["letters"], df["end"], last, strict=True)
        ]
        yield df[["talk", "block", "leaves"]]


def _entries(df: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a conversation, forward: the state each begins in."""
    df = df.sort_values("block")
    states, now = [], START
    for leaves in df["leaves"]:
        states.append(now)
        now = leaves[now]
    df["entry"] = states
    return df[["talk", "block", "entry"]]


def _edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        last = df["block"] == df["blocks"] - 1
        df["edits"] = [
            walk(_coded(x), np.array(end, np.int64), s, z)[0]
            for x, end, s, z in zip(df["letters"], df["end"], df["entry"], last, strict=True)
        ]
        yield df[["talk", "block", "blocks", "place", "letters", "entry", "edits"]]


def edited(blocks: DataFrame) -> DataFrame:
    """The blocks with the state they begin in, ``entry``, and their ``edits``."""
    key = "talk string, block bigint"
    blocks = stored(blocks, "blocks")
    long = blocks.where("blocks > 1")
    matrices = long.select("talk", "block", "letters").mapInPandas(
        _matrices, f"{key}, costs array<bigint>"
    )
    ends = matrices.groupBy("talk").applyInPandas(_checkpoints, f"{key}, end array<bigint>")
    long = stored(long.join(stored(ends, "checkpoints"), ["talk", "block"]), "ended")
    leaves = long.mapInPandas(_leaving, f"{key}, leaves array<bigint>")
    entries = leaves.groupBy("talk").applyInPandas(_entries, f"{key}, entry int")
    long = long.join(stored(entries, "entries"), ["talk", "block"])
    end = F.array(*[F.lit(int(x)).cast("bigint") for x in FINISH])
    short = blocks.where("blocks = 1").withColumns({"end": end, "entry": F.lit(START)})
    return short.unionByName(long).mapInPandas(
        _edits, f"{key}, blocks bigint, place bigint, letters string, entry int, edits string"
    )


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per edit that leaves a turn: its place among the edits, and its row or new role."""
    for df in batches:
        out = []
        for talk, block, place, letters, state, edits in df[
            ["talk", "block", "place", "letters", "entry", "edits"]
        ].itertuples(index=False):
            codes, i = _coded(letters), 0
            for at, edit in enumerate(edits):
                role = None
                if edit == "K":
                    state = KEEP[state, codes[i] % 4]
                elif edit != "D":
                    state = NEXT[state]
                    role = ROLE[state]
                if edit != "D":
                    out.append((talk, block, at, edit, None if edit == "I" else place + i, role))
                i += edit != "I"
        made = pd.DataFrame(out, columns=["talk", "block", "at", "edit", "place", "role"])
        made["place"] = pd.array([x[4] for x in out], "Int64")
        yield made


def turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``(talk, block, at, edit, turn, role, text)``: the repaired conversations, in the order of
    ``block, at``. Turns that were put in have no turn number and an empty text."""
    made = stored(
        edits.mapInPandas(
            _turns, "talk string, block bigint, at bigint, edit string, place bigint, role string"
        ).withColumnRenamed("role", "made"),
        "turns",
    )
    put_in = made.where("place IS NULL").select(
        "talk", "block", "at", "edit", F.lit(None).cast("bigint").alias("turn"),
        F.col("made").alias("role"), F.lit("").alias("text"),
    )
    old = rows.select("talk", "place", "turn", "role", "text")
    stay = made.where("place IS NOT NULL").join(old, ["talk", "place"]).select(
        "talk", "block", "at", "edit", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("made", "role").alias("role"), "text",
    )
    return stay.unionByName(put_in)


def tallies(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, faults, illegal neighbours, cost and edits."""
    seen = rows.groupBy("talk", "turn").agg(
        *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    )
    counts = seen.groupBy("talk").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")],
    )
    # Initials of the letters, with the last one of the block before in front.
    initials = F.translate("letters", LETTERS, "suaosuaosuao")
    before = F.lag(initials).over(Window.partitionBy("talk").orderBy("block"))
    run = F.concat(F.coalesce(F.right(before, F.lit(1)), F.lit("")), initials)
    # Looking back by one letter keeps the pairs that overlap.
    legal = F.regexp_count(run, F.lit("(?<=[sa])u|(?<=u)a"))
    stay = F.translate("edits", "I", "")  # one letter per row
    cut_kept = F.size(
        F.filter(
            F.arrays_zip(F.split("letters", "").alias("x"), F.split(stay, "").alias("e")),
            lambda z: (z["x"] >= LETTERS[CUT]) & (z["e"] != "D"),
        )
    )
    count = lambda e: F.length("edits") - F.length(F.translate("edits", e, ""))
    price = count("R") * REROLE + count("D") * DELETE + count("I") * INSERT + cut_kept * TRUNCATED
    per_block = edits.select(
        "talk", "block", "edits", (F.length(run) - 1 - legal).alias("illegal"), price.alias("cost")
    )
    text = F.array_sort(F.collect_list(F.struct("block", "edits")))
    sums = per_block.groupBy("talk").agg(
        F.sum("illegal").cast("bigint").alias("illegal"), F.sum("cost").cast("bigint").alias("cost"),
        F.array_join(F.transform(text, lambda x: x["edits"]), "").alias("audit"),
    )
    return counts.join(sums, "talk")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, done = None, None, []

    def settled() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())],
            ["talk", "repaired_sha256"],
        )
        done.clear()
        return out

    for batch in batches:
        said = batch.column(1)
        for i, talk in enumerate(batch.column(0).to_pylist()):
            if talk != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = talk, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(said[i].as_py())
        yield settled()
    if digest is not None:
        done.append((now, digest.hexdigest()))
        yield settled()


def text_hashes(turns_: DataFrame) -> DataFrame:
    """``(talk, repaired_sha256)``: SHA-256 of the newline-joined ``role:text`` of each repaired
    conversation that has a turn.

    A hash goes from front to back, so each conversation is read by one task; as it streams, memory
    does not grow with the conversation."""
    rows = turns_.repartition("talk").sortWithinPartitions("talk", "block", "at")
    said = F.concat("role", F.lit(":"), "text").cast("binary")
    return rows.select("talk", said.alias("said")).mapInArrow(
        _hashed, "talk string, repaired_sha256 string"
    )


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns of all conversations (`turns`), and what was done to each (`tallies`)."""
    found = stored(faults(rows), "faults")
    edits = stored(edited(blocks_of(found)), "edits")
    return turns(found, edits), tallies(found, edits)
