"""Near-duplicates by SimHash: pigeonhole blocks, joins on them, Hamming distance.

A fingerprint has a bit set where over half of the shingle hashes have it set. It is split into
blocks so that close fingerprints agree in some (`tables`), rows meet by equal blocks, and their
distance is then taken. Copies are folded first: nodes are distinct fingerprints.

No bucket is paired off whole. Buckets of up to ``LIGHT`` fingerprints are joined with themselves. In
larger ones every fingerprint is written to the keys it reaches by turning no bit or one bit; two
fingerprints share a key exactly if they differ in two bits at most, and at most 65 share one, so
linking each with the least of its key gives all links by rows in proportion. Both ways give the same
links. Longer fingerprints, with checks by text, are in `near_texts`.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal texts and
repeated rows share a node; rows without an id count, but never name a component that has an id;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipweave.llm.graph import components
from tipweave.llm.tables import stored

LIGHT = 64
SEED = 42
#: Shingles whose bits are counted at once.
PIECE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if there are fewer."""
    found = (text or "").encode().lower().split()  # both go by ASCII on bytes
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    spans = zip(starts[:n].tolist(), ends[len(found) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def _again(h: np.ndarray, turn: int) -> np.ndarray:
    """Further 64 bits per hash."""
    if not turn:
        return h
    x = h + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray, parts: int) -> np.ndarray:
    """Per bit, highest first in each part: is it set in over half of the hashes?"""
    total = np.zeros(64 * parts, np.int64)
    for at in range(0, len(h), PIECE):
        piece = h[at : at + PIECE]
        for turn in range(parts):
            bits = np.unpackbits(_again(piece, turn).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            full = len(bits) // 255 * 255  # so many ones fit a byte
            sums = bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
            rest = bits[full:].sum(0, dtype=np.uint8)
            total[64 * turn : 64 * turn + 64] += sums + rest
    return 2 * total > len(h)


def block_choices(bits: int, block: int, rounds: int) -> np.ndarray:
    """Bit numbers of the blocks: all bits in order, then in ``rounds - 1`` fixed shuffled orders."""
    rng = np.random.default_rng(SEED)
    orders = [np.arange(bits), *[rng.permutation(bits) for _ in range(rounds - 1)]]
    return np.concatenate([o[: bits // block * block].reshape(-1, block) for o in orders])


def _printer(words: int, parts: int, block: int, rounds: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()),
        ("prints", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = block_choices(64 * parts, block, rounds) if block else None
        for batch in batches:
            prints, blocks = [], []
            for t in batch.column("text"):
                bits = majority(shingle_hashes(t.as_py(), words), parts)
                prints.append(np.packbits(bits).view(">i8").astype(np.int64))
                if block:
                    blocks.append(bits[choices] @ (1 << np.arange(block, dtype=np.int64)))
                else:
                    blocks.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"),
                 pa.array(prints, schema.types[2]), pa.array(blocks, schema.types[3])],
                schema=schema,
            )

    return run


def fingerprints(
    docs: DataFrame, words: int, parts: int = 1, block: int = 0, rounds: int = 1
) -> DataFrame:
    """``(doc_id, text_hash, prints, blocks)``: ``parts`` times 64 bits, and the values of blocks
    of ``block`` bits, cut ``rounds`` times in different orders, if that is given."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return rows.mapInArrow(
        _printer(words, parts, block, rounds),
        "doc_id bigint, text_hash bigint, prints array<bigint>, blocks array<bigint>",
    )


def pair_tables(count: int, share: int) -> list[int]:
    """Masks of 64 bits: all choices of ``share`` out of ``count`` equal blocks."""
    width = 64 // count
    block = [((1 << width) - 1) << (width * i) for i in range(count)]
    masks = [sum(block[i] for i in some) for some in combinations(range(count), share)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: str, b: str, parts: int) -> Column:
    return sum(
        (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(parts)), F.lit(0)
    )


def _self_join(members: DataFrame, most: int, parts: int) -> DataFrame:
    here = members.select("t", "key", F.col("node").alias("u"), F.col("prints").alias("__a"))
    there = members.select("t", "key", F.col("node").alias("v"), F.col("prints").alias("__b"))
    pairs = here.join(there, ["t", "key"]).where("u < v")
    return pairs.select("u", "v", _distance("__a", "__b", parts).alias("far")).where(
        F.col("far") <= most
    )


def _turned(members: DataFrame) -> DataFrame:
    """All links of at most two bits among the members, by the keys one bit away."""
    nodes = members.select("node").distinct()
    bits = [F.lit(0).cast("bigint"), *[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64)]]
    keys = nodes.select(
        F.col("node"),
        F.explode(F.array(*[F.col("node").bitwiseXOR(b) for b in bits])).alias("reached"),
    )
    least = keys.groupBy("reached").agg(F.min("node").alias("least"))
    return keys.join(least, "reached").where("least < node").select(
        F.col("least").alias("u"), F.col("node").alias("v"),
        F.bit_count(F.col("least").bitwiseXOR(F.col("node"))).alias("far"),
    )


def links(nodes: DataFrame, most: int) -> DataFrame:
    """``(u, v, far)`` that connect what lies within ``most`` bits, and the bits that differ; nodes
    are ``(node, prints, keys)``."""
    # Few buckets are shared, so whole fingerprints are looked up for what is in those only.
    members = stored(nodes.select("node", F.posexplode("keys").alias("t", "key")), "members")
    sizes = members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = members.join(stored(sizes, "buckets"), ["t", "key"])
    met = stored(shared.withColumn("prints", F.array("node")), "met")
    light = _self_join(met.where(F.col("n") <= LIGHT), most, 1)
    return light.union(_turned(met.where(F.col("n") > LIGHT).drop("n")))


def labelled(prints: DataFrame, most: int, masks: list[int]) -> DataFrame:
    """Each row of ``prints`` with its ``node`` and the ``root`` node of its group."""
    rows = prints.withColumn("node", F.col("prints")[0])
    keys = F.array(*[F.col("node").bitwiseAND(F.lit(m)) for m in masks])
    nodes = rows.select("node", "prints", keys.alias("keys")).dropDuplicates(["node"])
    roots = components(links(nodes, most)).withColumnRenamed("node", "__node")
    return rows.join(roots, rows["node"] == roots["__node"], "left").select(
        "doc_id", "text_hash", "prints", "node", F.coalesce("root", "node").alias("root")
    )


def components_of(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` with 64-bit fingerprints."""
    if most != 2:
        raise ValueError("four blocks, two of them shared, are made for a distance of two bits")
    prints = stored(fingerprints(docs, words), "prints")
    rows = stored(labelled(prints, most, pair_tables(4, 2)), "labelled")
    least = stored(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id"
    )
