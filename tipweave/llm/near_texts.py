"""Near-duplicate documents by long SimHash fingerprints, of which one of each group stays.

At 0.8 of shared five-word shingles two texts differ in about 15 % of the bits of a SimHash: too many
for 64 bits and four blocks. So fingerprints have 768 bits here, cut in four orders into 32 blocks of
24 bits each; texts that agree in one of the 128 blocks meet. All copies of a fingerprint are one node.

1. Nodes are dealt by block value; what shares a value with no other goes. The rest get their
   fingerprints back and are kept: the buckets.
2. A task reads its buckets one after another and takes all Hamming distances of a bucket by matrices.
   It sends no pairs: nodes within ``SURE`` bits (no check needed) are sent linked with the least one
   of their part of the bucket, and each part with the nearest node beyond, up to ``MOST`` bits.
   A bucket of over ``CHUNK`` nodes is cut in chunks that meet two by two in tasks of their own.
3. Pairs beyond ``SURE`` count if their texts share 0.8 of their shingles. First the nearest pair of
   each group is checked, for the blocks of the first order and then, with the groups so made, for
   the others; then, among what is still apart, the nearest of each two groups, then all that is
   left. A pair within a group changes nothing and is never checked, so a large group costs about
   one check a node; four rounds do, whatever the size of a bucket.

Defined cases: a null or blank text has a fingerprint of zeros and is like any other such; equal texts
and repeated rows share a node, and one row of them stays; rows without an id stay only if no row of
their group has one; an empty table gives no rows. All columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm.graph import components
from tipweave.llm.simhash import block_choices, majority, shingle_hashes
from tipweave.llm.tables import stored

#: Five words, 768 bits in 32 blocks of 24, cut in four orders.
WORDS, PARTS, BLOCK, ROUNDS = 5, 12, 24, 4
#: Texts that share 0.8 of their shingles differ in about 0.148 of the bits (angle of the cosine
#: 0.89), 114 of 768, give or take 10. Three deviations more are looked at; three less are sure.
MOST, SURE, ALIKE = 144, 84, 0.8
#: Nodes of a bucket that are compared at once.
CHUNK = 1024
NEAREST, GROUPS, ALL = range(3)
LINK, OPEN, LEFT = range(3)


def _printed(words: int, parts: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("prints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [
                np.packbits(majority(shingle_hashes(t.as_py(), words), parts)).tobytes()
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.binary())],
                schema=schema,
            )

    return run


def _blocks(parts: int, block: int, rounds: int):
    """Per node one row for each block (of whole bytes): its number and value in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choices = block_choices(64 * parts, block, rounds)
        table = np.arange(len(choices), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                flat = np.frombuffer(b"".join(some.column("prints").to_pylist()), np.uint8)
                bits = np.unpackbits(flat.reshape(len(some), -1), axis=1)
                packed = np.packbits(bits[:, choices.ravel()], axis=1)
                keys = np.broadcast_to(table, (len(some), len(choices)))
                for one in packed.reshape(len(some), len(choices), block // 8).transpose(2, 0, 1):
                    keys = keys << 8 | one
                node = np.repeat(np.array(some.column("node")), len(choices))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(node)], ["bucket", "node"]
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by bucket, of buckets with another row; the last one waits for the next batch."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def out(bucket, node, keep):
        return pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(node[keep])], ["bucket", "node"])

    for batch in batches:
        bucket = np.concatenate([held[0], np.array(batch.column(0))])
        node = np.concatenate([held[1], np.array(batch.column(1))])
        keep = np.concatenate([held[2], np.zeros(len(batch), bool)])
        same = bucket[1:] == bucket[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        held = bucket[-1:], node[-1:], keep[-1:]
        yield out(bucket[:-1], node[:-1], keep[:-1])
    yield out(*held)


def buckets_of(nodes: DataFrame, parts: int = PARTS, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``(bucket, one, other, chunk, node, prints)`` for all buckets of several nodes; a bucket that
    is cut in chunks is there once for each two of them."""
    keyed = nodes.mapInArrow(_blocks(parts, block, rounds), "bucket bigint, node bigint")
    shared = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _shared, "bucket bigint, node bigint"
    )
    shared = stored(shared, "shared")
    sizes = shared.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    sizes = stored(sizes.where("chunks > 1"), "sizes")
    cut = shared.join(sizes, "bucket", "left").withColumn(
        "chunks", F.coalesce("chunks", F.lit(1).cast("bigint"))
    ).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("with")
    cut = cut.select("bucket", "chunk", "node", others).select(
        "bucket", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"),
        "chunk", "node",
    )
    return stored(cut.join(nodes.select("node", "prints"), "node"), "buckets")


def distances(prints: np.ndarray) -> np.ndarray:
    """Bits that differ between any two rows of 64-bit words."""
    out = np.zeros((len(prints), len(prints)), np.int16)
    for a in range(0, len(prints), 256):
        for word in prints.T:
            out[a : a + 256] += np.bitwise_count(word[a : a + 256, None] ^ word[None, :])
    return out


def _parts(linked: np.ndarray) -> np.ndarray:
    """The least row of each connected part of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(label)).min(1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(most: int, sure: int, what: int):
    """Of each bucket: sure links (``kind`` `LINK`) and pairs to check (`OPEN`) as ``(u, v, far)``, u
    below v; in the first round also the buckets (`LEFT`) where later ones can find any."""

    def of_bucket(bucket, one, other, node, root, chunk, prints):
        order = np.argsort(node)
        node, root, chunk, prints = node[order], root[order], chunk[order], prints[order]
        if (root == root[0]).all():
            return
        of = np.full(len(node), OPEN)
        far = distances(prints)
        open_ = (root[:, None] != root[None, :]) & (far <= most)
        if chunk.min() != chunk.max():  # each chunk alone is another group
            open_ &= chunk[:, None] != chunk[None, :]
        if what == NEAREST:
            part = _parts((root[:, None] == root[None, :]) | (open_ & (far <= sure)))
            _, first = np.unique(root, return_index=True)  # one member of each group
            hit = first[root[first] != root[part[first]]]
            yield node[part[hit]], node[hit], far[part[hit], hit].astype(np.int64), of[hit] * 0 + LINK
            # Of each part the nearest pair with another one.
            open_ &= part[:, None] != part[None, :]
            reach = np.where(open_, far, np.int16(32767))
            best = reach.argmin(1)
            near = reach[np.arange(len(node)), best]
            order = np.lexsort((near, part))
            i = order[np.unique(part[order], return_index=True)[1]]
            i = i[near[i] < 32767]
            a, b = np.minimum(i, best[i]), np.maximum(i, best[i])
            a, b = np.unique(np.stack([a, b]), axis=1)
            yield node[a], node[b], far[a, b].astype(np.int64), of[a]
            if len(i):
                yield bucket[:1], one[:1], other[:1], of[:1] * 0 + LEFT
            return
        i, k = np.nonzero(np.triu(open_, 1))
        if what == GROUPS and len(i):
            low, high = np.minimum(root[i], root[k]), np.maximum(root[i], root[k])
            order = np.lexsort((far[i, k], high, low))
            first = np.ones(len(order), bool)
            low, high = low[order], high[order]
            first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            i, k = i[order[first]], k[order[first]]
        yield node[i], node[k], far[i, k].astype(np.int64), of[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                if not len(batch):
                    continue
                now = [np.array(batch.column(c)) for c in ("bucket", "one", "other", "node", "root", "chunk")]
                flat = np.frombuffer(b"".join(batch.column("prints").to_pylist()), np.uint64)
                now.append(flat.reshape(len(batch), -1))
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is None:
                continue
            new = (np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)
            ends = [0, *(np.flatnonzero(new) + 1).tolist()]
            if batch is None:
                ends.append(len(held[0]))
            found = [
                p for a, b in zip(ends, ends[1:])
                for p in of_bucket(*(x[a:b] for x in held))
            ]
            held = [x[ends[-1] :] for x in held]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v", "far", "kind"]
                )

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _pairs_of(buckets: DataFrame, roots: DataFrame | None, most: int, sure: int, what: int) -> DataFrame:
    rows = buckets
    root = F.col("node")
    if roots is not None:
        rows = rows.join(roots, "node", "left")
        root = F.coalesce("root", "node")
    rows = rows.select("bucket", "one", "other", "node", root.alias("root"), "chunk", "prints")
    keys = ["bucket", "one", "other"]
    pairs = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _pairs(most, sure, what), "u bigint, v bigint, far bigint, kind bigint"
    )
    return stored(pairs, "pairs")


def _alike(words: int, least: float):
    """Pairs of texts that share at least ``least`` of all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x = np.unique(shingle_hashes(a.as_py(), words))
                y = np.unique(shingle_hashes(b.as_py(), words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= least * (len(x) + len(y) - both))
            ends = batch.select(["u", "v", "root_u", "root_v"])
            yield ends.append_column("alike", pa.array(same, pa.bool_()))

    return run


def _checked(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """``(u, v, root_u, root_v, alike)``; texts are ``(node, text)``."""
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "wanted")
    some = stored(texts.join(wanted, "node").dropDuplicates(["node"]), "texts")
    for end, name in (("u", "a"), ("v", "b")):
        pairs = pairs.join(some.select(F.col("node").alias(end), F.col("text").alias(name)), end)
    return stored(
        pairs.select("u", "v", "root_u", "root_v", "a", "b").mapInArrow(
            _alike(words, least),
            "u bigint, v bigint, root_u bigint, root_v bigint, alike boolean",
        ),
        "checked",
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups, with the groups."""
    for end in ("u", "v"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        pairs = pairs.join(at, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.where("root_u <> root_v")


def _merged(roots: DataFrame, linked: DataFrame) -> DataFrame:
    """The groups with those joined that are linked: only groups are looked at again."""
    links = linked.select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    new = components(links)
    onward = new.select(F.col("node").alias("root"), F.col("root").alias("new"))
    moved = roots.join(onward, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return stored(moved.unionByName(new), "roots")


def groups(
    nodes: DataFrame, texts: DataFrame, most: int = MOST, sure: int = SURE, words: int = WORDS,
    least: float = ALIKE, parts: int = PARTS,
) -> DataFrame:
    """``(node, root)`` of the nodes ``(node, prints)`` that are not the least of their group."""
    buckets = buckets_of(nodes, parts)
    pair = F.struct("far", "u", "v", "root_u", "root_v")
    of_first = F.shiftright("bucket", BLOCK) < 64 * parts // BLOCK
    roots = seen = some = None
    # The first order of blocks makes most of a group one; the others then have little to say of it.
    for what, wave in ((NEAREST, of_first), (NEAREST, ~of_first), (GROUPS, None), (ALL, None)):
        if what == NEAREST:
            found = _pairs_of(buckets.where(wave), roots, most, sure, what)
            links = found.where(F.col("kind") == LINK).select("u", "v")
            if roots is None:
                roots = components(links)
            else:
                roots = _merged(roots, _apart(links, roots))
            left = found.where(F.col("kind") == LEFT).select(
                F.col("u").alias("bucket"), F.col("v").alias("one"), F.col("far").alias("other")
            )
            # Buckets that the later rounds read again.
            more = buckets.where(wave).join(left, ["bucket", "one", "other"], "left_semi")
            some = more if some is None else some.unionByName(more)
            found = found.where(F.col("kind") == OPEN)
        else:
            if what == GROUPS:
                some = stored(some, "left")
            found = _pairs_of(some, roots, most, sure, what)
        open_ = _apart(found.select("u", "v", "far").distinct(), roots)
        if seen is not None:
            open_ = open_.join(seen, ["u", "v"], "left_anti")
        chosen = open_
        if what == NEAREST:  # of each group, from whichever bucket
            ends = open_.select(pair.alias("p"), F.explode(F.array("root_u", "root_v")).alias("of"))
            chosen = ends.groupBy("of").agg(F.min("p").alias("p")).select("p.*").distinct()
        elif what == GROUPS:
            two = [F.least("root_u", "root_v").alias("a"), F.greatest("root_u", "root_v").alias("b")]
            chosen = open_.groupBy(*two).agg(F.min(pair).alias("p")).select("p.*")
        chosen = stored(chosen, "chosen")
        if chosen.isEmpty():
            continue
        checked = _checked(chosen, texts, words, least)
        done = checked.select("u", "v")
        seen = done if seen is None else seen.unionByName(done)
        roots = _merged(roots, checked.where("alike"))
    return roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those near one of smaller id; equal rows leave one."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    prints = rows.mapInArrow(
        _printed(WORDS, PARTS), "doc_id bigint, text_hash bigint, prints binary"
    ).withColumn("node", F.xxhash64("prints"))
    prints = stored(prints, "prints")
    # Nodes are fingerprints; any of their texts stands for the rest.
    nodes = prints.groupBy("node").agg(
        F.min("prints").alias("prints"), F.min("text_hash").alias("text_hash")
    )
    nodes = stored(nodes, "nodes")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(
        nodes.select("node", "text_hash"), "text_hash"
    ).select("node", "text")
    roots = groups(nodes.select("node", "prints"), texts)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")
    rooted = prints.select("node", "doc_id", "text_hash").join(roots, "node", "left")
    counted = rooted.groupBy(
        F.coalesce("root", "node").alias("root"), "doc_id", "text_hash"
    ).agg(F.count(F.lit(1)).alias("times"))
    first = counted.groupBy("root").agg(F.min(F.struct(place.alias("place"), "times")).alias("first"))
    chosen = stored(
        first.select(
            F.col("first.place.doc_id").alias("__id"), F.col("first.place.text_hash").alias("__hash"),
            F.col("first.times").alias("__times"),
        ),
        "chosen",
    )
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = keyed.join(
        chosen,
        keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed["__text_hash"] == chosen["__hash"]),
    )
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.where("__times = 1").select(*own)
    # Copies of the row itself: any of them.
    first_copy = kept.where("__times > 1").dropDuplicates(["__id", "__hash"])
    return single.unionByName(first_copy.select(*own))
