"""Shards that each hold the whole mixture: proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; row ``r`` of ``n`` stands at the fraction
``(r + 1/2) / n``. All rows are then ordered by that fraction and cut into equal runs. Any run of
the order holds every source in the proportion of the whole, so every shard has the mixture, and
shards differ by at most one row.

Defined cases: a null source is a source of its own; rows without an id, or with the same id, are
ordered by a hash of all their columns; equal rows are told apart by nothing and take neighbouring
places. Equal texts are separate rows and are not kept together. Fewer rows than shards leave
shards empty; an empty table gives no rows. Columns named ``shard`` and ``slot`` are replaced, all
others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm.tables import running, tie_break

SHARDS = 24
SEED = 17


def stratified_shards(
    rows: DataFrame, shards: int = SHARDS, stratum: str = "source", key: str = "doc_id",
    seed: int = SEED,
) -> DataFrame:
    """The rows with ``shard`` (from 0) and ``slot`` (place in the shard, gapless from 0)."""
    kept = rows.drop("shard", "slot")
    keyed = kept.withColumns({
        "__shuffle": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))),
        "__tie": tie_break(kept),
    })
    order = [F.col("__shuffle"), F.col(key), F.col("__tie")]
    ranked = running(keyed, order, {"__rank": F.lit(1)}, group=stratum)
    fraction = (2 * F.col("__rank_before") + 1) / (2 * F.col("__rank_total"))
    ranked = ranked.withColumn("__fraction", fraction).drop("__rank_before", "__rank_total")
    spots = running(
        ranked, [F.col("__fraction"), F.col(stratum), *order], {"__place": F.lit(1)}
    )
    place, total = F.col("__place_before"), F.col("__place_total")
    shard = F.expr(f"__place_before * {shards} div __place_total")
    start = F.expr(f"(shard * __place_total + {shards - 1}) div {shards}")
    return (
        spots.withColumn("shard", shard.cast("int"))
        .withColumn("slot", place - start)
        .select(*[F.col(f"`{c}`") for c in kept.columns], "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of each file in the order of their slots."""
    (
        sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
