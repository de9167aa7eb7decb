"""Connected components by hooking every node to its smallest neighbour and contracting.

A round takes three steps: each node points to the smallest node among itself and its neighbours,
which is an aggregate that combines before the shuffle; pointers are followed to their ends, in
twice as long steps each time; edges move to where their ends point, and those within one go. Pointers only lead to smaller nodes, so they
form trees. Tables are kept after each round, so joins see plain tables that Spark can split at a
hot node. The neighbours of a node are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm.tables import stored

#: Nodes with a smaller neighbour vanish in each round, so real graphs take a few rounds.
MOST_ROUNDS = 100


def _follow(pointers: DataFrame) -> DataFrame:
    onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("__next"))
    return pointers.join(onward, "root", "left").select(
        "node", F.coalesce("__next", "root").alias("root")
    )


def _unfinished(pointers: DataFrame) -> bool:
    nodes = pointers.select(F.col("node").alias("root"))
    return not pointers.join(nodes, "root", "left_semi").isEmpty()


def _moved(edges: DataFrame, end: str, pointers: DataFrame) -> DataFrame:
    at = pointers.select(F.col("node").alias(end), F.col("root").alias("__at"))
    return edges.join(at, end, "left").withColumn(end, F.coalesce("__at", end)).drop("__at")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of the edges ``(u, v)`` that are not the least of their
    component; ``root`` is the least. All other nodes are their own root."""
    left = stored(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    rounds = []
    while not left.isEmpty():
        if len(rounds) == MOST_ROUNDS:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
        pointers = stored(left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "hooks")
        while _unfinished(pointers):
            pointers = stored(_follow(pointers), "pointers")
        rounds.append(pointers)
        moved = _moved(_moved(left, "u", pointers), "v", pointers).where("u <> v")
        left = stored(
            moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
            "edges",
        )
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("root"), F.col("root").alias("__next"))
        earlier = rounds.pop().join(later, "root", "left").select(
            "node", F.coalesce("__next", "root").alias("root")
        )
        found = stored(earlier.union(found), "pointers")
    return found
