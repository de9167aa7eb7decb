"""Connected components: hook every node to its least neighbour, follow, contract.

The least neighbour is an aggregate that combines before the shuffle; the neighbours of a hub are
never gathered. Hooks lead to smaller nodes only, so they form trees; following them takes twice as
long steps each time. Then edges move to where their ends lead, and those within one node go. Every
node but the least of its surroundings vanishes in a round, so real graphs take a few rounds.

Hooks and edges are kept as tables before they are joined: no aggregate stands between a shuffle and
its join, so Spark can split a hub that holds a large share of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.runtime import durable, durable_counted

MAX_ROUNDS = 60


def _ordered(edges: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return edges.filter("u <> v").select(low.alias("u"), high.alias("v")).distinct()


def _led(pointers: DataFrame, by: DataFrame) -> DataFrame:
    """The pointers led on from where they point to."""
    onward = by.select(F.col("node").alias("to"), F.col("to").alias("_next"))
    return pointers.join(onward, "to", "left").select(
        "node", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_open")
    )


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers to the ends of their trees, four steps to a table until none leads on."""
    while True:
        twice = _led(pointers, pointers).select("node", "to")
        pointers, unfinished = durable_counted(_led(twice, twice), F.col("_open"))
        pointers = pointers.select("node", "to")
        if not unfinished:
            return pointers


def _moved(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        at = pointers.select(F.col("node").alias(end), F.col("to").alias("_at"))
        edges = edges.join(at, end, "left").withColumn(end, F.coalesce("_at", end)).drop("_at")
    return edges


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of the edge list; a component is named by its
    smallest node. Nodes without an edge are not listed."""
    left, open_ = durable_counted(_ordered(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))))
    rounds: list[DataFrame] = []
    while open_:
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        hooks = left.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        rounds.append(_followed(durable(hooks)))
        left, open_ = durable_counted(_ordered(_moved(left, rounds[-1])))
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # Where a round ends, later rounds go on; a node vanishes in one round only.
    found = rounds.pop()
    while rounds:
        earlier = rounds.pop()
        found = durable(_led(earlier, found).select("node", "to").unionByName(found))
    members = found.select("node", F.col("to").alias("component"))
    roots = found.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct()
    return members.unionByName(roots)
