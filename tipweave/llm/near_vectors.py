"""Embedding near-dedup: navigable graphs per shard, every shard asked, links checked, components.

Vectors are only compared within a label. Equal ones are folded; the rest of a label is dealt into
shards of a bounded size by hash. A task builds the graph of a shard (`navigable`) and links its own
vectors; then every pair of shards of a label meets in a task, which looks up the nodes of each graph
in the other. In both, some nodes are compared with all others, and beams widen until enough of what
that finds is found by the graphs too (``RECALL``). All links count by the exact cosine, or by the
angles of balls that leave no doubt.

A task sends one row per vector that has links, with their number and one vector that stands for the
part it hangs together with: no pairs. Those meet in components (`graph`).

Defined cases: rows whose label is null, or whose vector is null, empty, zero or holds a null, NaN or
infinite component link with nothing and stand for themselves; so do vectors of another length than
all others of their label. Rows without an id count as links of others but name no component that has
an id. Repeated rows are linked with each other like equal vectors. An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipweave.llm.graph import components
from tipweave.llm.navigable import Graph, links_between, near_balls
from tipweave.llm.tables import stored

#: Numbers in the vectors of a shard, and vectors at most.
SHARD_NUMBERS, SHARD_ROWS = 1 << 22, 8192
WIDTH = 32
#: Nodes of a graph that are compared with all, and the share of their pairs the graphs must find.
AUDIT, RECALL = 256, 0.99
KEY = ["label", "size", "shard"]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least of each component of ``n`` things."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, k in pairs.tolist():
        i, k = top(i), top(k)
        root[max(i, k)] = min(i, k)
    return np.array([top(i) for i in range(n)], np.int64)


def _home(least: float):
    tight = float(np.cos(np.arccos(least) / 2 - 1e-6))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node", ignore_index=True)
        times = df["times"].to_numpy(np.int64)
        graph = Graph(_unit(df["v"])).build(tight)
        pairs, _ = near_balls(graph, graph, np.arccos(least), WIDTH, AUDIT, RECALL)
        (one, other), linked = links_between(graph, graph, pairs, least, (times, times))
        own = np.bincount(graph.ball, times, len(graph.lead)).astype(np.int64)[graph.ball] - times
        root = _roots(len(graph.lead), pairs[linked])[graph.ball]
        df["links"] = one + other + own
        df["root"] = df["node"].to_numpy()[graph.lead[root]]
        df["ball"] = graph.ball
        df["leads"] = graph.lead[graph.ball] == np.arange(len(df))
        df["level"] = graph.level[graph.ball]
        many = df["shards"].iloc[0] > 1
        df["near"] = [
            [[int(x) for x in level[b] if x >= 0] for level in graph.near[: h + 1]]
            if many and leads else []
            for b, leads, h in zip(graph.ball, df["leads"], df["level"], strict=True)
        ]
        if not many:
            df["v"] = None
        return df[[*KEY, "shards", "node", "times", "v", "links", "root", "ball", "leads", "level",
                   "near"]]

    return run


def _read(df: pd.DataFrame) -> tuple[Graph, pd.DataFrame]:
    """The graph again from its rows."""
    df = df.sort_values("node", ignore_index=True)
    graph = Graph(_unit(df["v"]))
    graph.ball = df["ball"].to_numpy(np.int64)
    at = np.flatnonzero(df["leads"])
    graph.lead = at[np.argsort(graph.ball[at])]
    graph.nodes = graph.vectors[graph.lead]
    graph.level = df["level"].to_numpy(np.int64)[graph.lead]
    near = df["near"].to_numpy()[graph.lead]
    for level in range(int(graph.level.max()) + 1):
        rows = [x[level] if len(x) > level else [] for x in near]
        out = np.full((len(rows), max(map(len, rows))), -1)
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        graph.near.append(out)
    angle = np.arccos(np.clip((graph.vectors * graph.nodes[graph.ball]).sum(1), -1, 1))
    graph.radius = np.zeros(len(graph.lead))
    np.maximum.at(graph.radius, graph.ball, angle)
    graph.radius[np.bincount(graph.ball) == 1] = 0.0
    return graph, df


def _across(least: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (a, left), (b, right) = _read(left), _read(right)
        weights = left["times"].to_numpy(np.int64), right["times"].to_numpy(np.int64)
        pairs, _ = near_balls(a, b, np.arccos(least), WIDTH, AUDIT, RECALL)
        counts, linked = links_between(a, b, pairs, least, weights)
        at = len(a.lead)
        root = _roots(at + len(b.lead), pairs[linked] + [0, at])
        leads = np.concatenate([left["node"].to_numpy()[a.lead], right["node"].to_numpy()[b.lead]])
        out = pd.DataFrame({
            "node": np.concatenate([left["node"], right["node"]]),
            "links": np.concatenate(counts),
            "root": leads[root][np.concatenate([a.ball, b.ball + at])],
        })
        return out[out["links"] > 0]

    return run


def linked(
    rows: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row: how many others are linked with it
    directly, and the least id that links lead to."""
    bad = F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    some = F.exists("v", lambda x: x != 0)
    plain = rows.select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"),
        F.monotonically_increasing_id().alias("at"),
    )
    part = F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & ~bad & some, F.lit(False))
    plain = stored(plain.withColumn("part", part), "vectors")
    nodes = plain.where("part").groupBy("label", "v").agg(
        F.min("at").alias("node"), F.count(F.lit(1)).alias("times"), F.min("id").alias("id")
    )
    nodes = stored(nodes.withColumn("size", F.size("v")), "nodes")
    sizes = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    most = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(1), F.floor(F.lit(SHARD_NUMBERS) / F.col("size"))))
    shards = stored(sizes.select("label", "size", F.ceil(F.col("n") / most).alias("shards")), "shards")
    dealt = nodes.join(shards, ["label", "size"]).select(
        "label", "size", F.pmod(F.xxhash64("node"), "shards").alias("shard"), "shards", "node",
        "times", "v",
    )
    types = dict(dealt.dtypes)
    graphs = stored(
        dealt.groupBy(*KEY).applyInPandas(
            _home(least),
            f"label {types['label']}, size int, shard bigint, shards bigint, node bigint, times bigint,"
            f" v {types['v']}, links bigint, root bigint, ball bigint, leads boolean, level bigint,"
            " near array<array<int>>",
        ),
        "graphs",
    )
    spread = graphs.where("shards > 1")
    pair = ["label", "size", "one", "other"]
    left = spread.where("shard < shards - 1").select(
        "*", F.col("shard").alias("one"),
        F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1)).alias("other"),
    )
    right = spread.where("shard > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shard") - 1)).alias("one"),
        F.col("shard").alias("other"),
    )
    across = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(
        _across(least), "node bigint, links bigint, root bigint"
    )
    found = graphs.select("node", "links", "root").where("links > 0")
    found = stored(found.unionByName(across), "links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = nodes.select("node", "label", "v", "times", "id").join(counts, "node", "left").join(
        roots, "node", "left"
    ).withColumn("root", F.coalesce("root", "node"))
    of_node = stored(of_node, "rooted")
    least_id = stored(of_node.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    facts = stored(
        of_node.join(least_id, "root").select("label", "v", "times", "links", "component_id"), "facts"
    )
    known = plain.where("part").select("id", "label", "v").join(facts, ["label", "v"]).select(
        "id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id"
    )
    apart = plain.where("NOT part").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return known.unionByName(apart).withColumnRenamed("id", key)
