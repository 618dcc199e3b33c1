"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import Scratch

#: Nodes that a task holds at most while it drops edges; then it begins anew.
HELD_NODES = 1_000_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's edges ``u, v``, those that join what edges before them have not joined."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = up = root[up]
            x = up
        return x

    for edges in batches:
        if len(root) > HELD_NODES:
            root.clear()
        at, nodes = pd.factorize(pd.concat([edges["u"], edges["v"]], ignore_index=True))
        group = pd.factorize(np.array([find(x) for x in nodes.tolist()], object))[0]
        far = np.flatnonzero(group[at[: len(edges)]] != group[at[len(edges) :]])
        kept = []
        for k, u, v in zip(far.tolist(), edges["u"].to_numpy()[far].tolist(), edges["v"].to_numpy()[far].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[u] = v
                kept.append(k)
        yield edges.iloc[kept]


def spanning_edges(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` with the same components, each task's a forest but where it begins anew; nodes are strings or whole numbers, else all edges stay."""
    if edges.schema["u"].dataType.simpleString() not in ("string", "bigint", "int"):
        return edges
    return edges.mapInPandas(_forest, edges.schema)


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """Label each node of an undirected edge list with the smallest node of its component.

    Returns ``(node, component)`` for nodes with at least one edge to another node.
    Null endpoints and self-loops are ignored; repeated edges count once; an empty
    edge list gives an empty result. Each task first drops the edges that join nothing new to those before
    them, so a dense graph is no more than a forest per task when it is first shuffled. Every round is one minimum per node and one
    join, written to the shared folder, so no component is ever held by one task. The
    minima of a round are written before they are joined, so that the join meets two
    plain shuffles and Spark can split the edges of a node with very many.
    """
    scratch = Scratch(edges.sparkSession)
    proper = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    pairs = scratch.keep(spanning_edges(proper.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct(), "cc-pairs")
    seen = None
    while True:
        # large star: hang every larger neighbour of u on the least node near u
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: hang u and its smaller neighbours on the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        pairs = scratch.keep(small, "cc-pairs")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    scratch.drop("cc-least")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
