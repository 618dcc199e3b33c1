"""Clusters along links of falling score, none of which may hold two enemies.

The clusters are those of one sequential pass: best link first, a link refused where it
would join enemies. The links that this pass takes make a forest, and joins find most of
them in any order, since what the pass will do with many links is sure beforehand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators.components import connected_components
from sievemark.session import Scratch

#: Links of a component up to which one task passes over them; larger ones are worked by joins until they are not larger.
HELD_LINKS = 1_000_000


def _pass(edges: pd.DataFrame) -> pd.DataFrame:
    """The links taken in one component, foes being marked rows; enemies of clusters are merged from the smaller side."""
    at, nodes = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    left, right, enemy = at[: len(edges)], at[len(edges) :], edges["enemy"].to_numpy()
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    foes: dict = {}
    for a, b in zip(left[enemy].tolist(), right[enemy].tolist(), strict=True):
        foes.setdefault(a, set()).add(b)
        foes.setdefault(b, set()).add(a)
    order = edges.loc[~enemy, ["score", "left_id", "right_id"]].reset_index(drop=True).sort_values(["score", "left_id", "right_id"], ascending=[False, True, True]).index.to_numpy()
    links = np.flatnonzero(~enemy)[order]
    taken = []
    for k, a, b in zip(links.tolist(), left[links].tolist(), right[links].tolist(), strict=True):
        a, b = find(a), find(b)
        if a == b or b in foes.get(a, ()):
            continue
        taken.append(k)
        if len(foes.get(a, ())) > len(foes.get(b, ())):
            a, b = b, a
        root[a] = b
        for foe in foes.pop(a, ()):
            foes[foe].discard(a)
            foes[foe].add(b)
            foes.setdefault(b, set()).add(foe)
    return edges.iloc[taken][["left_id", "right_id", "score"]]


def _relabel(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """``a`` and ``b`` of ``rows`` led to the clusters they are now in, by ``moves (node, component)``."""
    for side in ("a", "b"):
        rows = rows.join(moves.withColumnsRenamed({"node": side, "component": "_goal"}), side, "left").withColumn(side, F.coalesce("_goal", side)).drop("_goal")
    return rows


def merge_forest(links: DataFrame, foes: DataFrame, held: int = HELD_LINKS) -> DataFrame:
    """The links ``(left_id, right_id, score)`` that one pass by falling score, then ``left_id``, then ``right_id`` takes.

    A link is refused that joins two clusters between which ``foes (left_id, right_id)`` has
    a pair. The links taken at or above any score are the forest of a pass over the
    links at or above it, so one forest holds the clusters of every threshold. A component of
    at most ``held`` links is passed over in a task, and so are all together if they have no more. In a larger one, rounds of joins take
    the links that the pass is sure to take: the first link of both its ends, and the
    first link of an end that has no foe it could meet by then, that is, none in its
    component of the links at or above some score below that link's. What they join is contracted, links
    between foes go, and at least the first link of a component is settled in each round.
    Null ends and self-loops are ignored, repeated links count by their first; no links, no rows.
    """
    scratch = Scratch(links.sparkSession)
    keep = lambda name, df: scratch.keep(df, f"forest-{name}")
    proper = lambda df: df.where("left_id <> right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), *[c for c in ("left_id", "right_id", "score") if "score" in df.columns])
    edges = proper(links.select("left_id", "right_id", F.col("score").cast("double").alias("score")))
    enemies = keep("enemies", proper(foes.select("left_id", "right_id")).distinct())
    ids = links.schema["left_id"].dataType.simpleString()
    taken, depth = [], 0

    def passed(edges: DataFrame, enemies: DataFrame) -> DataFrame:
        rows = edges.select("c", "a", "b", (-F.col("o.s")).alias("score"), "o.left_id", "o.right_id", F.lit(False).alias("enemy"))
        rows = rows.unionByName(enemies.withColumn("enemy", F.lit(True)), allowMissingColumns=True)
        return scratch.keep(rows.groupBy("c").applyInPandas(_pass, f"left_id {ids}, right_id {ids}, score double"), f"forest-taken-{len(taken)}")

    while True:
        # links between foes are refused; of parallel links the first stands for all
        either = enemies.select("a", "b").union(enemies.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct((-F.col("score")).alias("s"), "left_id", "right_id")
        edges = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(order).alias("o")).join(either, ["a", "b"], "left_anti")
        edges = keep("edges", edges)
        n = edges.count()
        if n <= held:  # all that is left is one task's work
            taken.append(passed(edges.withColumn("c", F.lit(0)), enemies.select(F.lit(0).alias("c"), "a", "b")))
            break
        if depth % 4 == 0:  # contraction keeps components, refusals only split them, so older labels are true, if coarse
            group = keep("groups", connected_components(edges, "a", "b"))
        of = lambda labels, side, name: labels.withColumnsRenamed({"node": side, "component": name})
        inside = lambda labels: enemies.select("a", "b").join(of(labels, "a", "c"), "a").join(of(labels, "b", "d"), "b").where("c = d").select("c", "a", "b")
        enemies, edges = keep("enemies", inside(group)), keep("edges", edges.join(of(group, "a", "c"), "a"))
        small = keep("small", edges.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= held).select("c"))
        taken.append(passed(edges.join(small, "c", "left_semi"), enemies.join(small, "c", "left_semi")))
        edges, enemies = keep("edges", edges.join(small, "c", "left_anti")), keep("enemies", enemies.join(small, "c", "left_anti"))
        if edges.isEmpty():
            break
        both = edges.select("c", F.col("a").alias("end"), F.col("b").alias("other"), "o").unionByName(edges.select("c", F.col("b").alias("end"), F.col("a").alias("other"), "o"))
        first = keep("first", both.groupBy("c", "end").agg(F.min(F.struct("o", "other")).alias("m")).select("c", "end", "m.o", "m.other"))
        mutual = first.select(F.col("end").alias("other"), F.col("other").alias("end"), F.lit(True).alias("mutual"))
        bars = keep("bars", edges.groupBy("c").agg(F.percentile_approx(-F.col("o.s"), 1 - 0.5 ** (depth % 5 + 1)).alias("bar")))  # another score each round
        high = edges.join(bars, "c").where(-F.col("o.s") >= F.col("bar"))
        upper = keep("upper", connected_components(high, "a", "b")) if depth % 2 else group
        met = lambda pairs, name: pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct().withColumn(name, F.lit(True))
        known = first.join(mutual, ["end", "other"], "left").join(met(enemies, "hated"), "end", "left").join(met(inside(upper), "met"), "end", "left").join(bars, "c")
        sure = keep("sure", known.where(F.col("mutual") | F.col("hated").isNull() | ((-F.col("o.s") >= F.col("bar")) & F.col("met").isNull())).select("end", "other", "o"))
        taken.append(scratch.keep(sure.select("o.left_id", "o.right_id", (-F.col("o.s")).alias("score")).distinct(), f"forest-taken-{len(taken)}"))
        moves = keep("moves", connected_components(sure, "end", "other"))
        group = keep("groups", group.join(moves.withColumnRenamed("component", "goal"), "node", "left").select(F.coalesce("goal", "node").alias("node"), "component").distinct())
        edges = _relabel(edges.select("a", "b", (-F.col("o.s")).alias("score"), "o.left_id", "o.right_id"), moves).where("a <> b")
        enemies, depth = keep("enemies", _relabel(enemies.select("a", "b"), moves).distinct()), depth + 1
    every = taken[0]
    for more in taken[1:]:
        every = every.unionByName(more)
    return every


def _labelled(edges: pd.DataFrame) -> pd.DataFrame:
    """The ends of the links of one component, each with the least node of its cluster."""
    taken, root = _pass(edges.assign(a=edges["left_id"], b=edges["right_id"])), {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(taken["left_id"].tolist(), taken["right_id"].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = edges.loc[~edges["enemy"].to_numpy()]
    nodes = pd.unique(pd.concat([links["left_id"], links["right_id"]], ignore_index=True)).tolist()
    return pd.DataFrame({"node": nodes, "part": [find(x) for x in nodes]})


def _parted(rows: DataFrame) -> DataFrame:
    """``node, part``: the clusters within each component ``c``, a task's work each: ``c, left_id, right_id, score, enemy``."""
    ids = rows.schema["left_id"].dataType.simpleString()
    return rows.groupBy("c").applyInPandas(_labelled, f"node {ids}, part {ids}")


def constrained_components(links: DataFrame, foes: DataFrame, held: int = HELD_LINKS, label: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for each end of ``links (left_id, right_id, score)``: the clusters of ``merge_forest``, each named by its least node.

    A component of links without a foe inside is a cluster as it is; only the others need their forest.
    Of these, those of at most ``held`` links go to their tasks straight away, so links are shuffled to their component and
    no more. Both tables are read several times, so they should be written ones. ``label`` is that of ``connected_components`` over
    the links, where it is known.
    """
    scratch = Scratch(links.sparkSession)
    links = links.select("left_id", "right_id", F.col("score").cast("double").alias("score")).where("left_id <> right_id")
    if label is None and links.count() <= held:
        parts = connected_components(merge_forest(links, foes, held), "left_id", "right_id")
        nodes = links.select(F.explode(F.array("left_id", "right_id")).alias("node")).distinct()
        return nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if label is None:
        label = scratch.keep(connected_components(links, "left_id", "right_id"), "constrained-label")
    of = lambda side, name: label.withColumnsRenamed({"node": side, "component": name}).hint("shuffle_hash")
    inner = foes.select("left_id", "right_id").where("left_id <> right_id").join(of("left_id", "c"), "left_id").join(of("right_id", "d"), "right_id").where("c = d")
    inner = scratch.keep(inner.select("c", "left_id", "right_id"), "constrained-foes")
    degree = links.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = degree.join(of("left_id", "c"), "left_id").groupBy("c").agg(F.sum("n").alias("n"))
    torn = scratch.keep(sizes.join(inner.groupBy("c").agg(F.count(F.lit(1)).alias("foes")), "c").select("c", (F.col("n") + F.col("foes") <= held).alias("small")), "constrained-torn")
    placed = of("left_id", "c").join(torn, "c")
    small, large = placed.where("small"), placed.where("not small")
    within = lambda df: links.join(df.select("left_id", "c").hint("shuffle_hash"), "left_id")
    rows = within(small).select("c", "left_id", "right_id", "score", F.lit(False).alias("enemy"))
    rows = rows.unionByName(inner.join(torn.where("small"), "c", "left_semi").withColumn("enemy", F.lit(True)), allowMissingColumns=True)
    parts = _parted(rows)
    if not torn.where("not small").isEmpty():
        forest = merge_forest(within(large), inner.join(torn.where("not small"), "c", "left_semi"), held)
        parts = parts.unionByName(connected_components(scratch.keep(forest, "constrained-forest"), "left_id", "right_id").withColumnRenamed("component", "part"))
    parts = scratch.keep(parts, "constrained-parts")
    marked = label.join(torn.select(F.col("c").alias("component"), F.lit(True).alias("torn")), "component", "left").join(parts.hint("shuffle_hash"), "node", "left")
    return marked.select("node", F.when(F.col("torn"), F.coalesce("part", "node")).otherwise(F.col("component")).alias("component"))
