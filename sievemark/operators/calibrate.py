"""Calibration of the linking thresholds: the clusters of every threshold from one forest, judged by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators.components import connected_components
from sievemark.operators.constrained import HELD_LINKS, merge_forest
from sievemark.session import Scratch

#: Thresholds that are tried, and those in force (fixed values).
AUTOS, DISTINCTS = (0.75, 0.80, 0.85, 0.90), (0.35, 0.40, 0.45, 0.50)
IN_FORCE = (0.85, 0.40)


def _levels(df: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def clusters_by_threshold(mentions: DataFrame, scored: DataFrame, autos: tuple[float, ...] = AUTOS, held: int = HELD_LINKS) -> DataFrame:
    """``(auto, mention_id, cluster_id)``: the clusters of each threshold, from one forest over the links of the lowest.

    Equal to clustering anew at each threshold: a pass by falling score that stops there
    has taken just the forest's links at or above it. All thresholds are labelled
    together, as components of ``(auto, mention)``. Mentions without links are clusters of their own.
    Where no pair is in conflict, no link is refused, so the links stand for their forest.
    """
    usable = scored.where((F.col("score") >= min(autos)) & F.col("hard_reason").isNull())
    foes = scored.where("hard_reason = 'hard_conflict'")
    forest = usable if foes.isEmpty() else merge_forest(usable, foes, held)
    at = lambda c: F.struct("auto", F.col(c).alias("id"))
    kept = _levels(forest, "auto", autos).where("score >= auto").select(at("left_id").alias("l"), at("right_id").alias("r"))
    label = connected_components(kept, "l", "r").select("node.auto", F.col("node.id").alias("mention_id"), F.col("component.id").alias("cluster_id"))
    every = _levels(mentions.select("mention_id"), "auto", autos)
    return every.join(label, ["auto", "mention_id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", "mention_id"))


def _pairs(n: str) -> Column:
    return F.coalesce(F.sum(F.expr(f"{n} * ({n} - 1) div 2")), F.lit(0))


def _share(part: str, whole: str) -> Column:
    return F.round(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(1.0), 4)


def threshold_sweep(
    scored: DataFrame, truth: DataFrame, scripted: DataFrame | None = None, nicknamed: DataFrame | None = None,
    autos: tuple[float, ...] = AUTOS, distincts: tuple[float, ...] = DISTINCTS, held: int = HELD_LINKS,
) -> tuple[DataFrame, DataFrame]:
    """How clusters at each threshold agree with the truth, and what the gray band of each pair of thresholds holds.

    ``scored (left_id, right_id, score, hard_reason)``, ``truth (mention_id, uid)``, a mention once; ``scripted (uid_a,
    uid_b)`` are different persons of one name, ``nicknamed (uid)`` persons known by nicknames.
    First table, per ``auto``: pairs within clusters (``linked``), those of one person
    (``right``), all such pairs (``real``), precision, recall, f1, ``leaks`` (scripted pairs
    that meet in a cluster) and ``nickname_recall``. Second, per ``auto`` and ``distinct``:
    pairs scored between them across clusters (``gray``), those of one person
    (``true_gray``), pairs of one person that neither links nor queue reach (``lost``) and
    ``ceiling``, the recall that reviewing the queue could give. Pairs within clusters and
    persons are counted from group sizes, never formed. Mentions of unknown persons
    (null uid) count in ``linked`` alone; shares of nothing are 1; empty tables give counts of 0.
    """
    spark, scratch = scored.sparkSession, Scratch(scored.sparkSession)
    scored = scratch.keep(scored.select("left_id", "right_id", F.col("score").cast("double").alias("score"), "hard_reason"), "sweep-scored")
    who = scratch.keep(truth.select("mention_id", "uid"), "sweep-truth")
    placed = scratch.keep(clusters_by_threshold(who, scored, autos, held).join(who, "mention_id"), "sweep-clusters")
    levels = spark.createDataFrame([(a,) for a in autos], "auto double")
    count = F.count(F.lit(1)).alias("n")

    def share_pairs(rows: DataFrame, linked: str, right: str) -> DataFrame:
        by_person = rows.where("uid is not null").groupBy("auto", "cluster_id", "uid").agg(count).groupBy("auto").agg(_pairs("n").alias(right))
        by_cluster = rows.groupBy("auto", "cluster_id").agg(count).groupBy("auto").agg(_pairs("n").alias(linked))
        return by_cluster.join(by_person, "auto", "full")

    known = who.where("uid is not null")
    real = lambda rows, name: rows.groupBy("uid").agg(count).agg(_pairs("n").alias(name))
    out = levels.join(share_pairs(placed, "linked", "right"), "auto", "left").crossJoin(F.broadcast(real(known, "real")))  # one row
    if nicknamed is None:
        nicknamed = known.select("uid").limit(0)
    by_nick = placed.join(nicknamed.select("uid").distinct(), "uid", "left_semi")
    out = out.join(share_pairs(by_nick, "_l", "_nick").drop("_l"), "auto", "left").crossJoin(F.broadcast(real(known.join(nicknamed.select("uid").distinct(), "uid", "left_semi"), "_nicks")))
    if scripted is None:
        scripted = known.select(F.col("uid").alias("uid_a"), F.col("uid").alias("uid_b")).limit(0)
    present = placed.where("uid is not null").select("auto", "cluster_id", "uid").distinct()
    one, two = (present.withColumnRenamed("uid", f"uid_{s}") for s in "ab")
    leaks = scripted.join(one, "uid_a").join(two, ["auto", "cluster_id", "uid_b"]).groupBy("auto").agg(F.count_distinct("uid_a", "uid_b").alias("leaks"))
    out = out.join(leaks, "auto", "left").fillna(0, ["linked", "right", "leaks", "_nick"])
    out = out.withColumns({"precision": _share("right", "linked"), "recall": _share("right", "real"), "nickname_recall": _share("_nick", "_nicks")})
    p, r = F.col("right") / F.nullif(F.col("linked"), F.lit(0)), F.col("right") / F.nullif(F.col("real"), F.lit(0))
    p, r = F.coalesce(p, F.lit(1.0)), F.coalesce(r, F.lit(1.0))
    out = out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4))
    sweep = scratch.keep(out.select("auto", "linked", "right", "real", "precision", "recall", "f1", "leaks", "nickname_recall"), "sweep")

    of = lambda s: placed.select("auto", F.col("mention_id").alias(f"{s}_id"), F.col("cluster_id").alias(f"{s}_c"), F.col("uid").alias(f"{s}_u"))
    below = _levels(scored.where(F.col("score") > min(distincts)), "auto", autos).where("score < auto")
    apart = below.join(of("left"), ["auto", "left_id"]).join(of("right"), ["auto", "right_id"]).where("left_c <> right_c")
    gray = _levels(apart, "distinct", distincts).where("score > distinct").groupBy("auto", "distinct").agg(F.count(F.lit(1)).alias("gray"), F.count_if(F.col("left_u") == F.col("right_u")).alias("true_gray"))
    grid = sweep.select("auto", "right", "real").withColumn("distinct", F.explode(F.array(*map(F.lit, distincts)))).join(gray, ["auto", "distinct"], "left").fillna(0, ["gray", "true_gray"])
    lost = F.col("real") - F.col("right") - F.col("true_gray")
    return sweep, grid.withColumn("_r", F.col("right") + F.col("true_gray")).select("auto", "distinct", "gray", "true_gray", lost.alias("lost"), _share("_r", "real").alias("ceiling"))


def recommended(sweep: DataFrame, gray: DataFrame, in_force: tuple[float, float] = IN_FORCE) -> DataFrame:
    """One row ``(auto, distinct, f1, gray, differs)``: the thresholds to take, no row where every one leaks.

    ``auto``: the best f1 without a leak; ``distinct``: of those that lose no more than the lowest, the
    one with the smallest queue. Ties go to the value in force, then to the higher.
    """
    auto, distinct = in_force
    best = sweep.where("leaks = 0").agg(F.max(F.struct("f1", F.col("auto") == auto, "auto")).alias("b")).where("b is not null").select("b.auto", "b.f1")
    of = gray.join(F.broadcast(best), "auto")  # one row
    least = of.agg(F.min_by("lost", "distinct").alias("floor"))
    found = of.crossJoin(F.broadcast(least)).where("lost = floor").agg(F.max(F.struct((-F.col("gray")).alias("less"), F.col("distinct") == distinct, "distinct", "auto", "f1")).alias("b")).where("b is not null")
    return found.select("b.auto", "b.distinct", "b.f1", (-F.col("b.less")).alias("gray"), ((F.col("b.auto") != auto) | (F.col("b.distinct") != distinct)).alias("differs"))
