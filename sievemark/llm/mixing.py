"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import WORD
from sievemark.session import materialize, width

#: Weights of the sources in the order of their names' code points, repeating; null comes last.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets of all sources: ``(source, source_size, target)`` from rows ``(source, size)``.

    The budget, ``share`` times all sizes, goes out by weight; a source stops at
    ``repeats`` times its size, and what it leaves is shared by weight among the rest
    until none is above. Sources in the order of their caps per unit of weight fill up
    one after the other; the first that does not fill fixes the common level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    factors = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", factors).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "rows", "weight", "cap",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("cap").over(filled), F.lit(0.0)).alias("given"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("open"),
    ).withColumn("level", (F.col("budget") - F.col("given")) / F.col("open"))
    level = F.max("level").over(whole)  # rises while sources fill, falls after the first that does not
    return per.select("source", "source_size", "rows", F.least("cap", level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, seed: int = 17, carry: str | None = None) -> DataFrame:
    """Take documents, repeats included, so that sources come near their targets.

    A document's size is its number of words (runs of characters other than U+0020 and
    U+0009-U+000D; a null text has none). In each source the documents stand in a
    shuffled order fixed by ``seed``, ``repeats`` times over. A copy's virtual finish
    time is the source's sizes up to and with it, over the source's target. All copies
    in the order of finish times are taken until the budget, ``share`` times all sizes,
    is spent; the copy at which it ends is taken in part.

    Returns one row per input row: ``id_col, size, source_size, target, taken``, and
    ``copies``, how many times the document is begun; a column of ``docs`` named by
    ``carry`` comes with them and has no say. A null source is a source of its own, the
    last; an empty source's target is 0. Repeated rows count each; rows alike in id, source
    and size share what falls to them in any order. An empty table gives an empty result.

    Sums run in two levels, over buckets of the shuffled order and of finish times, so
    that neither a large source nor the whole order meets in one task.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *([F.col(carry).alias("carried")] if carry else []),
        ).withColumn("nth", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    targets = materialize(source_targets(rows, weights, share, repeats).withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-targets")
    buckets = 16 * width(spark)

    shuffled = rows.withColumn("key", F.xxhash64("id", "source", "size", F.lit(seed))).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    placed = shuffled.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "rows")
    sums = placed.groupBy("place", "bucket").agg(F.sum("size").alias("sum"))
    up = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("place", "bucket", F.coalesce(F.sum("sum").over(up), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "bucket").orderBy("key", "id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)
    queued = placed.withColumn("within", F.sum("size").over(inside)).join(bases, ["place", "bucket"])
    copies = materialize(
        queued.where("size > 0 and target > 0")
        .select("id", "nth", "place", "size", "key", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"), "source_size", "target", "base", "within")
        .select("id", "nth", "place", "size", "key", "round", ((F.col("round") * F.col("source_size") + F.col("base") + F.col("within")) / F.col("target")).alias("finish")),
        "mix-copies",
    )

    fine = F.floor(F.col("finish") * buckets)
    spans = copies.groupBy(fine.alias("span")).agg(F.sum("size").alias("sum"))
    over = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    budget = rows.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) * F.lit(share)).alias("budget"))
    ahead = spans.select("span", "sum", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("ahead")).crossJoin(F.broadcast(budget)).where("ahead < budget")
    begun = copies.withColumn("span", fine).join(ahead, "span")
    order = Window.partitionBy("span").orderBy("finish", "place", "key", "id", "nth", "round").rowsBetween(Window.unboundedPreceding, 0)
    cut = begun.where("ahead + sum > budget").withColumn("sofar", F.col("ahead") + F.sum("size").over(order))
    taken = begun.where("ahead + sum <= budget").select("nth", F.col("size").alias("take")).unionByName(
        cut.select("nth", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("sofar") + F.col("size"))).alias("take"))
    )
    per = taken.where("take > 0").groupBy("nth").agg(F.sum("take").alias("taken"), F.count(F.lit(1)).alias("copies"))
    return (
        rows.join(targets.withColumnRenamed("source", "s").drop("rows", "place"), F.col("source").eqNullSafe(F.col("s")))
        .join(per, "nth", "left")
        .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), *([F.col("carried").alias(carry)] if carry else []))
    )
