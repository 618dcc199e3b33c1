"""Accuracy against ground truth: matching, outcomes, pair confusion by counting, flag results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.domains import CATEGORIES
from sievemark.functions.names import deletion_keys
from sievemark.functions.similarity import token_sort

#: Identifiers by which a predicted person is matched first, the best basis first (fixed values).
MATCH_TYPES = ("ssn", "financial_account", "passport", "drivers_license", "email", "phone")


def match_by_identifier(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``uid, person_id, basis`` of all that share an identifier ``(id_type, value)``; basis is the best shared type."""
    rank = F.array_position(F.array(*map(F.lit, MATCH_TYPES)), F.col("id_type"))
    return truth.join(predicted, ["id_type", "value"]).where(F.col("id_type").isin(*MATCH_TYPES)).groupBy("uid", "person_id").agg(F.min_by("id_type", rank).alias("basis"))


def outcomes(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """``uid, person_id, outcome``: split, wrongly_merged, matched, missed or hallucinated."""
    n_persons = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    n_uids = F.count(F.lit(1)).over(Window.partitionBy("person_id"))
    judged = matches.select("uid", "person_id").distinct().withColumns({"_p": n_persons, "_u": n_uids})
    judged = judged.select("uid", "person_id", F.when(F.col("_p") >= 2, "split").when(F.col("_u") >= 2, "wrongly_merged").otherwise("matched").alias("outcome"))
    missed = truth.select("uid").distinct().join(judged, "uid", "left_anti").select("uid", F.lit(None).cast(predicted.schema["person_id"].dataType).alias("person_id"), F.lit("missed").alias("outcome"))
    made_up = predicted.select("person_id").distinct().join(judged, "person_id", "left_anti").select(F.lit(None).cast(truth.schema["uid"].dataType).alias("uid"), "person_id", F.lit("hallucinated").alias("outcome"))
    return judged.unionByName(missed).unionByName(made_up)


def person_metrics(results: DataFrame, n_predicted: int, n_truth: int) -> DataFrame:
    """Precision (1 without predictions), recall and F1 over persons, to four places."""
    hits = results.agg(F.count_if(F.col("outcome") == "matched").alias("matched"))
    p = F.round(F.col("matched") / n_predicted, 4) if n_predicted else F.lit(1.0)
    r = F.round(F.col("matched") / n_truth, 4) if n_truth else F.lit(1.0)
    return hits.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), 4))


def pair_confusion(assigned: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Pairs that belong together by prediction, truth and both, from group sizes alone; never from pairs."""
    both = F.col("n") * (F.col("n") - 1) / 2
    cells = assigned.where(F.col(predicted).isNotNull() & F.col(truth).isNotNull()).groupBy(predicted, truth).agg(F.count(F.lit(1)).alias("n"))
    add = lambda df, name: df.agg(F.coalesce(F.sum(both), F.lit(0.0)).cast("long").alias(name))
    tp = add(cells, "tp")
    made = add(cells.groupBy(predicted).agg(F.sum("n").alias("n")), "made")
    real = add(cells.groupBy(truth).agg(F.sum("n").alias("n")), "real")
    one = tp.crossJoin(made).crossJoin(real)  # one row each
    return one.select("tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("real") - F.col("tp")).alias("fn")).withColumns({
        "precision": F.round(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0), 4),
        "recall": F.round(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0), 4),
    })


def fuzzy_candidates(truth: DataFrame, predicted: DataFrame, least: float = 0.72) -> DataFrame:
    """Leftover persons and identities with a name alike enough: ``uid, person_id, score``.

    Pairs are formed where a token of one name is one of the other's, or both are the same
    with one letter left out of either, never across the whole product. A date of birth
    that agrees adds 0.15, to 1 at most; one that differs takes 0.25, to 0 at least.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}]+")), lambda t: t != "")
    keyed = lambda df: df.withColumn("_w", F.explode(words)).withColumn("_t", F.explode(deletion_keys(F.col("_w"))))
    t = keyed(truth).select("_t", "uid", F.col("name").alias("a"), F.col("dob").alias("da")).distinct()
    p = keyed(predicted).select("_t", "person_id", F.col("name").alias("b"), F.col("dob").alias("db")).distinct()
    pairs = t.join(p, "_t").drop("_t").distinct()
    alike = token_sort("a", "b")
    score = F.when(F.col("da") == F.col("db"), F.least(F.lit(1.0), alike + 0.15)).when(F.col("da") != F.col("db"), F.greatest(F.lit(0.0), alike - 0.25)).otherwise(alike)
    return pairs.withColumn("score", score).groupBy("uid", "person_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)


def greedy_match(candidates: DataFrame) -> DataFrame:
    """One-to-one matches by falling score, then person, then uid.

    In each round every pair that is the best of both its sides is taken, which is what
    the greedy order takes, and all pairs that touch it leave; so no group is gathered,
    and every round but the last takes a pair.
    """
    from sievemark.session import materialize

    left, taken = materialize(candidates.select("uid", "person_id", "score"), "greedy"), None
    while True:
        order = [F.desc("score"), F.asc("person_id"), F.asc("uid")]
        top = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*order))  # noqa: B023, E731
        best = materialize(left.withColumns({"_a": top("uid"), "_b": top("person_id")}).where("_a = 1 and _b = 1").drop("_a", "_b"), "greedy-best")
        taken = best if taken is None else taken.unionByName(best)
        left = materialize(left.join(best.select("uid"), "uid", "left_anti").join(best.select("person_id"), "person_id", "left_anti"), "greedy")
        if left.isEmpty():
            break
    return taken


def flag_results(matched: DataFrame, expected: DataFrame, predicted: DataFrame, image_based: DataFrame) -> DataFrame:
    """Per matched person and category: tp, fp, fn or tn, and why it went wrong.

    ``matched (uid, person_id)``, ``expected (uid, category)``, ``predicted (person_id,
    category, trapped)``, ``image_based (uid, all_images)``.
    """
    spark = matched.sparkSession
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    grid = matched.crossJoin(F.broadcast(names))  # eleven rows
    grid = grid.join(expected.withColumn("expected", F.lit(True)), ["uid", "category"], "left").join(predicted.withColumn("predicted", F.lit(True)), ["person_id", "category"], "left").join(image_based, "uid", "left").fillna(False, ["expected", "predicted", "trapped", "all_images"])
    outcome = F.when(F.col("expected") & F.col("predicted"), "tp").when(F.col("predicted"), "fp").when(F.col("expected"), "fn").otherwise("tn")
    why = F.when(F.col("outcome") == "fn", F.when(F.col("all_images"), "ocr_failure").otherwise("missed_extraction")).when(F.col("outcome") == "fp", F.when(F.col("trapped"), "trap_fp").otherwise("wrong_category"))
    return grid.withColumn("outcome", outcome).withColumn("error_class", why).select("uid", "person_id", "category", "expected", "predicted", "outcome", "error_class")


def category_table(results: DataFrame) -> DataFrame:
    """Per category: counts of outcomes, precision and recall to four places, null where nothing was judged."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    t = results.groupBy("category").agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), n("tn").alias("tn"))
    return t.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4)})


def error_histogram(persons: DataFrame, flags: DataFrame, missed: DataFrame) -> DataFrame:
    """``error_class, n`` over a run: persons split, merged wrongly, missed or made up, and flags by why they went wrong.

    ``persons (uid, outcome)``, ``flags (error_class)``, ``missed (uid, error_class)`` with why a
    person was missed; unknown counts as missed_extraction.
    """
    why = persons.join(missed.select("uid", F.col("error_class").alias("_why")), "uid", "left")
    named = F.when(F.col("outcome") == "split", "er_split").when(F.col("outcome") == "wrongly_merged", "er_overmerge").when(F.col("outcome") == "missed", F.coalesce("_why", F.lit("missed_extraction"))).when(F.col("outcome") == "hallucinated", "hallucinated")
    both = why.select(named.alias("error_class")).unionByName(flags.select("error_class"))
    return both.where("error_class is not null").groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


def mention_truth(mentions: DataFrame, plantings: DataFrame) -> DataFrame:
    """The planted person whose values a mention shares most in its document; the first planted on ties, null without any.

    ``mentions (mention_id, doc, id_type, value)``, ``plantings (uid, doc, id_type, value, place)``.
    Repeated rows of either are one before they meet, so a mention meets a person once for each value.
    """
    place = ["doc", "id_type", "value"]
    planted = plantings.groupBy(*place, "uid").agg(F.min("place").alias("place"))
    held = mentions.select("mention_id", *place).distinct()
    shared = held.join(planted, place).groupBy("mention_id", "uid").agg(F.count_distinct("id_type", "value").alias("n"), F.min("place").alias("place"))
    best = shared.groupBy("mention_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "place", "uid")).alias("_b"))
    won = best.select("mention_id", "_b.uid")
    return mentions.select("mention_id").distinct().join(won, "mention_id", "left")


def trap_scorecard(evidence: DataFrame, traps: DataFrame) -> DataFrame:
    """Flags that rest on a planted trap value, by category: ``evidence (flag_id, doc, value, category)``, ``traps (doc, value)``."""
    leaked = evidence.join(traps.distinct(), ["doc", "value"], "left_semi")
    return leaked.groupBy("category").agg(F.count_distinct("flag_id").alias("flags"), F.count(F.lit(1)).alias("rows"))


def calibration(scored: DataFrame, truth: DataFrame, autos: tuple[float, ...] = (0.75, 0.80, 0.85, 0.90)) -> DataFrame:
    """Pair precision, recall and F1 of linking at each threshold: ``scored (left_id, right_id, score, hard_reason)``, ``truth (mention_id, uid)``.

    Recall counts the true pairs from group sizes, so no pair outside the candidates is formed.
    """
    spark = scored.sparkSession
    of = lambda s: truth.withColumnsRenamed({"mention_id": f"{s}_id", "uid": f"{s}_uid"})
    pairs = scored.join(of("left"), "left_id").join(of("right"), "right_id").withColumn("same", F.col("left_uid") == F.col("right_uid"))
    real = truth.where("uid is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("real"))
    levels = F.broadcast(spark.createDataFrame([(a,) for a in autos], "auto double"))  # the thresholds
    out = pairs.crossJoin(levels).groupBy("auto").agg(
        F.count_if((F.col("score") >= F.col("auto")) & F.col("hard_reason").isNull()).alias("linked"),
        F.count_if((F.col("score") >= F.col("auto")) & F.col("hard_reason").isNull() & F.col("same")).alias("right"),
    ).crossJoin(F.broadcast(real))
    out = out.withColumns({"precision": F.round(F.when(F.col("linked") > 0, F.col("right") / F.col("linked")).otherwise(1.0), 4), "recall": F.round(F.when(F.col("real") > 0, F.col("right") / F.col("real")).otherwise(1.0), 4)})
    return out.withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0), 4))
