"""Decisions by people and agents over an append-only ledger, and what follows from them.

Tables are derived: a decision adds rows, none is overwritten, and a rerun gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.domains import VALID
from sievemark.operators.components import connected_components
from sievemark.session import Scratch

#: Links of merged persons above which a merge asks for approval (fixed value).
BULK_LINKS = 10


def latest(decisions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last decision per key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return decisions.withColumn("_r", last).where("_r = 1").drop("_r")


def survivors(merges: DataFrame) -> DataFrame:
    """``absorbed, survivor`` for each person that merges lead into another one.

    Merges are edges: all persons that they connect are one. That one is the person of
    them who is never absorbed, the least of several (``doubly_absorbed`` names what made
    them several), and the least of all where merges run in a circle. Repeated merges count once; merges
    of a person into itself, or with a null end, count for nothing.
    """
    scratch = Scratch(merges.sparkSession)
    merges = scratch.keep(merges.select("absorbed", "survivor").where("absorbed <> survivor").distinct(), "merges")
    label = scratch.keep(connected_components(merges, "absorbed", "survivor"), "merge-groups")
    kept = merges.select(F.col("survivor").alias("node")).distinct().join(merges.select(F.col("absorbed").alias("node")), "node", "left_anti")
    goals = label.join(kept.withColumn("kept", F.lit(True)), "node", "left").groupBy("component").agg(F.min(F.when(F.col("kept"), F.col("node"))).alias("least"))
    goal = F.coalesce("least", "component")  # a component is named by its least node
    return label.join(goals, "component").select(F.col("node").alias("absorbed"), goal.alias("survivor")).where("absorbed <> survivor")


def doubly_absorbed(merges: DataFrame) -> DataFrame:
    """Persons that merges lead into more than one other, with these: ``absorbed, into``."""
    own = merges.where("absorbed <> survivor").groupBy("absorbed").agg(F.array_sort(F.collect_set("survivor")).alias("into"))
    return own.where("size(into) > 1")


def merge_persons(links: DataFrame, merges: DataFrame) -> DataFrame:
    """The ledger after merges: links of absorbed persons turn inactive, and each gets a new link to the survivor."""
    to = survivors(merges)
    moved = links.where("active").join(to.withColumnRenamed("absorbed", "person_id"), "person_id")
    kept = links.join(to.select(F.col("absorbed").alias("person_id"), F.lit(True).alias("gone")), "person_id", "left")
    old = kept.withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")
    new = moved.select(F.col("survivor").alias("person_id"), *[F.lit("reviewer").alias(c) if c == "method" else F.col(c) for c in links.columns if c != "person_id"])
    return old.select(links.columns).unionByName(new.select(links.columns))


def split_mentions(links: DataFrame, splits: DataFrame) -> DataFrame:
    """The ledger after splits: the mention's active link turns inactive, and a new person holds it alone."""
    out = links.join(splits.select("mention_id", F.lit(True).alias("out")).distinct(), "mention_id", "left")
    gone = F.col("active") & F.col("out").isNotNull()
    kind = links.schema["person_id"].dataType
    fresh = F.concat(F.lit("split-"), F.col("mention_id").cast("string")) if kind.simpleString() == "string" else (-F.col("mention_id") - 1).cast(kind)
    old = out.withColumn("active", F.col("active") & F.col("out").isNull()).select(links.columns)
    new = out.where(gone).withColumns({"person_id": fresh, "method": F.lit("reviewer")}).select(links.columns)
    return old.unionByName(new)


def needs_approval(links: DataFrame, merges: DataFrame, bound: int = BULK_LINKS) -> DataFrame:
    """Merges whose two persons hold more than ``bound`` active links together."""
    held = links.where("active").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: held.withColumnsRenamed({"person_id": c, "n": f"n_{c}"})
    both = merges.join(side("survivor"), "survivor", "left").join(side("absorbed"), "absorbed", "left").fillna(0, ["n_survivor", "n_absorbed"])
    return both.where(F.col("n_survivor") + F.col("n_absorbed") > bound)


def person_counters(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions and distinct documents of each person by its active links."""
    return links.where("active").join(mentions.select("mention_id", "doc_id"), "mention_id").groupBy("person_id").agg(F.count(F.lit(1)).alias("mention_count"), F.count_distinct("doc_id").alias("document_count"))


def doubly_linked(links: DataFrame) -> DataFrame:
    """Mentions with more than one active link; must be empty."""
    return links.where("active").groupBy("mention_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def close_superseded(items: DataFrame, links: DataFrame, scored: DataFrame) -> DataFrame:
    """Pair items in either order of their mentions: dismissed if one person holds both by now, or the pair conflicts."""
    pair = lambda df: df.withColumns({"lo": F.least("left_id", "right_id"), "hi": F.greatest("left_id", "right_id")})
    own = lambda s: links.where("active").select(F.col("mention_id").alias(f"{s}_id"), F.col("person_id").alias(f"{s}_person"))
    conflicts = pair(scored.where("hard_reason = 'hard_conflict'")).select("lo", "hi", F.lit(True).alias("conflict")).distinct()
    now = pair(items).join(own("left"), "left_id", "left").join(own("right"), "right_id", "left").join(conflicts, ["lo", "hi"], "left")
    moot = F.coalesce(F.col("left_person") == F.col("right_person"), F.lit(False)) | F.col("conflict").isNotNull()
    return now.withColumn("status", F.when((F.col("status") == "open") & moot, "dismissed").otherwise(F.col("status"))).select(items.columns)


def decide_elements(elements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Elements after their last decision: correct sets the value and valid, attach the person, dismiss a trap.

    ``decisions (element_id, verb, value, person_id, seq)``.
    """
    last = latest(decisions, ["element_id"], ["seq"]).select("element_id", "verb", F.col("value").alias("_v"), F.col("person_id").alias("_p"))
    out = elements.join(last, "element_id", "left")
    return out.withColumns({
        "value_normalized": F.when(F.col("verb") == "correct", F.col("_v")).otherwise(F.col("value_normalized")),
        "validation_status": F.when(F.col("verb") == "correct", VALID).otherwise(F.col("validation_status")),
        "detector": F.when(F.col("verb") == "correct", "reviewer").otherwise(F.col("detector")),
        "person_id": F.when(F.col("verb") == "attach", F.col("_p")).otherwise(F.col("person_id")),
        "trap_reason": F.when(F.col("verb") == "dismiss", "reviewer_dismissed").otherwise(F.col("trap_reason")),
    }).select(elements.columns)


def verified_quotes(quotes: DataFrame, evidence: DataFrame, passages: DataFrame) -> DataFrame:
    """Whether each flag's quote stands word for word in a passage of its evidence."""
    held = quotes.join(evidence.select("flag_id", "passage_id"), "flag_id").join(passages.select("passage_id", "text"), "passage_id")
    found = held.where(F.contains("text", "quote")).select("flag_id", "quote").distinct().withColumn("verified", F.lit(True))
    return quotes.join(found, ["flag_id", "quote"], "left").fillna(False, ["verified"])


def run_counters(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """A run's counters in one row; 0 says that the step ran and found nothing."""
    status = lambda s: F.count_if(F.col("status") == s).alias(f"documents_{s}")
    docs = documents.agg(F.count(F.lit(1)).alias("documents"), *map(status, ("done", "quarantined", "failed")))
    found = elements.agg(F.count(F.lit(1)).alias("elements"), F.count_if(F.col("trap_reason").isNotNull()).alias("elements_trapped"), F.count_if(F.col("validation_status") == VALID).alias("elements_valid"))
    return docs.crossJoin(F.broadcast(found))  # one row each
