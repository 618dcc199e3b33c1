"""From elements to exposure: admission, attachment by key, flags with their evidence, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.domains import CATEGORIES, DETECTOR_CONFIDENCE, ELEMENT_CATEGORY, FORMAT_ONLY, VALID, VERDICT_TYPES


def _mapped(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def category_of(element_type: Column) -> Column:
    return F.try_element_at(_mapped(ELEMENT_CATEGORY), element_type)


def admitted(element_type: Column, status: Column, trap: Column) -> Column:
    """Whether an element counts: without a trap, and valid, or format_only for types without a check."""
    return trap.isNull() & ((status == VALID) | ((status == FORMAT_ONLY) & ~element_type.isin(*VERDICT_TYPES)))


def confidence_of(stored: Column, detector: Column) -> Column:
    return F.coalesce(stored.cast("double"), F.try_element_at(_mapped(DETECTOR_CONFIDENCE), detector), F.lit(0.5))


def write_flags(elements: DataFrame, person_col: str = "person_id", verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags ``(person, category, exposed, confidence, evidence_count, review_status)`` and their evidence.

    ``elements`` has person, element_id, element_type, validation_status, trap_reason,
    detector, confidence. An element counts once per person. A flag's confidence is the
    highest among its evidence. ``verdicts (person, category, exposed, review_status)``
    by people stand over what is computed; without evidence they stand alone.
    """
    usable = elements.where(admitted(F.col("element_type"), F.col("validation_status"), F.col("trap_reason")))
    evidence = (
        usable.withColumn("category", category_of(F.col("element_type"))).where(F.col("category").isNotNull() & F.col(person_col).isNotNull())
        .withColumn("confidence", confidence_of(F.col("confidence"), F.col("detector"))).dropDuplicates([person_col, "element_id"])
    )
    flags = evidence.groupBy(person_col, "category").agg(F.lit(True).alias("exposed"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("evidence_count")).withColumn("review_status", F.lit("auto"))
    if verdicts is not None:
        human = verdicts.select(person_col, "category", F.col("exposed").alias("_e"), F.col("review_status").alias("_r"))
        flags = flags.join(human, [person_col, "category"], "full").select(
            person_col, "category", F.coalesce("_e", "exposed").alias("exposed"), "confidence",
            F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), F.coalesce("_r", "review_status").alias("review_status"),
        )
    return flags, evidence


def attach_by_key(orphans: DataFrame, passage_keys: DataFrame, person_keys: DataFrame) -> DataFrame:
    """Elements without a mention, attached to the one person whose key their passage holds, or parked.

    ``orphans (element_id, passage_id)``, ``passage_keys (passage_id, key)``, ``person_keys
    (key, person_id)``. Returns ``element_id, person_id, via_key``; person_id is null, the
    element parked, unless exactly one person matches; via_key is the least key that matched.
    """
    # persons are counted out per key, then per passage, so elements meet one row each and not every person of every key
    span = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("via_key").alias("via_key")]
    keyed = person_keys.groupBy("key").agg(F.min("person_id").alias("low"), F.max("person_id").alias("high"))
    passed = passage_keys.join(keyed.hint("shuffle_hash"), "key").withColumnRenamed("key", "via_key").groupBy("passage_id").agg(*span)
    found = orphans.join(passed, "passage_id").groupBy("element_id").agg(*span).where("low = high").select("element_id", F.col("low").alias("person_id"), "via_key")
    return orphans.select("element_id").join(found, "element_id", "left")


def without_evidence(flags: DataFrame, evidence: DataFrame, person_col: str = "person_id") -> DataFrame:
    """Flags that no evidence backs; must be empty."""
    return flags.where("exposed").join(evidence, [person_col, "category"], "left_anti")


def export_rows(persons: DataFrame, flags: DataFrame, person_col: str = "person_id") -> DataFrame:
    """One row per person, by name and id: identity, a flag and a confidence per category, evidence and mention counts."""
    wide = flags.groupBy(person_col).pivot("category", list(CATEGORIES)).agg(F.first("exposed").alias("exposed"), F.first("confidence").alias("confidence"))
    total = flags.groupBy(person_col).agg(F.sum("evidence_count").alias("evidence_count"))
    joined = persons.join(wide, person_col, "left").join(total, person_col, "left")
    alias = F.array_join(F.transform("aliases", lambda a: F.concat(a["name"], F.lit(" ["), a["kind"], F.lit("]"))), "; ")
    shown = [F.coalesce(F.col(f"{c}_exposed"), F.lit(False)).alias(c) for c in CATEGORIES]
    sure = [F.col(f"{c}_confidence") for c in CATEGORIES]
    return joined.select(
        person_col, "best_name", alias.alias("aliases"), "dob", *shown, "er_confidence", "review_status", "document_count", *sure,
        F.coalesce("evidence_count", F.lit(0).cast("long")).alias("evidence_count"), "mention_count",
    ).where("mention_count > 0").orderBy("best_name", person_col)
