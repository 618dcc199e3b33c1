"""What a caseworker asks of a run: ledgers, linked elements, keys, queues, cards and recomputation for some persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.domains import VALID
from sievemark.operators.detect import detect
from sievemark.operators.exposure import admitted, attach_by_key, write_flags

#: Element types whose values join a passage to a person (fixed values).
JOIN_KEY_TYPES = ("ssn",)


def newest_first(rows: DataFrame, at: str, id_col: str, **equal) -> DataFrame:
    """Rows that equal the given values (None: any), newest first, ids breaking ties."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc(at), F.asc(id_col))


def passages_of(passages: DataFrame, document_id) -> DataFrame:
    return passages.where(F.col("document_id") == document_id).orderBy("seq")


def open_quarantines(quarantines: DataFrame, documents: DataFrame, run_id) -> DataFrame:
    """A run's quarantine rows with their documents, oldest first."""
    of_run = documents.where(F.col("run_id") == run_id).select("document_id", "file_class", "run_id")
    return quarantines.join(of_run, "document_id").orderBy("created_at", "quarantine_id")


def latest_run(documents: DataFrame) -> DataFrame:
    """The run of the newest document, the greater id on ties: one row ``run_id``, none without documents."""
    return documents.where("run_id is not null").groupBy("run_id").agg(F.max("created_at").alias("at")).agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id")).where("run_id is not null")


def latest_run_with_persons(runs: DataFrame, persons: DataFrame) -> DataFrame:
    """The newest run that has a person, the greater id on ties: one row ``run_id``, none without persons. ``runs (run_id, created_at)``."""
    held = runs.join(persons.select("run_id").distinct(), "run_id", "left_semi")
    return held.agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id")).where("run_id is not null")


def flags_of_persons(flags: DataFrame, persons: DataFrame) -> DataFrame:
    """All flags of the given persons, by person and category; no persons, no flags."""
    return flags.join(persons.select("person_id").distinct(), "person_id", "left_semi").orderBy("person_id", "category")


def run_status(documents: DataFrame, quarantines: DataFrame) -> DataFrame:
    """Per run and status: documents, and how many of them have an open quarantine row."""
    held = quarantines.where("status = 'open'").select("document_id").distinct().withColumn("held", F.lit(1))
    return documents.join(held, "document_id", "left").groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count("held").alias("open_quarantines"))


def active_links(links: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        links = links.where(F.col(column) == value)
    return links.where("active")


def link_ledger(links: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Every link of every person, inactive ones too, with its mention and document."""
    return links.join(mentions, "mention_id").join(documents.select("document_id", "file_class"), "document_id").select("person_id", "mention_id", "method", "active", "name_raw", "document_id", "file_class")


def linked_elements(links: DataFrame, elements: DataFrame, persons: DataFrame | None = None) -> DataFrame:
    """``person_id`` and the elements of the person's actively linked mentions; of some persons, if given."""
    active = links.where("active").select("person_id", "mention_id").distinct()
    if persons is not None:
        active = active.join(persons.select("person_id").distinct(), "person_id", "left_semi")
    return active.join(elements.where("mention_id is not null"), "mention_id")


def documents_of_persons(links: DataFrame, mentions: DataFrame) -> DataFrame:
    return links.where("active").join(mentions, "mention_id").groupBy("person_id").agg(F.count_distinct("document_id").alias("documents"))


def evidence_per_person(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("person_id").agg(F.count(F.lit(1)).alias("evidence"))


def person_detail(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Per person and category: elements counted, their types and the classes of the documents they stand in, sorted."""
    sorted_set = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = evidence.join(documents.select("document_id", "file_class"), "document_id")
    return rows.groupBy("person_id", "category").agg(F.count(F.lit(1)).alias("evidence"), sorted_set("element_type").alias("types"), sorted_set("file_class").alias("classes"))


def signal_attached(elements: DataFrame) -> DataFrame:
    """Elements without a mention that a reviewer, or else an earlier pass over keys, attached to a person: ``person_id`` beside them."""
    target = F.coalesce(F.col("signals.reviewer_attached_person_id"), F.col("signals.er_join_person_id"))
    return elements.where("mention_id is null").withColumn("person_id", target).where("person_id is not null")


def usable(elements: DataFrame) -> DataFrame:
    return elements.where(admitted(F.col("element_type"), F.col("validation_status"), F.col("trap_reason")))


def person_keys(linked: DataFrame, employee_keys: DataFrame) -> DataFrame:
    """``person_id, key`` of all persons: usable linked social security numbers, and ``employee_keys (person_id, key)`` of their mentions."""
    typed = lambda t, v: F.concat_ws(":", t, v)
    strong = usable(linked).where(F.col("element_type").isin(*JOIN_KEY_TYPES)).select("person_id", typed(F.col("element_type"), F.col("value_normalized")).alias("key"))
    return strong.unionByName(employee_keys.select("person_id", typed(F.lit("employee_id"), F.col("key")).alias("key"))).distinct()


def employee_ids(passages: DataFrame) -> DataFrame:
    """``passage_id`` and its untrapped employee ids, distinct and sorted; found anew in the text, as they are never elements."""
    hits = detect(passages.select("passage_id", "text")).where("element_type = 'employee_id' and trap_reason is null")
    return hits.groupBy("passage_id").agg(F.array_sort(F.collect_set("value_normalized")).alias("employee_ids"))


def passage_keys(passages: DataFrame, elements: DataFrame) -> DataFrame:
    """``passage_id, key``: employee ids in its text, and valid social security numbers found in it."""
    ids = employee_ids(passages).select("passage_id", F.explode("employee_ids").alias("id")).select("passage_id", F.concat(F.lit("employee_id:"), "id").alias("key"))
    strong = elements.where((F.col("element_type") == "ssn") & (F.col("validation_status") == VALID)).join(passages.select("passage_id").distinct(), "passage_id", "left_semi")
    return ids.unionByName(strong.select("passage_id", F.concat(F.lit("ssn:"), F.col("value_normalized")).alias("key"))).distinct()


def attach_unattached(elements: DataFrame, links: DataFrame, passages: DataFrame, employee_keys: DataFrame) -> DataFrame:
    """Every element without mention and without signal, attached by key or parked: ``element_id, person_id, via_key``."""
    signalled = F.coalesce(F.col("signals.reviewer_attached_person_id"), F.col("signals.er_join_person_id"))
    loose = elements.where(F.col("mention_id").isNull() & signalled.isNull())
    near = passages.join(loose.select("passage_id").distinct(), "passage_id", "left_semi")
    return attach_by_key(loose.select("element_id", "passage_id"), passage_keys(near, elements), person_keys(linked_elements(links, elements), employee_keys))


def obsolete_parked(items: DataFrame, elements: DataFrame) -> DataFrame:
    """Open items on parked elements that have since got a mention or a person: dismissed; all others as they are."""
    signalled = F.coalesce(F.col("signals.reviewer_attached_person_id"), F.col("signals.er_join_person_id"))
    resolved = elements.where(F.col("mention_id").isNotNull() | signalled.isNotNull()).select("element_id").distinct().withColumn("_resolved", F.lit(True))
    done = (F.col("status") == "open") & (F.col("reason") == "unattached_pii") & F.col("_resolved")
    return items.join(resolved, "element_id", "left").withColumns({"status": F.when(done, "dismissed").otherwise(F.col("status")), "decision": F.when(done, "auto_attached")}).drop("_resolved")


def recompute_persons(persons: DataFrame, links: DataFrame, elements: DataFrame, verdicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flags and evidence of the given persons alone, as the whole run would compute them."""
    wanted = persons.select("person_id").distinct()
    extra = signal_attached(elements).join(wanted, "person_id", "left_semi")
    own = linked_elements(links, elements, wanted).unionByName(extra)
    return write_flags(own, verdicts=None if verdicts is None else verdicts.join(wanted, "person_id", "left_semi"))


def find_elements(elements: DataFrame, element_type: str, value: str, limit: int = 50) -> DataFrame:
    """Elements of a type with exactly this normal value, by id, ``limit`` or 50 at most."""
    return elements.where((F.col("element_type") == element_type) & (F.col("value_normalized") == value)).orderBy("element_id").limit(min(limit, 50))


def items_of_element(items: DataFrame, element_id) -> DataFrame:
    return items.where(F.get_json_object("ref", "$.pii_element_id") == str(element_id))


def decisions_of_mention(decisions: DataFrame, mention_id) -> DataFrame:
    return decisions.where((F.col("left_id") == mention_id) | (F.col("right_id") == mention_id))


def pair_cards(items: DataFrame, mentions: DataFrame, elements: DataFrame) -> DataFrame:
    """Both mentions of each pair side by side, each with its name and its elements, sorted."""
    told = F.array_sort(F.collect_list(F.concat_ws(":", "element_type", "value_normalized")))
    held = elements.where("mention_id is not null").groupBy("mention_id").agg(told.alias("held"))
    sides = mentions.select("mention_id", "name_raw").join(held, "mention_id", "left")
    side = lambda s: sides.select(F.col("mention_id").alias(f"{s}_id"), F.col("name_raw").alias(f"{s}_name"), F.coalesce("held", F.array().cast("array<string>")).alias(f"{s}_elements"))
    return items.join(side("left"), "left_id").join(side("right"), "right_id")


def keep_separate(links: DataFrame, pairs: DataFrame, new_person: Column) -> DataFrame:
    """Pairs judged to be two persons: the right mention leaves a person it shares with the left one; else both links are confirmed.

    ``pairs (left_id, right_id)``; ``new_person`` names the person of a mention that leaves,
    from its ``mention_id``. Old links stay, inactive.
    """
    active = links.where("active").select("mention_id", "person_id")
    of = lambda s: active.select(F.col("mention_id").alias(f"{s}_id"), F.col("person_id").alias(f"{s}_person"))
    judged = pairs.join(of("left"), "left_id").join(of("right"), "right_id").withColumn("same", F.col("left_person") == F.col("right_person"))
    verdicts = judged.select(F.explode(F.array(F.struct(F.col("left_id").alias("mention_id"), F.lit(False).alias("leaves")), F.struct(F.col("right_id").alias("mention_id"), F.col("same").alias("leaves")))).alias("v")).select("v.*")
    verdicts = verdicts.groupBy("mention_id").agg(F.bool_or("leaves").alias("leaves"))
    told = links.join(verdicts, "mention_id", "left")
    moved = told.where("active and leaves")
    stay = told.withColumns({"active": F.col("active") & ~F.coalesce("leaves", F.lit(False)), "method": F.when(F.col("active") & (F.col("leaves") == False), "reviewer").otherwise(F.col("method"))})  # noqa: E712
    return stay.select(*links.columns).unionByName(moved.withColumns({"person_id": new_person, "method": F.lit("reviewer"), "active": F.lit(True)}).select(*links.columns))
