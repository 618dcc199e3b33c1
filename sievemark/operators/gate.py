"""What stands between an agent's word and the tables: the gate of merges, the audit's arithmetic, the state of accuracy runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.operators import resolve
from sievemark.operators.review import BULK_LINKS
from sievemark.session import materialize


def merge_impact(proposals: DataFrame, links: DataFrame) -> DataFrame:
    """``proposal_id, impact``: active links of the persons that a proposal's two mentions are linked to, each person once; a mention without a link counts as itself.

    ``links (person_id, mention_id, active)`` has one active link a mention at most.
    """
    active = links.where("active").select("person_id", "mention_id").distinct()
    sizes = active.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    sides = proposals.select("proposal_id", F.explode(F.array("left_id", "right_id")).alias("mention_id"))
    met = sides.join(active, "mention_id", "left").groupBy("proposal_id", "person_id").agg(F.count(F.lit(1)).alias("alone")).join(sizes, "person_id", "left")
    return met.groupBy("proposal_id").agg(F.sum(F.when(F.col("person_id").isNull(), F.col("alone")).otherwise(F.col("n"))).alias("impact"))


def judged_proposals(proposals: DataFrame, mentions: DataFrame, links: DataFrame, bound: int = BULK_LINKS) -> DataFrame:
    """``outcome``, ``score``, ``impact`` and ``conflicting`` beside each proposal ``(proposal_id, left_id, right_id, decision)``.

    Both mentions are scored anew by the rules of a run, whatever the proposal says.
    Outcomes, in order: ``identical``, ``unknown_mention``, then for a merge
    ``hard_conflict`` (different values of a strong identifier), ``name_only`` (nothing but the
    name speaks for it), ``pending_approval`` (more than ``bound`` linked mentions), and
    otherwise the decision itself. ``mentions`` are those of ``resolve.mentions_of``; ids are
    distinct; a null id is an unknown mention; no proposals, no rows.
    """
    asked = materialize(proposals, "proposals")
    pairs = asked.where("left_id <> right_id").select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()
    pairs = pairs.withColumn("blocks", F.array().cast("array<string>"))
    own = mentions.join(pairs.select(F.explode(F.array("left_id", "right_id")).alias("mention_id")).distinct(), "mention_id", "left_semi")
    scored = resolve.score_pairs(resolve.pair_features(pairs, own)).select(F.col("left_id").alias("_lo"), F.col("right_id").alias("_hi"), "score", "conflicting", "corroborated")
    met = asked.join(scored, (F.least("left_id", "right_id") == F.col("_lo")) & (F.greatest("left_id", "right_id") == F.col("_hi")), "left").join(merge_impact(asked, links), "proposal_id", "left")
    merges = F.col("decision") == "merge"
    outcome = (
        F.when(F.col("left_id") == F.col("right_id"), "identical").when(F.col("score").isNull(), "unknown_mention")
        .when(merges & (F.size("conflicting") > 0), "hard_conflict").when(merges & ~F.col("corroborated"), "name_only")
        .when(merges & (F.col("impact") > bound), "pending_approval").otherwise(F.col("decision"))
    )
    return met.withColumn("outcome", outcome).select(*asked.columns, "outcome", "score", F.coalesce("impact", F.lit(0)).alias("impact"), "conflicting")


def checked_estimates(estimates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``fault`` and ``warning`` beside each audit's estimate, held against the verdicts it recorded.

    ``estimates (audit_id, sample_size, verified, contradicted, estimated_error_rate)``, ``verdicts (audit_id, flag_id,
    verdict)``. Faults: ``sample_size`` under 1, a count or rate out of range (``range``), more verdicts
    than the sample (``exceeds_sample``). Warnings: ``verdicts`` where the counts are not those recorded,
    else ``contradicted`` where that count is not. ``verdicts_recorded`` is 0 where there is none.
    """
    seen = verdicts.groupBy("audit_id").agg(F.count(F.lit(1)).alias("verdicts_recorded"), F.count_if(F.col("verdict") == "contradicted").alias("_contradicted"))
    both = estimates.join(seen, "audit_id", "left").fillna(0, ["verdicts_recorded", "_contradicted"])
    odd = (F.col("verified") < 0) | (F.col("contradicted") < 0) | ~F.col("estimated_error_rate").between(0, 1)
    total = F.col("verified") + F.col("contradicted")
    fault = F.when(F.col("sample_size") < 1, "sample_size").when(odd, "range").when(total > F.col("sample_size"), "exceeds_sample")
    warning = F.when(total != F.col("verdicts_recorded"), "verdicts").when(F.col("contradicted") != F.col("_contradicted"), "contradicted")
    return both.withColumns({"fault": fault, "warning": F.when(fault.isNull(), warning)}).drop("_contradicted")


def accuracy_summaries(runs: DataFrame) -> DataFrame:
    """The list view of accuracy runs, newest first: headline numbers, and a status derived from times and metrics.

    ``runs (accuracy_run_id, config_snapshot, metrics, started_at, finished_at, created_at)``, the
    second and third JSON texts. ``finished``, or ``failed`` where the metrics hold an error,
    once there are an end and metrics; else ``running`` once started, else ``pending``. Metrics with
    an error show no numbers; text that is no JSON counts as absent metrics.
    """
    metrics, snapshot = F.try_parse_json("metrics"), F.try_parse_json("config_snapshot")
    error = F.try_variant_get(metrics, "$.error", "string").isNotNull() | F.coalesce(F.is_variant_null(F.try_variant_get(metrics, "$.error", "variant")), F.lit(False))
    status = (
        F.when(F.col("finished_at").isNotNull() & metrics.isNotNull() & error, "failed").when(F.col("finished_at").isNotNull() & metrics.isNotNull(), "finished")
        .when(F.col("started_at").isNotNull(), "running").otherwise("pending")
    )
    number = lambda path, kind="double": F.when(~error, F.try_variant_get(metrics, path, kind))
    said = lambda name: F.try_variant_get(snapshot, f"$.{name}", "string").alias(name)
    return runs.select(
        "accuracy_run_id", status.alias("status"), said("config_profile"), said("manifest_path"), said("processing_run_id"),
        *[number(f"$.person.{m}").alias(f"person_{m}") for m in ("precision", "recall", "f1")],
        number("$.wrongly_merged_manifest_identities", "long").alias("wrongly_merged_manifest_identities"),
        number("$.trap_scorecard.trap_derived_fp_flags", "long").alias("trap_derived_fp_flags"), "started_at", "finished_at", "created_at",
    ).orderBy(F.desc("created_at"), F.asc("accuracy_run_id"))
