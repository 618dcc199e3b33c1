"""The listing, review and cost queries: filters, semi-joins, conditional aggregates and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import materialize


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of ``df`` in a total order; Spark plans it as a top-n."""
    return df.orderBy(*order).offset(offset).limit(limit)


def listing(df: DataFrame, order: list[Column], limit: int, offset: int = 0, **equal) -> tuple[DataFrame, DataFrame]:
    """A page of the rows that equal the given values (None: any), and their total in one row."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return page(df, order, limit, offset), df.agg(F.count(F.lit(1)).alias("total"))


def exposure_list(persons: DataFrame, flags: DataFrame, search: str | None = None, category: str | None = None, review_status: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """Persons with mentions that match: ``search`` in name or aliases (% and _ are wildcards), a status, an exposed flag."""
    found = persons.where("mention_count > 0")
    if search:
        found = found.where(F.col("best_name").ilike(f"%{search}%") | F.to_json("aliases").ilike(f"%{search}%"))
    if review_status:
        found = found.where(F.col("review_status") == review_status)
    if category or min_confidence is not None:
        held = flags.where("exposed")
        held = held.where(F.col("category") == category) if category else held
        held = held.where(F.col("confidence") >= min_confidence) if min_confidence is not None else held
        found = found.join(held, "person_id", "left_semi")
    return found


def confidence_band(confidence: Column) -> Column:
    """high from 0.8, medium from 0.5, else low; unknown counts as low."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def audit_band(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unscored").when(confidence < 0.5, "low").when(confidence < 0.8, "mid").otherwise("high")


def stratified_sample(flags: DataFrame, strata: list[str], order: list[Column], size: int = 50) -> DataFrame:
    """``size`` rows taken in turns from each stratum, in the order given within a stratum."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    ranked = flags.withColumn("turn", turn)
    return ranked.where(F.col("turn") <= size).orderBy("turn", *strata).limit(size)


def failure_rates(documents: DataFrame, by: str = "file_class") -> DataFrame:
    """Per class: total, quarantined, failed, done, and the share that failed either way, to four places."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = documents.groupBy(by).agg(F.count(F.lit(1)).alias("total"), n("quarantined").alias("quarantined"), n("failed").alias("failed"), n("done").alias("done"))
    return out.withColumn("failure_rate", F.round((F.col("quarantined") + F.col("failed")) / F.col("total"), 4))


def last_wins(events: DataFrame, key: str, value: str, at: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias(value))


def cost_summary(events: DataFrame) -> DataFrame:
    """Calls, tokens and cost per purpose and model, with the tier a purpose belongs to."""
    tier = F.when(F.col("purpose").startswith("tier"), F.substring_index("purpose", "_", 1)).when(F.col("purpose").startswith("agent_"), "agent").otherwise(F.col("purpose"))
    return events.groupBy("purpose", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cached_input_tokens").alias("cached_input_tokens"), F.sum("cost_usd").alias("cost_usd"),
    ).withColumn("tier", tier)


def cost_totals(events: DataFrame) -> DataFrame:
    """All calls in one row, the share of cached input to four places (0 without input), and cost outside documents."""
    total = events.agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("cached_input_tokens"), F.lit(0)).alias("cached_input_tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd"),
        F.coalesce(F.sum(F.when(F.col("document_id").isNull(), F.col("cost_usd"))), F.lit(0)).alias("non_document_cost"),
    )
    return total.withColumn("cache_hit_rate", F.when(F.col("input_tokens") > 0, F.round(F.col("cached_input_tokens") / F.col("input_tokens"), 4)).otherwise(0.0))


def cost_by_class(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Per file class: documents, documents with cost, and their cost; classes without cost stay with 0."""
    spent = events.where("document_id is not null").join(documents.select("document_id", "file_class"), "document_id").groupBy("file_class").agg(F.count_distinct("document_id").alias("costed"), F.sum("cost_usd").alias("cost_usd"))
    return documents.groupBy("file_class").agg(F.count(F.lit(1)).alias("documents")).join(spent, "file_class", "left").fillna(0, ["costed", "cost_usd"])


def extrapolate_cost(per_class: DataFrame, scale: int) -> DataFrame:
    """What ``scale`` documents would cost at the classes' shares and mean costs, and with ten points more of the dearest class.

    Shares are rounded to four places first. The dearest class gains 0.1, no more than
    the rest holds, and the others shrink in proportion. One row; none without documents.
    """
    everything = Window.partitionBy()
    rows = per_class.withColumns({"share": F.round(F.col("documents") / F.sum("documents").over(everything), 4), "mean": F.when(F.col("documents") > 0, F.col("cost_usd") / F.col("documents")).otherwise(0.0)})
    top = rows.agg(F.max_by("file_class", F.struct("mean", "file_class")).alias("dearest"), F.max_by("share", F.struct("mean", "file_class")).alias("top_share"))
    moved = F.least(F.lit(0.1), 1 - F.col("top_share"))
    rows = rows.crossJoin(F.broadcast(top))  # one row
    shrunk = F.when(F.col("file_class") == F.col("dearest"), F.col("share") + moved).when(F.col("top_share") < 1, F.col("share") * (1 - moved / (1 - F.col("top_share")))).otherwise(F.col("share"))
    return rows.agg(
        F.round(F.sum(F.col("share") * F.col("mean")) * scale, 4).alias("projected"), F.round(F.sum(shrunk * F.col("mean")) * scale, 4).alias("sensitivity"), F.first("dearest").alias("dearest"),
    ).where("dearest is not null")


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per call from prices per million tokens, cached input apart; an unknown model costs nothing."""
    cached = F.least(F.col("cached_input_tokens"), F.col("input_tokens"))
    cost = ((F.col("input_tokens") - cached) * F.col("input_price") + cached * F.col("cached_price") + F.col("output_tokens") * F.col("output_price")) / 1e6
    return calls.join(prices, "model", "left").withColumn("cost_usd", F.round(F.coalesce(cost, F.lit(0.0)), 6)).drop("input_price", "cached_price", "output_price")


def within_budget(events: DataFrame, run_col: str, order: list[str], ceiling: float) -> DataFrame:
    """Marks each event with what its run had ``spent_before`` it, and whether that is less than ``ceiling`` (``allowed``).

    Sums in two levels: events are dealt into ranges of run and order, and written; the
    ranges' sums give what a range's run had spent before the range, and only events of
    one range and run are summed one by one. So a run that holds most events is spread over tasks, and
    no window holds a whole run. Events alike in run and order stand in any order; a null
    cost counts as nothing, a null run is a run; an empty table gives an empty result.
    """
    ranges = materialize(events.repartitionByRange(run_col, *order).withColumn("_range", F.spark_partition_id()), "budget-ranges")
    sums = ranges.groupBy(F.col(run_col).alias("_run"), F.col("_range").alias("_of")).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("_sum"))
    earlier = Window.partitionBy("_run").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_run", "_of", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_base"))
    before = Window.partitionBy(run_col, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("_within", F.coalesce(F.sum("cost_usd").over(before), F.lit(0.0))).join(bases, F.col(run_col).eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_of")))
    spent = F.col("_base") + F.col("_within")
    return placed.withColumn("spent_before", spent).withColumn("allowed", F.col("spent_before") < ceiling).select(*events.columns, "spent_before", "allowed")
