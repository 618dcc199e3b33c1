"""Extraction from structure: sheet rows and cells, chunks, located values, confidence and escalation."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sievemark.domains import ELEMENT_CATEGORY

# Weights of a composite confidence.
SIGNAL_WEIGHTS = {"logprob": 0.35, "agreement": 0.25, "validator": 0.25, "grounding": 0.15}
REPAIRED_CAP = 0.75


@F.pandas_udf(ArrayType(StructType().add("line", "string").add("start", "integer")))
def _placed_lines(texts: pd.Series) -> pd.Series:
    """The lines of each text with their offsets, a line feed each between them."""
    def placed(text):
        lines = text.split("\n")
        return [{"line": line, "start": at} for line, at in zip(lines, accumulate((len(line) + 1 for line in lines), initial=0))]

    return texts.map(placed, na_action="ignore")


def sheet_rows(passages: DataFrame, separator: str = " | ", text_col: str = "text", first_row: str = "row_start") -> DataFrame:
    """Data rows of sheet passages, whose first line is the header: row number, line offset, cells."""
    rows = passages.select("*", F.posexplode(_placed_lines(F.col(text_col))).alias("line_no", "_line")).where("line_no > 0")
    return rows.withColumns({"line": F.col("_line.line"), "line_start": F.col("_line.start")}).drop("_line").withColumns({
        "row_number": F.col(first_row) + F.col("line_no") - 1, "cells": F.split("line", f"\\Q{separator}\\E", -1),
    })


def cell_span(cells: Column, column: Column, line_start: Column, separator: str) -> Column:
    """Start and end of the ``column``-th cell (from 1) in its passage."""
    start = line_start + F.aggregate(F.slice(cells, 1, column - 1), F.lit(0), lambda n, s: n + F.length(s) + len(separator))
    return F.struct(start.alias("start"), (start + F.length(F.try_element_at(cells, column))).alias("end"))


def elements_in_rows(rows: DataFrame, elements: DataFrame, passage_col: str = "passage_id") -> DataFrame:
    """Detected elements with the row whose line holds their start: an equi-join on the passage, then containment."""
    return elements.join(rows.select(passage_col, "row_number", "line_start", F.length("line").alias("_n")), passage_col).where("char_start >= line_start and char_start < line_start + _n").drop("_n")


def pack_chunks(passages: DataFrame, max_tokens: int = 3000, doc_col: str = "doc_id", family_col: str = "family", seq_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Passages of a family in order, packed greedily up to ``max_tokens``; a passage is never split.

    A token is four characters, a passage one token at least. Returns each chunk's
    passages as an array of sequence numbers. A running sum that starts anew where it
    would overflow is no window sum, so it folds over each family's sorted sizes; only
    numbers are gathered, no text.
    """
    tokens = F.greatest(F.floor(F.length(text_col) / 4), F.lit(1)).cast("int")
    family = passages.groupBy(doc_col, family_col).agg(F.array_sort(F.collect_list(F.struct(F.col(seq_col).cast("long").alias("seq"), tokens.alias("n")))).alias("ps"))
    empty = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("chunk"), F.array().cast("array<struct<chunk:int,seq:bigint>>").alias("out"))

    def put(s: Column, p: Column) -> Column:
        fresh = (s["chunk"] < 0) | (s["used"] + p["n"] > max_tokens)
        chunk = F.when(fresh, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(F.when(fresh, p["n"]).otherwise(s["used"] + p["n"]).alias("used"), chunk.alias("chunk"), F.array_append(s["out"], F.struct(chunk.alias("chunk"), p["seq"].alias("seq"))).alias("out"))

    placed = family.select(doc_col, family_col, F.explode(F.aggregate("ps", empty, put, lambda s: s["out"])).alias("p"))
    return placed.groupBy(doc_col, family_col, F.col("p.chunk").alias("chunk")).agg(F.array_sort(F.collect_list("p.seq")).alias("seqs"))


def locate_values(values: DataFrame, text_col: str = "text", value_col: str = "value", by: list[str] | None = None, order: str = "nth") -> DataFrame:
    """The k-th report of a value in a text belongs to its k-th occurrence, not overlapping; null where there is none."""
    k = F.row_number().over(Window.partitionBy(*(by or ["passage_id"]), value_col).orderBy(order))
    ranked = values.withColumn("_k", k)
    pieces = F.split(F.col(text_col), F.concat(F.lit("\\Q"), F.replace(F.col(value_col), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    start = F.aggregate(F.slice(pieces, 1, F.col("_k")), F.lit(0), lambda n, s: n + F.length(s)) + (F.col("_k") - 1) * F.length(value_col)
    found = (F.length(value_col) > 0) & (F.size(pieces) > F.col("_k"))
    return ranked.withColumn("char_start", F.when(found, start)).withColumn("char_end", F.col("char_start") + F.length(value_col)).drop("_k")


def nearest_mention(hits: DataFrame, mentions: DataFrame, key: str = "passage_id") -> DataFrame:
    """Each hit with the mention of its passage whose start is nearest, the first in order on ties."""
    both = hits.join(mentions.select(key, "mention_id", "seq", F.col("offset").alias("_o")), key)
    near = Window.partitionBy("hit_id").orderBy(F.abs(F.col("_o") - F.col("char_start")), "seq", "mention_id")
    return both.withColumn("_r", F.row_number().over(near)).where("_r = 1").drop("_r", "_o", "seq")


def composite_confidence(logprob: Column, agreement: Column, validator: Column, grounding: Column, repaired: Column) -> Column:
    """Mean of the signals at hand by their weights, to four places; 0 without any; capped where the output was repaired."""
    signals = dict(zip(SIGNAL_WEIGHTS, (logprob, agreement, validator, grounding), strict=True))
    total = sum((F.when(v.isNotNull(), w * v).otherwise(0.0) for (v, w) in ((signals[k], SIGNAL_WEIGHTS[k]) for k in signals)), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for (v, w) in ((signals[k], SIGNAL_WEIGHTS[k]) for k in signals)), F.lit(0.0))
    score = F.when(weight > 0, total / weight).otherwise(0.0)
    return F.round(F.when(F.coalesce(repaired, F.lit(False)), F.least(score, F.lit(REPAIRED_CAP))).otherwise(score), 4)


def logprob_signal(logprobs: Column) -> Column:
    """exp of the mean log probability, 1 at most; null without any."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x) / F.size(logprobs)
    return F.when(F.size(logprobs) > 0, F.least(F.exp(mean), F.lit(1.0)))


def vote_columns(votes: DataFrame, column: str, kind: str, rows: str = "n_rows") -> DataFrame:
    """Per sheet column the type with the most exact votes, if at least half of the rows, and one, say so."""
    counted = votes.groupBy(column, kind).agg(F.count(F.lit(1)).alias("votes"), F.max(rows).alias(rows))
    best = F.row_number().over(Window.partitionBy(column).orderBy(F.desc("votes"), F.asc(kind)))
    return counted.withColumn("_r", best).where("_r = 1").where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col(rows) / 2))).drop("_r")


def escalate(chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Whether a chunk goes to the second tier: invalid after repair, least confidence under the threshold, or a valid hit missed."""
    return chunks.withColumn("escalate", F.coalesce(~F.col("valid"), F.lit(True)) | (F.coalesce("confidence", F.lit(0.0)) < threshold) | (F.coalesce("missed_hits", F.lit(0)) > 0))


def sheet_mentions(rows: DataFrame, header_types: list[str | None], separator: str = " | ") -> tuple[DataFrame, DataFrame]:
    """Mentions and elements that mapped columns give, without a model: one mention per row with a name.

    ``rows`` is the outcome of ``sheet_rows`` for sheets with these header types. Returns
    ``(passage_id, row_number, name_raw, dob_raw)`` and ``(passage_id, row_number,
    element_type, value_raw, char_start, char_end)``; an empty cell gives nothing, nor does
    one whose characters are not the passage's at its span.
    """
    cell = lambda k: F.trim(F.coalesce(F.try_element_at("cells", F.lit(k)), F.lit("")))
    place = {t: k for k, t in reversed(list(enumerate(header_types, 1))) if t}
    mentions = rows.withColumns({"name_raw": cell(place["name"]) if "name" in place else F.lit(""), "dob_raw": cell(place["dob"]) if "dob" in place else F.lit(None).cast("string")})
    mentions = mentions.where("name_raw <> ''")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(header_types, 1) if t])
    each = mentions.withColumn("_c", F.explode(kinds)) if place else mentions.withColumn("_c", F.explode(F.array().cast("array<struct<k:int,t:string>>")))
    span = cell_span(F.col("cells"), F.col("_c.k"), F.col("line_start"), separator)
    each = each.withColumns({"value_raw": F.try_element_at("cells", F.col("_c.k")), "_s": span})
    same = F.substring("text", F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start")) == F.col("value_raw")
    elements = each.where(same & (F.trim("value_raw") != "")).select("passage_id", "row_number", F.col("_c.t").alias("element_type"), "value_raw", F.col("_s.start").alias("char_start"), F.col("_s.end").alias("char_end"))
    return mentions.select("passage_id", "row_number", "name_raw", "dob_raw"), elements


def tier_outcome(chunks: DataFrame) -> DataFrame:
    """Which tier's output stands: the second where it was asked for and is valid, else a valid first with a review, else a review alone."""
    second, first = F.coalesce("tier2_valid", F.lit(False)), F.coalesce("tier1_valid", F.lit(False))
    return chunks.withColumns({
        "outcome": F.when(~F.col("escalate") & first, "llm_tier1").when(second, "llm_tier2").when(first, "llm_tier1"),
        "review": F.when(~F.col("escalate") & first, False).otherwise(~second),
    })


def tier0_agreement(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Whether detection agrees with each reported value: null without a hit, false if any hit is trapped.

    ``found (passage_id, element_type, value)``, ``hits (passage_id, element_type, value, trap_reason)``.
    """
    seen = hits.groupBy("passage_id", "element_type", "value").agg(F.bool_and(F.col("trap_reason").isNull()).alias("agreement"))
    return found.join(seen, ["passage_id", "element_type", "value"], "left")


def rollup_min(elements: DataFrame, by: str, confidence: str = "confidence") -> DataFrame:
    """The least confidence per group; 0 where none is known."""
    return elements.groupBy(by).agg(F.coalesce(F.min(confidence), F.lit(0.0)).alias("confidence"))


#: What a model's answer for one passage must hold (fixed values).
ANSWER = "mentions array<struct<name:string>>, elements array<struct<element_type:string,value_raw:string,mention_ref:int,confidence:double>>"


def contract_faults(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``fault`` beside each answer: null, or the first rule that it breaks.

    Rules, in order: the answer is JSON; every element has a type of the closed domain, a
    value, a confidence between 0 and 1, and a mention reference that is null or a place in the mentions.
    """
    got = F.from_json(F.col(answer_col), ANSWER)
    elements, n = F.coalesce(got["elements"], F.array().cast("array<struct<element_type:string,value_raw:string,mention_ref:int,confidence:double>>")), F.coalesce(F.size(got["mentions"]), F.lit(0))
    valid = F.try_parse_json(F.col(answer_col)).isNotNull()
    empty = F.exists(elements, lambda e: F.coalesce(F.length(e["value_raw"]), F.lit(0)) == 0)
    unsure = F.exists(elements, lambda e: e["confidence"].isNull() | (e["confidence"] < 0) | (e["confidence"] > 1))
    dangling = F.exists(elements, lambda e: F.coalesce((e["mention_ref"] < 0) | (e["mention_ref"] >= F.greatest(n, F.lit(0))), F.lit(False)))
    strange = F.exists(elements, lambda e: ~F.coalesce(e["element_type"].isin(*ELEMENT_CATEGORY, "name"), F.lit(False)))
    return answers.withColumn("fault", F.when(~valid, "not_json").when(strange, "element_type").when(empty, "empty_value").when(unsure, "confidence").when(dangling, "mention_ref"))


def sheet_sample(sheets: DataFrame, rows: int = 5) -> DataFrame:
    """The first ``rows`` rows of the columns that have a header but no known type; sheets without such columns have none.

    ``sheets (sheet_id, header array<string>, types array<string>, cells array<array<string>>)``; returns
    ``sheet_id, columns, sample``.
    """
    places = F.filter(F.sequence(F.lit(1), F.size("header")), lambda k: (F.trim(F.element_at("header", k)) != "") & F.element_at("types", k).isNull())
    open_ = sheets.where("size(header) > 0").withColumn("_p", places).where("size(_p) > 0")
    pick = lambda row: F.transform("_p", lambda k: F.try_element_at(row, k))
    return open_.select("sheet_id", pick(F.col("header")).alias("columns"), F.transform(F.slice("cells", 1, rows), pick).alias("sample"))
