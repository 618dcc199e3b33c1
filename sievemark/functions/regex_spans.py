"""Spans of regular expression matches as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def regex_spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as an array of (start, end, value), offsets in characters from 0.

    The value is group 1, which must end where the match ends. Offsets follow from the
    pieces between the matches: a match ends after the pieces and matches before it, its
    own included. Null text gives null, no match an empty array.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), 1)
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(state: Column, hit: Column) -> Column:
        end = state["at"] + F.length(hit["between"]) + F.length(hit["whole"])
        span = F.struct((end - F.length(hit["value"])).alias("start"), end.alias("end"), hit["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(state["out"], span).alias("out"))

    hits = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(between, 1, F.size(whole)).alias("between"))
    return F.when(F.size(whole) > 0, F.aggregate(hits, start, add, lambda s: s["out"])).when(text.isNotNull(), F.array().cast(SPAN))


def last_match_end(text: Column, pattern: str) -> Column:
    """Where the last match of ``pattern`` ends, or null: what follows it is the last piece between matches."""
    between = F.split(text, pattern, -1)
    return F.when(F.size(between) > 1, F.length(text) - F.length(F.element_at(between, -1)))


def preceding(text: Column, start: Column, size: int) -> Column:
    """The ``size`` characters before ``start``, fewer at the beginning of the text."""
    return F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size)))
