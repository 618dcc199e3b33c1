"""Spans of many patterns in precedence order, found in one look at each text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_FIELDS = {"rule": pa.int32(), "start": pa.int32(), "end": pa.int32(), "value": pa.string(), "before": pa.string(), "snippet": pa.string()}
_ARROW = pa.list_(pa.struct(list(_FIELDS.items())))
#: A span of group 1: which rule, where, what, and the characters around it that later tests look at.
CLAIM = ArrayType(StructType([StructField(n, IntegerType() if t == pa.int32() else StringType()) for n, t in _FIELDS.items()]))
#: Texts that are strings in Python at a time.
_TOGETHER = 64


def sweep(found: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """``(start, end, rule)`` in order of place, of all spans but those that meet one claimed before them.

    ``found`` holds each rule's spans in order, none meeting another of its own, the first rule first. Claimed spans
    never meet, so they lie in one order by start and by end, and a span is held against the one after its start
    and the one before it; each rule's claims are merged in by one sort of runs.
    """
    claimed: list[tuple[int, int, int]] = []
    for rule, spans in enumerate(found):
        fresh = []
        for start, end in spans:
            at = bisect_left(claimed, (start, end, -1))
            if (at == len(claimed) or claimed[at][0] >= end) and (at == 0 or claimed[at - 1][1] <= start):
                fresh.append((start, end, rule))
        if fresh:
            claimed = sorted(claimed + fresh)
    return claimed


def claims(rules: list[tuple[str, str]], trigger: str, refused: str, before: int, around: int) -> Callable:
    """An Arrow UDF from a text column to ``CLAIM``: what the patterns claim, in precedence order.

    ``rules`` are pairs of a pattern, whose group 1 is the value, and a shape. ``trigger`` finds
    the places of a text that could be part of a value, in one scan; only rules whose
    shape one of them has are run over the text. Values in which ``refused`` is found are no
    spans. A null text gives null, one without a place none. ``before`` and ``around`` are the
    numbers of characters kept before a span, and on both sides of it.
    """

    @F.arrow_udf(CLAIM)
    def claimed(texts: pa.Array) -> pa.Array:
        places = re.compile(trigger).findall
        compiled = [(re.compile(pattern).finditer, re.compile(shape).search) for pattern, shape in rules]
        refuse = re.compile(refused).search

        def of(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            shapes = "\n".join(places(text))
            if not shapes:
                return []
            found = [[m.span(1) for m in each(text) if not refuse(m[1])] if has(shapes) else [] for each, has in compiled]
            return [
                {"rule": rule, "start": a, "end": b, "value": text[a:b], "before": text[max(0, a - before) : a], "snippet": text[max(0, a - around) : b + around]}
                for a, b, rule in sweep(found)
            ]

        parts = [pa.array([of(t) for t in texts.slice(k, _TOGETHER).to_pylist()], _ARROW) for k in range(0, len(texts), _TOGETHER)]
        return pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return claimed
