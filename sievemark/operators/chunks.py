"""Values reported for a chunk, led back to the passage and place they stand at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between two passages of a chunk (fixed value).
JOIN = "\n\n"


def chunk_spans(passages: DataFrame, chunks: DataFrame, by: list[str], seq_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Each chunk's ``text`` and ``spans array<struct<start, end, seq>>``, its passages' places in it.

    ``chunks`` holds ``by``, ``chunk`` and ``seqs``, as ``pack_chunks`` gives them; null
    texts count as empty. A chunk is bounded by its token limit or is a single passage,
    so one row holds its text.
    """
    each = chunks.select(*by, "chunk", F.explode("seqs").alias("_seq"))
    own = passages.select(*by, F.col(seq_col).cast("long").alias("_seq"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    held = each.join(own, [*by, "_seq"]).groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("seq"), F.col("_text").alias("text")))).alias("_ps"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,seq:bigint>>").alias("spans"))

    def put(state: Column, p: Column) -> Column:
        end = state["at"] + F.length(p["text"])
        return F.struct((end + len(JOIN)).alias("at"), F.array_append(state["spans"], F.struct(state["at"].alias("start"), end.alias("end"), p["seq"].alias("seq"))).alias("spans"))

    return held.select(*by, "chunk", F.array_join("_ps.text", JOIN).alias("text"), F.aggregate("_ps", none, put, lambda s: s["spans"]).alias("spans"))


def occurrences(text: Column, value: Column, most: Column) -> Column:
    """Where ``value`` begins in ``text``, from 0, left to right without overlap, the first ``most``; none for an empty value."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, quoted, most + 1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, piece: F.struct((s["at"] + F.length(piece) + F.length(value)).alias("at"), F.array_append(s["found"], s["at"] + F.length(piece)).alias("found"))
    found = F.aggregate(F.slice(pieces, 1, F.least(F.size(pieces) - 1, most)), none, step, lambda s: s["found"])
    return F.when(F.length(value) > 0, found).otherwise(F.array().cast("array<int>"))


def _powers(spans: Column) -> Column:
    """The powers of two up to the number of ``spans``, largest first: the steps of ``last_begun``."""
    return F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda p: p <= F.size(spans))


def last_begun(spans: Column, powers: Column, place: Column) -> Column:
    """The number (from 1) of the last of ascending ``spans`` that does not start above ``place``, by binary search over ``_powers``; 0 if none is."""
    def step(lo: Column, power: Column) -> Column:
        return F.when(F.try_element_at(spans, lo + power)["start"] <= place, lo + power).otherwise(lo)

    return F.aggregate(powers, F.lit(0), step)


def locate_in_chunks(chunks: DataFrame, reports: DataFrame, by: list[str], value_col: str = "value", order: str = "nth", verbatim: bool = True) -> DataFrame:
    """Each report with the passage it stands in: ``seq, char_start, char_end`` within that passage, null where it has no place.

    ``chunks`` are those of ``chunk_spans``; ``reports`` hold ``by``, ``chunk``, a value and
    their order. The k-th report of a value in a chunk belongs to the value's k-th
    occurrence there, left to right without overlap. ``verbatim``: occurrences are those
    of the chunk's text, as a model saw it; one that runs across the border of two passages is
    counted, but is no place. Otherwise each passage is searched by itself, in order, so
    nothing runs across. Empty and null values, reports beyond the last occurrence and
    reports of unknown chunks have no place; repeated reports are told apart by their
    order, ties in it by nothing else; other columns of ``reports`` stay. A chunk's text is read once
    for all its reports.
    """
    keys = [*by, "chunk"]
    kept = [c for c in reports.columns if c not in keys]
    asked = reports.groupBy(*keys, F.col(value_col).alias("_value")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), F.struct(*kept).alias("_row")))).alias("_rows"))
    asked = asked.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_value").alias("value"), F.col("_rows").alias("rows"))).alias("_asked"))
    met = asked.join(chunks.select(*keys, F.col("text").alias("_text"), F.col("spans").alias("_spans"), _powers(F.col("spans")).alias("_powers")), keys, "left")
    place = "struct<seq:bigint,char_start:int,char_end:int>"

    def in_chunk(v: Column, k: Column) -> Column:
        # a span is looked up once: what a lambda names is worked out wherever it is named
        own = lambda at: F.struct(at.alias("at"), F.try_element_at("_spans", last_begun(F.col("_spans"), F.col("_powers"), at)).alias("own"))

        def span(x: Column) -> Column:
            at, own = x["at"], x["own"]
            return F.when(at + F.length(v) <= own["end"], F.struct(own["seq"].alias("seq"), (at - own["start"]).cast("int").alias("char_start"), (at - own["start"] + F.length(v)).cast("int").alias("char_end"))).cast(place)

        return F.transform(F.transform(occurrences(F.col("_text"), v, k), own), span)

    def in_passages(v: Column, k: Column) -> Column:
        def each(s: Column) -> Column:
            own = F.substring("_text", s["start"] + 1, s["end"] - s["start"])
            return F.transform(occurrences(own, v, k), lambda at: F.struct(s["seq"].alias("seq"), at.cast("int").alias("char_start"), (at + F.length(v)).cast("int").alias("char_end")).cast(place))

        return F.flatten(F.transform("_spans", each))

    places = in_chunk if verbatim else in_passages
    no_place = F.array().cast(f"array<{place}>")
    each = F.transform("_asked", lambda a: F.struct(a["rows"].alias("rows"), F.coalesce(places(a["value"], F.size(a["rows"])), no_place).alias("places")))
    found = met.select(*keys, F.explode(each).alias("a")).select(*keys, "a.places", F.posexplode("a.rows").alias("_k", "r"))
    got = F.try_element_at("places", F.col("_k") + 1)
    return found.select(*keys, *[F.col(f"r._row.`{c}`").alias(c) for c in kept], got["seq"].alias("seq"), got["char_start"].alias("char_start"), got["char_end"].alias("char_end"))
