"""Rows kept or repeated where they lie: decisions travel to the files, the rows do not move."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.session import Scratch

#: Rows of a file whose counts make one row of the table of decisions.
CHUNK = 4096
#: Rows, at a byte each, whose decisions are sent to all tasks at once, at most.
SENT_ROWS = 1 << 26


def with_position(docs: DataFrame, name: str = "_position") -> DataFrame:
    """``docs`` as they lie in files, and where: a struct of file and row. Frames not read from files are written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(name, place)
    except AnalysisException:
        return Scratch(docs.sparkSession).keep(docs, "positioned").withColumn(name, place)


def repeat_rows(placed: DataFrame, counts: DataFrame, name: str = "_position", sent_rows: int = SENT_ROWS) -> DataFrame:
    """Each row of ``placed`` (from ``with_position``) as often as ``counts (name, n)`` says; ``name`` is dropped.

    ``counts`` has a row for every row of ``placed``, n from 0 to 127. Decisions are
    packed, a byte a row, and joined to the scan by file and chunk: only they travel.
    They are sent to all tasks in waves of whole files with ``sent_rows`` rows at most,
    and each wave scans its own files. A wave that one file alone overfills is joined by
    a shuffle. Repeated or null values in other columns do not matter, as rows are told
    apart by their place; an empty table gives an empty result.
    """
    scratch = Scratch(placed.sparkSession)
    chunks = scratch.keep(
        counts.select(F.col(f"{name}.file").alias("_file"), F.col(f"{name}.row").alias("_row"), F.col("n").cast("byte").alias("_n"))
        .groupBy("_file", F.expr(f"_row div {CHUNK}").alias("_chunk"))
        .agg(F.sort_array(F.collect_list(F.struct("_row", "_n")))["_n"].alias("_counts")),
        "row-counts",
    )
    total = chunks.agg(F.sum(F.size("_counts"))).first()[0] or 0
    waves, most = max(1, -(-total // sent_rows)), total
    while most > sent_rows:
        wave = F.pmod(F.xxhash64("_file"), F.lit(waves))
        most, files = chunks.groupBy(wave.alias("w")).agg(F.sum(F.size("_counts")).alias("rows"), F.count_distinct("_file").alias("files")).agg(F.max("rows"), F.max_by("files", "rows")).first()
        if files == 1:
            break
        if most > sent_rows:
            waves *= 2
    file, row = F.col(f"{name}.file"), F.col(f"{name}.row")
    kept = F.struct(*[F.col(f"`{c}`") for c in placed.columns if c != name]).alias("doc")
    out = []
    for w in range(waves):
        of = lambda path: F.lit(True) if waves == 1 else F.pmod(F.xxhash64(path), F.lit(waves)) == w  # noqa: B023, E731
        side = chunks.where(of("_file"))
        rows = placed.where(of(file)).select(kept, file.alias("_file"), F.expr(f"{name}.row div {CHUNK}").alias("_chunk"), (row % CHUNK + 1).cast("int").alias("_at"))
        sent = F.broadcast(side) if most <= sent_rows else side
        out.append(rows.join(sent, ["_file", "_chunk"]).select("doc", F.element_at("_counts", F.col("_at")).alias("n")))
    found = reduce(DataFrame.unionByName, out).where("n > 0")
    return found.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("doc.*")
