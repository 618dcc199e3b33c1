"""Fill-in-middle examples, cut by a sparse index of checkpoints.

One pass counts the units of a text and keeps, every so many units, the unit's number
with its byte and code-point offsets. A cut is found by binary search among the
checkpoints and a short scan from the one below it, so a text of any length needs one
full pass and an index of a small share of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import SEPARATORS, alone, cut, slices

#: The default marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that the counting pass looks at together, and that a scan from a checkpoint begins with.
BLOCK, SCAN = 1 << 16, 1 << 10

_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
#: Whether a byte begins a unit, by itself and the byte before it. The first byte of a text always does.
UNITS = {
    "line": lambda now, before: before == 10,
    "word": lambda now, before: _SPACE[before] & ~_SPACE[now],
    "char": lambda now, before: now & 0xC0 != 0x80,
}


class Checkpoints:
    """Units and code points of one text (UTF-8), with the offsets of every ``every``-th unit."""

    def __init__(self, data: bytes, unit: str = "line", every: int = 64):
        self.data, self.begins, self.units, self.chars = data, UNITS[unit], 0, 0
        self.unit_at, self.byte_at, self.char_at = [], [], []
        for lo in range(0, len(data), BLOCK):
            starts = self._starts(lo, lo + BLOCK)
            kept = starts[-self.units % every :: every]
            heads = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - lo), lo) & 0xC0 != 0x80
            if len(kept):
                before = np.cumsum(heads) - heads
                self.unit_at += range(self.units + -self.units % every, self.units + len(starts), every)
                self.byte_at += (lo + kept).tolist()
                self.char_at += (self.chars + before[kept]).tolist()
            self.units += len(starts)
            self.chars += int(np.count_nonzero(heads))

    def _starts(self, lo: int, hi: int) -> np.ndarray:
        """Where units begin in bytes lo to hi, counted from lo."""
        now = np.frombuffer(self.data, np.uint8, min(hi, len(self.data)) - lo, lo)
        before = np.empty_like(now)
        before[1:], before[0] = now[:-1], self.data[lo - 1] if lo else 10
        starts = self.begins(now, before)
        if not lo:
            starts[0] = True
        return np.flatnonzero(starts)

    def offset(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit; the text's own for the unit after the last."""
        if unit >= self.units:
            return len(self.data), self.chars
        k = bisect.bisect_right(self.unit_at, unit) - 1
        lo, left, span = self.byte_at[k], unit - self.unit_at[k], SCAN
        while len(starts := self._starts(lo, lo + span)) <= left:
            span *= 2
        end = lo + int(starts[left])
        return end, self.char_at[k] + sum(b & 0xC0 != 0x80 for b in self.data[lo:end])


def _draws(seed: int, id_col: str) -> list[Column]:
    """Four unsigned integers of a row, from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _cut(unit: str, every: int, rate: int, spm: int, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def example(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        index = Checkpoints(data, unit, every)
        if not data or h3 % 100 >= rate or p in data or s in data or m in data:
            return index.units, "plain", None, None, data
        one, two = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
        (a, n), (b, upto) = index.offset(one), index.offset(two)
        if h4 % 100 < spm:
            return index.units, "spm", n, upto - n, s + data[b:] + p + data[:a] + m + data[a:b]
        return index.units, "psm", n, upto - n, p + data[:a] + s + data[b:] + m + data[a:b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = cut(batch, lo, hi)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                rows = zip(texts, *(part.column(f"h{k}").to_pylist() for k in range(1, 5)))
                n, form, prefix, middle, output = zip(*(example(t or b"", *h) for t, *h in rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", every: int = 64, seed: int = 7, rate: int = 100, spm: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """One example per row: ``id_col, n, form, prefix_chars, middle_chars, output``.

    A text of n units (``line``, ``word`` with the white space after it, or ``char``) is cut
    before two of them, drawn from the row's id and ``seed``, into prefix, middle and
    suffix. ``rate`` per cent of rows are transformed, ``spm`` per cent of these with the
    suffix first (``spm``), others with the prefix first (``psm``); the rest, texts that
    hold a mark, and null or empty texts (as empty) stay as they are (``plain``, lengths
    null). Lengths count code points. Marks are three different strings from ``<`` to
    ``>`` with neither inside, so none can arise across a cut and ``restored`` is exact.
    Equal ids draw alike, a null id as an empty one; repeated rows give a row each; other
    columns are ignored; an empty table gives an empty result. No shuffle; a task holds a
    megabyte of texts or one longer text, and that text's checkpoints.
    """
    if len(set(marks)) < 3 or any(x[:1] != "<" or x[-1:] != ">" or len(x) < 3 or set(x[1:-1]) & {"<", ">"} for x in marks):
        raise ValueError("marks are three different strings from < to > with neither inside")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_draws(seed, id_col))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_cut(unit, every, rate, spm, marks), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return found.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an example, from its output and form alone; null of either gives null."""
    p, s, m = marks
    after = lambda mark: F.substring(output, F.lit(len(mark) + 1), F.length(output))
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(after(p), s, 1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(after(s), p, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digest_examples(examples: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each example of ``fill_in_middle``, and hashes of its output and of the text rebuilt from it."""
    return examples.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
