"""Arrow plumbing shared by the text operators: slices of whole texts, bounded by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

#: The separators of words: U+0020 and U+0009 to U+000D.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Models that workers keep from task to task (functions under ``lru_cache``), entered by the modules that hold them.
MODELS: list = []


#: Gives the C library's spare memory back to the system; only glibc has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def alone(*own) -> None:
    """Drop what a reused worker still holds for other operators: their models, and the spare memory of Arrow and the C library."""
    for model in MODELS:
        if model not in own:
            model.cache_clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold at most ``limit`` bytes (or a single longer text)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    lo, held = 0, 0
    for k, size in enumerate(sizes):
        if k > lo and held + size > limit:
            yield lo, k
            lo, held = k, 0
        held += int(size)
    if lo < len(sizes):
        yield lo, len(sizes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(batch: pa.RecordBatch, lo: int, hi: int) -> pa.RecordBatch:
    return batch.slice(lo, hi - lo)
