"""TIFF media columns: pages of image files, written and read without an imaging library."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import cut, slices

#: Tags of the TIFF 6.0 specification (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
#: A private tag: bytes of the document in the samples, on the first page.
DOCUMENT_BYTES = 65000
#: Field types: bytes each and the struct code (fixed values).
FIELDS = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: The most bytes that a stored byte can stand for: runs of 128 in 2 bytes, LZW entries of under 4096 in 9 bits or more, deflate's longest matches.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 3641, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Bytes that a binary column holds.
MOST_BYTES = 2**31 - 16
SIDE = 64
PAGE_ROWS = 4096
STRIP = 1024


def unpack_bits(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Runs and literals, until ``need`` bytes are there."""
    out, k = bytearray(), 0
    while k < len(data) and len(out) < need:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


def unpack_lzw(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early; ends at ``need`` bytes."""
    table: list[bytes] = []
    out, held, bits, size, last, got = [], 0, 0, 9, b"", 0
    for byte in data:
        if got >= need:
            break
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits & ((1 << size) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        got += len(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpack(data: bytes, how: int, need: int) -> bytes:
    """The first ``need`` bytes of what is stored; no more is ever unpacked."""
    if how == NONE:
        return data
    if how == LZW:
        return unpack_lzw(data, need)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need)
    return unpack_bits(data, need)


@dataclass
class Page:
    """One image: samples as (rows, columns, samples), and the tags of its directory."""

    pixels: np.ndarray
    tags: dict[int, tuple]


def _block(data: bytes, rows: int, columns: int, samples: int, kind: np.dtype, predictor: int, how: int) -> np.ndarray:
    need = rows * columns * samples * kind.itemsize
    raw = _unpack(data, how, need)
    if len(raw) < need:
        raise ValueError("strip or tile is too short")
    block = np.frombuffer(raw[:need], kind).reshape(rows, columns, samples)
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    if predictor != 1:
        raise ValueError(f"predictor {predictor}")
    return block.astype(kind.newbyteorder("="))


def read_pages(data: bytes) -> Iterator[Page]:
    """Walk the image directories of a file; 8- and 16-bit samples, strips or tiles, chunky or planar.

    Stated sizes are not trusted: an image without pixels, one larger than a binary column
    holds, and one that its stored bytes cannot unpack to, are errors before any memory
    is taken; unpacking stops at the size stated.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a cycle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in FIELDS:
                continue
            size, code = FIELDS[kind]
            where = at + 10 + 12 * k
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, samples, how, predictor = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
        if one(BITS, 1) not in (8, 16):
            raise ValueError(f"{one(BITS, 1)} bits a sample")
        if how not in EXPANSION:
            raise ValueError(f"compression {how}")
        if min(width, height, samples) < 1:
            raise ValueError(f"an image of {width} by {height} with {samples} samples")
        kind = np.dtype(f"{order}u{one(BITS, 1) // 8}")
        planes, each = (samples, 1) if one(PLANAR, 1) == 2 else (1, samples)
        if TILE_OFFSETS in tags:
            high, wide, offsets, sizes = one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0), tags[TILE_OFFSETS], tags[TILE_BYTES]
        else:
            high, wide, offsets, sizes = min(one(STRIP_ROWS, height), height), width, tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
        if min(high, wide) < 1:
            raise ValueError("strips or tiles without rows or columns")
        across, down = -(-width // wide), -(-height // high)
        blocks = across * down * planes
        if min(len(offsets), len(sizes)) < blocks:
            raise ValueError("strips or tiles are missing")
        if min(*offsets, *sizes, 0) < 0:
            raise ValueError("a strip or tile before the file")
        # before anything is allocated: what the file states must fit into a column, and be within reach of what it stores
        stored = sum(max(0, min(sizes[k], len(data) - offsets[k])) for k in range(blocks))
        need = width * height * samples * kind.itemsize
        if need > MOST_BYTES or need > stored * EXPANSION[how] or high * wide * each * kind.itemsize > MOST_BYTES:
            raise ValueError(f"an image of {width} by {height} in {stored} bytes")
        pixels = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k in range(across * down * planes):
            plane, rest = divmod(k, across * down)
            top, left = rest // across * high, rest % across * wide
            rows = high if TILE_OFFSETS in tags else min(high, height - top)
            block = _block(data[offsets[k] : offsets[k] + sizes[k]], rows, wide, each, kind, predictor, how)
            pixels[top : top + high, left : left + wide, plane * each : plane * each + each] = block[: height - top, : width - left]
        yield Page(pixels, tags)


def write_pages(samples: bytes, document_bytes: int) -> bytes:
    """8-bit gray pages, 64 columns wide, of deflated strips with the horizontal predictor."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, SIDE)
    out, links = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(pixels), PAGE_ROWS):
        page = pixels[top : top + PAGE_ROWS]
        ahead = np.diff(page, axis=1, prepend=np.zeros((len(page), 1), np.uint8))
        offsets, sizes = [], []
        for k in range(0, len(page), STRIP):
            strip = zlib.compress(ahead[k : k + STRIP].tobytes(), 1)
            offsets.append(len(out))
            sizes.append(len(strip))
            out += strip + b"\0" * (len(strip) % 2)
        many = {}
        for tag, values in ((STRIP_OFFSETS, offsets), (STRIP_BYTES, sizes)):
            many[tag] = values[0] if len(values) == 1 else len(out)
            if len(values) > 1:
                out += struct.pack(f"<{len(values)}I", *values)
        rows = [(WIDTH, 4, 1, SIDE), (HEIGHT, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, DEFLATE), (PHOTOMETRIC, 3, 1, 1),
                (STRIP_OFFSETS, 4, len(offsets), many[STRIP_OFFSETS]), (SAMPLES, 3, 1, 1), (STRIP_ROWS, 4, 1, STRIP), (STRIP_BYTES, 4, len(sizes), many[STRIP_BYTES]), (PREDICTOR, 3, 1, 2)]
        rows += [(DOCUMENT_BYTES, 4, 1, document_bytes)] * (top == 0)
        out[links : links + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(rows)) + b"".join(struct.pack("<HHII", *r) for r in rows) + b"\0\0\0\0"
        links = len(out) - 4
    return bytes(out)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes with zero bytes up to a positive multiple of 64, and how many are the text's."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % 64 or 64 * (not data)), len(data)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as TIFF files: ``id_col, media``. Null counts as empty; rows stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = cut(batch, lo, hi)
                media = pa.array([write_pages(*text_payload(t)) for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), media], ["id", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, media binary").withColumnRenamed("id", id_col)


def decode_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: ``id_col, page, width, height, samples, bits, pixels, error``.

    Pixels are the samples in row order, little-endian. A null, empty or broken file gives
    one row with ``error`` and nothing else, after the pages read before the fault.
    Repeated rows are decoded each; other columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "page", "width", "height", "samples", "bits", "pixels", "error"]
        kinds = [pa.int32()] * 5 + [pa.binary(), pa.string()]
        for batch in batches:
            for lo, hi in slices(batch, "media"):
                part = cut(batch, lo, hi)
                row, out = [], []
                for k, data in enumerate(part.column("media").to_pylist()):
                    page = 0
                    try:
                        for page, found in enumerate(read_pages(data or b"")):
                            px = found.pixels
                            out.append((page, px.shape[1], px.shape[0], px.shape[2], px.itemsize * 8, px.astype(px.dtype.newbyteorder("<")).tobytes(), None))
                            row.append(k)
                    except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as fault:
                        out.append((None, None, None, None, None, None, str(fault) or type(fault).__name__))
                        row.append(k)
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row, pa.int64())), *columns], names)

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, page int, width int, height int, samples int, bits int, pixels binary, error string"
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def _features(pages: list[Page]) -> str:
    """Pages, columns by rows, mean sample and an eight-bin histogram."""
    flat = np.concatenate([p.pixels.ravel() for p in pages])
    bins = np.bincount(flat >> 5, minlength=8)
    return f"{len(pages)};{pages[0].pixels.shape[1]}x{sum(p.pixels.shape[0] for p in pages)};{flat.mean():.6f};" + ",".join(map(str, bins.tolist()))


def digest_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored files hold, read back page by page: sizes, hashes and features of each document's samples.

    All pages of a file lie in its row, so nothing is shuffled. Files are those of
    ``encode_texts``; a null file gives nulls.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch, "media"):
                part, out = cut(batch, lo, hi), []
                for data in part.column("media").to_pylist():
                    if data is None:
                        out.append((None,) * 7)
                        continue
                    pages = list(read_pages(data))
                    payload = b"".join(p.pixels.tobytes() for p in pages)
                    out.append((pages[0].tags[DOCUMENT_BYTES][0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), _features(pages)))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_col)
