"""Token ids in binary shards with a minimal perfect hash index.

A shard is one row of a Parquet table: the ids of its documents back to back, and an
index from a document's key to its records by hash and displace. The index holds a
displacement per bucket of keys and, per slot, a fingerprint and the number of the
key's first record; a key is found in constant time, and an absent key is told by its
fingerprint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sievemark.llm.arrow_text import cut, slices
from sievemark.llm.piece_ids import SLICE, encoder
from sievemark.session import width

_U = np.uint64
#: Documents of a shard, and bytes of their ids, at most (a longer document has a shard to itself).
PER_SHARD, SHARD_BYTES = 5_000, 32 << 20
SHARD = "range int, nth int, n_ids long, item int, least long, greatest long, keys binary, nulls binary, displacements binary, fingerprints binary, first binary, starts binary, payload binary"


def _hash(keys: np.ndarray, nulls: np.ndarray, salt: int) -> np.ndarray:
    x = keys.astype(np.int64).view(_U) + _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return np.where(nulls, ~x, x)


def _slots(hashes: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    x = hashes ^ (np.asarray(displacement).astype(_U) * _U(0xD6E8FEB86659FD93))
    x = (x ^ (x >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> _U(29))) % _U(n)).astype(np.int64)


def build_index(keys: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Displacements per bucket, the slot of each of the distinct keys, and fingerprints per slot.

    Buckets of about four keys, largest first, take the first displacement at which their
    keys meet free slots; a bucket of one key takes a free slot outright, written as a
    negative number. Every slot is used.
    """
    n = len(keys)
    buckets = max(1, n // 4)
    hashes = _hash(keys, nulls, 1)
    of = (_hash(keys, nulls, 2) % _U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    sizes = np.diff(bounds)
    free, displacements, slots = np.ones(n, bool), np.zeros(buckets, np.int64), np.zeros(n, np.int64)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[bounds[b] : bounds[b + 1]]
        if len(own) < 2:
            break
        d = 1
        while True:
            tried = _slots(hashes[own][:, None], np.arange(d, d + 64)[None, :], n)
            good = free[tried].all(axis=0)
            for k in np.flatnonzero(good):
                if len(set(tried[:, k].tolist())) == len(own):
                    break
            else:
                d += 64
                continue
            displacements[b], slots[own] = d + k, tried[:, k]
            free[tried[:, k]] = False
            break
    left = iter(np.flatnonzero(free))
    for b in np.flatnonzero(sizes == 1):
        own = order[bounds[b]]
        slots[own] = next(left)
        displacements[b] = -slots[own] - 1
    fingerprints = np.zeros(n, np.uint32)
    fingerprints[slots] = (_hash(keys, nulls, 3) & _U(0xFFFFFFFF)).astype(np.uint32)
    return displacements, slots, fingerprints


class Shard:
    """Keyed access to one shard row."""

    def __init__(self, row: dict):
        self.displacements = np.frombuffer(row["displacements"], np.int64)
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint32)
        self.first = np.frombuffer(row["first"], np.int64).reshape(-1, 2)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.ids = np.frombuffer(row["payload"], f"<u{row['item']}")
        self.keys = np.frombuffer(row.get("keys") or b"", np.int64)

    def find(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """Per key the slot that holds it, or -1."""
        if not len(self.fingerprints):
            return np.full(len(keys), -1)
        d = self.displacements[(_hash(keys, nulls, 2) % _U(len(self.displacements))).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, _slots(_hash(keys, nulls, 1), np.maximum(d, 0), len(self.fingerprints)))
        same = self.fingerprints[slots] == (_hash(keys, nulls, 3) & _U(0xFFFFFFFF)).astype(np.uint32)
        return np.where(same, slots, -1)

    def holds(self, slot: int, key: int) -> bool:
        """Whether the stored key is the one asked for; a fingerprint alone errs once in 2**32."""
        at = np.searchsorted(self.keys, key)
        return at < len(self.keys) and int(self.keys[at]) == key

    def records(self, slot: int) -> list[tuple[int, np.ndarray]]:
        """Start in the shard and ids of each record under the key at ``slot``."""
        first, n = self.first[slot]
        return [(int(self.starts[r]), self.ids[self.starts[r] : self.starts[r + 1]]) for r in range(first, first + n)]


def _encoded(path: str, end_id: int, edges: np.ndarray):
    """Ids of each text, and the range of its key; a key that fills several ranges is dealt over them, null keys over as many more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], own.kind).tobytes()
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE):
                part = cut(batch, lo, hi)
                keys = np.asarray(part.column("id").fill_null(0)).astype(np.int64)
                deal = np.asarray(part.column("deal")).view(_U)
                first, last = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
                at = last - (deal % np.maximum(last - first, 1).astype(_U)).astype(np.int64)
                spare = len(edges) + 1 + (deal % _U(len(edges) + 1)).astype(np.int64)
                at = np.where(np.asarray(part.column("id").is_null()), spare, at)
                ids = pa.array([x.tobytes() + end for x in own.encode_all(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), part.column("id"), ids], ["range", "id", "ids"])

    return run


def _shard(place: int, nth: int, ids: list[int | None], records: list[bytes], item: int) -> pa.RecordBatch:
    """One shard row of records in the order of their keys."""
    nulls = np.array([k is None for k in ids])
    keys = np.array([k or 0 for k in ids], np.int64)
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]))
    displacements, slots, fingerprints = build_index(keys[at], nulls[at])
    first = np.zeros((len(at), 2), np.int64)
    first[slots] = np.stack([at, np.diff(np.append(at, len(keys)))], axis=1)
    starts = np.concatenate([[0], np.cumsum([len(x) // item for x in records])]).astype(np.int64)
    known = keys[~nulls]
    ends = (int(known.min()), int(known.max())) if len(known) else (None, None)
    row = [place, nth, int(starts[-1]), item, *ends, keys[at].tobytes(), nulls[at].tobytes(), displacements.tobytes(), fingerprints.tobytes(), first.tobytes(), starts.tobytes(), b"".join(records)]
    names = [f.split()[0] for f in SHARD.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names)


def _packed(item: int):
    """Shards of sorted records, written as they fill, so that a task holds one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth, keys, records, held = None, 0, [], [], 0
        for batch in batches:
            for at, key, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "id", "ids")), strict=True):
                if records and (at != place or len(records) == PER_SHARD or held + len(ids) > SHARD_BYTES):
                    yield _shard(place, nth, keys, records, item)
                    nth = nth + 1 if at == place else 0
                    keys, records, held = [], [], 0
                place = at
                keys.append(key)
                records.append(ids)
                held += len(ids)
        if records:
            yield _shard(place, nth, keys, records, item)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, ``end_id`` after each, into a table of shards at ``path``.

    Files, and shards in them, lie in the order of ``range`` and ``nth``: ids ascend, null ids come last. A
    null or empty text is the end id alone. Rows with equal ids are kept each; an id that
    fills several ranges, and null ids, are dealt over as many, and each shard has its own
    key for them, so no id is gathered in one task. Other columns are ignored; an empty
    table gives a table without rows. Ids must be whole numbers: a column of another
    type is refused.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    parts = width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    ranges = 4 * parts  # more than tasks, so that tasks are alike
    edges = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null").approxQuantile("id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
    edges = np.sort(np.array(edges, float)).astype(np.int64)
    item = encoder(tokenizer).kind.itemsize
    encoded = rows.mapInArrow(_encoded(tokenizer, end_id, edges), "range int, id long, ids binary")
    # four ranges a task, in order, those of null ids after the others, so that files lie in the order of ids
    dealt = encoded.repartitionById(2 * parts, F.expr("cast(range div 4 as int)"))
    shards = dealt.sortWithinPartitions("range", "id", "ids").mapInArrow(_packed(item), SHARD)
    shards.write.mode("overwrite").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            keys, nulls = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool)
            out = []
            for key, null, slot in zip(keys.tolist(), nulls.tolist(), shard.find(keys, nulls).tolist(), strict=True):
                out += [(None if null else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for start, ids in shard.records(slot)]
            ids, start, n, crc = zip(*out, strict=True) if out else ([], [], [], [])
            place = [pa.array(np.full(len(out), row[c], np.int32)) for c in ("range", "nth")]
            yield pa.RecordBatch.from_arrays([*place, *(pa.array(x, pa.int64()) for x in (ids, start, n, crc))], ["range", "nth", "id", "start", "n_tokens", "ids_crc32"])


def _bases(shards: DataFrame) -> DataFrame:
    """``range, nth, base``: the ids before each shard, from sums within its range and of the ranges before it (as many as were dealt)."""
    inside = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("range", "nth", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = sizes.withColumn("within", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return within.join(ranges, "range").select("range", "nth", (F.col("ahead") + F.col("within")).cast("long").alias("base"))


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every record of the shards at ``path``, each through its shard's index: ``id_col, start, n_tokens, ids_crc32``.

    Payloads are read where they lie; only the numbers of each record meet their shard's base.
    """
    shards = spark.read.parquet(path)
    found = shards.mapInArrow(_read, "range int, nth int, id long, start long, n_tokens long, ids_crc32 long").join(_bases(shards), ["range", "nth"])
    return found.select(F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _probe(table: pa.Table) -> pa.Table:
    """The ids of asked keys from one shard: the row with a payload, beside rows with a key."""
    shard = Shard(next(r for r in table.to_pylist() if r["payload"] is not None))
    keys = np.unique(np.asarray(table.column("key").drop_null()))
    out = [(key, start, ids.tolist()) for key, slot in zip(keys.tolist(), shard.find(keys, np.zeros(len(keys), bool)).tolist(), strict=True) if slot >= 0 for start, ids in shard.records(slot) if shard.holds(slot, key)]
    return pa.table({"key": pa.array([x[0] for x in out], pa.int64()), "start": pa.array([x[1] for x in out], pa.int64()), "ids": pa.array([x[2] for x in out], pa.list_(pa.int64()))})


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The token ids of the documents asked for: ``id_col, start, ids``, one row per record of an asked key.

    ``keys`` has a column ``id_col``. Shards of null keys and those whose range of keys
    holds none asked for are not read beyond their ends; in the others the index is
    probed, in constant time a key, and the stored key confirms what its fingerprint
    says. Absent keys give no row; null keys are never found; asked twice is asked once.
    """
    spark = keys.sparkSession
    shards = spark.read.parquet(path)
    asked = keys.select(F.col(id_col).cast("long").alias("key")).where("key is not null").distinct()
    ends = shards.where("least is not null").select("range", "nth", "least", "greatest")
    # the ranges of keys follow each other, so a key meets few shards; Spark compares ends alone
    meets = asked.join(ends, (asked["key"] >= ends["least"]) & (asked["key"] <= ends["greatest"])).select("range", "nth", "key")
    names = ["displacements", "fingerprints", "first", "starts", "payload", "keys", "item"]
    bare = [F.lit(None).cast(shards.schema[c].dataType).alias(c) for c in names]
    hit = shards.join(meets.select("range", "nth").distinct(), ["range", "nth"], "left_semi")
    both = hit.select("range", "nth", F.lit(None).cast("long").alias("key"), *names).unionByName(meets.select("range", "nth", "key", *bare))
    return both.groupBy("range", "nth").applyInArrow(_probe, "key long, start long, ids array<long>").withColumnRenamed("key", id_col)
