"""Exact top-k search by the three-phase uniform threshold.

A vector's score against a query is the sum of its parts over blocks of dimensions; the
parts of one block are a list. Phase one gathers from each list its highest parts and
sums their vectors; the k-th best of these sums is the bar, bar / number of lists the
cutoff. Phase two collects what can be sufficient: a group of vectors none of whose
parts can reach the cutoff is not computed, and of the rest only pairs whose known parts,
and the most that the last list can add, reach the bar go on. Phase three resolves those
pairs exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import materialize, shared_dir

#: Bytes of queries sent to all tasks at once; queries and vectors computed together; blocks of dimensions (lists).
QUERY_BYTES = 1 << 24
QUERY_ROWS, VECTOR_ROWS = 1024, 2048
LISTS = 4
#: Sums are held between these ends; the lower one also stands for "no bar".
_MOST = 2**62
#: Bounds are raised by this share of the product of both lengths, far above what rounding can take away.
_SLACK = 1e-9


def _usable(vec: str):
    return F.expr(f"{vec} is not null and not exists({vec}, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def _matrix(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), VECTOR_ROWS):
            part = batch.slice(lo, VECTOR_ROWS)
            yield np.asarray(part.column("id")), _matrix(part.column("v"))


def _sums(q: np.ndarray, v: np.ndarray, qi: np.ndarray, vj: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs ``(qi, vj)``, held between the ends."""
    out, step = np.zeros(len(qi), np.int64), max(1, (1 << 20) // max(1, q.shape[1]))
    small = not q.size or not v.size or float(np.abs(q.astype(float)).max()) * float(np.abs(v.astype(float)).max()) * q.shape[1] < 2**62
    for a in range(0, len(qi), step):
        x, y = q[qi[a : a + step]], v[vj[a : a + step]]
        if small:
            out[a : a + step] = np.einsum("ij,ij->i", x, y)
        else:
            out[a : a + step] = [max(-_MOST, min(_MOST, s)) for s in (x.astype(object) * y.astype(object)).sum(axis=1)]
    return out


class _Best:
    """The k best (score, vector) of each query so far, ties to the smaller vector."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.q, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(n, -_MOST, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.zeros(len(self.kth), bool)
        touched[q] = True
        old = touched[self.q]
        q, score, vec = np.append(self.q[old], q), np.append(self.score[old], score), np.append(self.vec[old], vec)
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[q[last]] = score[last]
        self.q, self.score, self.vec = (np.append(was[~old], now[keep]) for was, now in ((self.q, q), (self.score, score), (self.vec, vec)))


def _edges(dim: int, lists: int) -> np.ndarray:
    return np.linspace(0, dim, lists + 1).astype(int)


def _bars(ids: np.ndarray, queries: np.ndarray, k: int, lists: int):
    """Phase one in a task: per query, the k best sums of the vectors that head its lists.

    All parts of a vector lie in its row, so a head is summed at once; the query itself
    does not count, and a vector that heads several lists counts once.
    """
    edges = _edges(queries.shape[1], lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for vec, matrix in _grouped(batches):
            v = matrix.astype(np.float64)
            for lo in range(0, len(ids), QUERY_ROWS):
                q = queries[lo : lo + QUERY_ROWS].astype(np.float64)
                heads = np.zeros((len(q), len(vec)), bool)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    top = np.argpartition(-(q[:, a:b] @ v[:, a:b].T), min(k, len(vec) - 1), axis=1)[:, : k + 1]
                    np.put_along_axis(heads, top, True, axis=1)
                heads &= vec[None, :] != ids[lo : lo + QUERY_ROWS, None]
                qi, vj = np.nonzero(heads)
                total = _sums(queries, matrix, qi + lo, vj)
                high = total >= best.kth[qi + lo]
                best.add(qi[high] + lo, total[high], vec[vj[high]])
        yield pa.RecordBatch.from_arrays([pa.array(best.q.astype(np.int32)), pa.array(best.score)], ["q", "score"])

    return run


def _answers(ids: np.ndarray, queries: np.ndarray, bars: np.ndarray, k: int, lists: int):
    """Phases two and three in a task: pairs that can reach the bar, then their exact sums; k of a query at most."""
    edges = _edges(queries.shape[1], lists)
    cut = edges[-2]

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(x[:, a:b], axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), k)
        for vec, matrix in _grouped(batches):
            v = matrix.astype(np.float64)
            v_len = lengths(v)
            v_all = np.linalg.norm(v, axis=1)
            known_v = np.column_stack([v[:, :cut], v_len[:, -1], v_all])
            for lo in range(0, len(ids), QUERY_ROWS):
                q = queries[lo : lo + QUERY_ROWS].astype(np.float64)
                q_len, q_all = lengths(q), np.linalg.norm(q, axis=1)
                bar = np.maximum(bars, best.kth)[lo : lo + QUERY_ROWS]
                none = bar == -_MOST
                reach = (q_len * v_len.max(axis=0)).max(axis=1) + _SLACK * q_all * v_all.max()  # the most that a part of the group can be
                at = np.flatnonzero(none | (reach >= bar / lists))
                bound = np.column_stack([q[at, :cut], q_len[at, -1], _SLACK * q_all[at]]) @ known_v.T
                open_ = (bound >= bar[at, None].astype(np.float64)) | none[at, None]
                open_ &= vec[None, :] != ids[lo : lo + QUERY_ROWS][at, None]
                qi, vj = np.nonzero(open_)
                qi = at[qi] + lo
                total = _sums(queries, matrix, qi, vj)
                high = total >= bar[qi - lo]
                best.add(qi[high], total[high], vec[vj[high]])
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.vec), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, lists: int = LISTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest integer inner products of each query over all vectors but its own id.

    Components become floor(scale * x). Ties go to the smaller id; ranks start at 1.
    Vectors that are null, or hold a null or non-finite component, or have a null id, take
    no part; vectors meet only queries of their own dimension. Repeated ids are candidates
    each; a query id that repeats is asked once, with its first vector in array order.
    Sums beyond 2^62 are held there. Empty tables give an empty result.

    Queries go in blocks of ``query_bytes``, each in two passes over all rows, so what is
    sent to the tasks is bounded, and a task returns k rows of a query at most. Answers of
    a block are added to one table before the next begins.
    """
    spark = vectors.sparkSession
    scaled = lambda df: df.where(_usable(vec_col)).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(scale)).cast("double"), F.lit(-9.0e18)), F.lit(9.0e18)).cast("long")).alias("v"),
    )
    data = materialize(scaled(vectors), "topk-vectors")
    asked = materialize(scaled(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 20))), "topk-queries")
    result = "query_id long, rank int, vec_id long, score long"
    path = f"{shared_dir(spark)}/topk-answers-{uuid.uuid4().hex}"
    spark.createDataFrame([], result).write.parquet(path)
    for dim, n in sorted(asked.groupBy("dim").count().collect()):
        own, here = asked.where(F.col("dim") == dim), data.where(F.size("v") == dim)
        blocks = -(-n * max(1, dim) * 8 // query_bytes)
        for b in range(blocks):
            held = own.where((F.col("block") * blocks >= F.lit(b << 20)) & (F.col("block") * blocks < F.lit((b + 1) << 20))).select("id", "v").toArrow()
            if not held.num_rows:
                continue
            ids, matrix = np.asarray(held.column("id")), _matrix(held.column("v").combine_chunks())
            proven = here.mapInArrow(_bars(ids, matrix, k, lists), "q int, score long")
            best = Window.partitionBy("q").orderBy(F.desc("score"))
            kth = proven.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("q", "score").toArrow()  # one row a query
            bars = np.full(len(ids), -_MOST, np.int64)
            bars[np.asarray(kth.column("q"))] = np.asarray(kth.column("score"))
            answers = here.mapInArrow(_answers(ids, matrix, bars, k, lists), "query_id long, vec_id long, score long")
            ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            answers.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
