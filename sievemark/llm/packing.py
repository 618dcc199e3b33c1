"""Best-fit packing by bin completion with branch and bound.

Sequences are planned over the counts of lengths (as many entries as a sequence has
tokens, however many documents there are); Spark then ranks the pieces of each length
and puts each in its planned place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import alone, cut, slices
from sievemark.llm.piece_ids import SLICE, encoder
from sievemark.session import materialize, width

#: A plan: per kind of sequence, how many there are and the lengths in it, largest first.
Plan = list[tuple[int, list[int]]]


def _completion(counts: list[int], room: int, nodes: int) -> list[int]:
    """The filling of ``room`` with the least waste, from the lengths left in ``counts``.

    Depth first, largest length first, a run of one length per step, so that the first
    leaf is the best-fit filling and the incumbent. A branch ends when it cannot beat the
    incumbent's waste: it is full, or all that is left and not longer would not do.
    ``nodes`` bounds the steps after the first leaf, which is always reached; the
    incumbent stands when it runs out.
    """
    below, within = [0] * (room + 1), [0] * (room + 1)  # the largest length left that is not above r; tokens of lengths up to r
    for r in range(1, room + 1):
        below[r] = r if counts[r] else below[r - 1]
        within[r] = within[r - 1] + r * counts[r]
    best, waste, used, left = [], room + 1, [], nodes

    def walk(room: int, top: int) -> None:
        nonlocal best, waste, left
        if room < waste:
            best, waste = used[:], room
        length = below[min(room, top)]
        while length and room - within[length] < waste:
            for n in range(min(counts[length], room // length), 0, -1):
                used.append((length, n))
                walk(room - n * length, length - 1)
                used.pop()
                left -= 1
                if not waste or left <= 0:
                    return
            length = below[length - 1]

    walk(room, room)
    return [length for length, n in best for _ in range(n)]


def _best_fit(counts: list[int], size: int) -> Plan:
    """Best-fit decreasing over counts, a run of one length per step: the solution to beat."""
    left, free, plan = counts[:], {}, []
    for length in range(size, 0, -1):
        n = left[length]
        while n:
            room = min((r for r in free if r >= length), default=size)
            groups = free.get(room, [])
            k, lengths = groups.pop() if groups else (n, [])
            if room in free and not groups:
                del free[room]
            each = min(n, room // length)
            full = min(k, n // each)
            rest = min(n - full * each, each) if full < k else 0
            for times, held in ((full, each), (1 if rest else 0, rest)):
                if times:
                    free.setdefault(room - held * length, []).append((times, lengths + [length] * held))
            over = k - full - (1 if rest else 0)
            if over and lengths:
                free.setdefault(room, []).append((over, lengths))
            n -= full * each + rest
    for groups in free.values():
        plan += groups
    return plan


def _dominates(one: list[int], other: list[int], tries: int = 200) -> bool:
    """Whether the lengths of ``other`` can be put, whole, into those of ``one`` as if these were bins.

    Then any plan with ``other`` has one as good with ``one``. False when ``tries`` runs
    out, which keeps a filling that could have been left out.
    """
    mine, theirs = Counter(one), Counter(other)
    bins = sorted((mine - theirs).elements())
    items = sorted((theirs - mine).elements(), reverse=True)
    if sum(bins) < sum(items):
        return False

    def put(k: int) -> bool:
        nonlocal tries
        if k == len(items):
            return True
        tries -= 1
        for room in sorted(set(bins)):
            if room >= items[k] and tries > 0:
                at = bins.index(room)
                bins[at] -= items[k]
                if put(k + 1):
                    return True
                bins[at] = room
        return False

    return len(items) < 200 and put(0)


def _fillings(counts: list[int], room: int, nodes: int) -> tuple[list[list[int]], bool]:
    """The undominated fillings of ``room``, least waste first; of those met in ``nodes`` steps, and whether these were all."""
    below = [0] * (room + 1)
    for r in range(1, room + 1):
        below[r] = r if counts[r] else below[r - 1]
    found, used, left = [], [], nodes

    def walk(room: int, top: int) -> None:
        nonlocal left
        length = below[min(room, top)]
        if not length:
            held, x = dict(used), below[room]
            while x and held.get(x, 0) == counts[x]:
                x = below[x - 1]
            if not x:  # nothing left fits
                found.append((room, [x for x, n in used for _ in range(n)]))
            return
        while length:
            for n in range(min(counts[length], room // length), 0, -1):
                used.append((length, n))
                walk(room - n * length, length - 1)
                used.pop()
                left -= 1
                if left <= 0:
                    return
            length = below[length - 1]

    walk(room, room)
    kept: list[list[int]] = []
    for _, lengths in sorted(found, key=lambda x: x[0]):
        if not any(_dominates(x, lengths) for x in kept[:16]):
            kept.append(lengths)
    return kept, left > 0


def _bound(counts: list[int], size: int) -> int:
    """Sequences that any plan needs: by the sum of lengths, and by lengths that cannot share (Martello and Toth)."""
    n = np.array(counts, np.int64)
    many, total = np.cumsum(n), np.cumsum(n * np.arange(size + 1))
    half, k = size // 2, np.arange(size // 2 + 1)
    alone = many[size] - many[size - k]
    large = many[size - k] - many[half]
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    over = small + (total[size - k] - total[half]) - large * size
    return int((alone + large + np.maximum(0, -(-over // size))).max())


def plan_sequences(histogram: dict[int, int], size: int, nodes: int = 400, branches: int = 500) -> Plan:
    """The plan of ``search_plan``."""
    return search_plan(histogram, size, nodes, branches)[0]


def search_plan(histogram: dict[int, int], size: int, nodes: int = 400, branches: int = 500) -> tuple[Plan, int, bool]:
    """Pack by bin completion: branch and bound over the fillings of the largest length left.

    The best-fit plan is the first incumbent. A branch takes one filling as often as its
    lengths last, so a plan has a few entries per length; then come the other undominated
    fillings, then all again fewer times. A branch ends when the sequences used and the
    lower bound of what is left (``_bound``) do not beat the incumbent; the search ends
    when the incumbent meets the lower bound of the whole.

    The problem is NP-hard, so the search is bounded: ``nodes`` steps per filling and
    ``branches`` steps after the first descent, which is never cut. Returns the plan, the
    lower bound of the whole, and whether the plan is proven to be optimal: it meets the
    bound, or the search ended within its limits. Otherwise it is the best one found.
    """
    counts = [0] * (size + 1)
    for length, n in histogram.items():
        counts[length] = int(n)
    best = _best_fit(counts, size)
    fewest, bound, whole = sum(k for k, _ in best), _bound(counts, size), True

    def most(lengths: list[int]) -> int:
        return min(counts[x] // n for x, n in Counter(lengths).items())

    def choices(length: int) -> Iterator[tuple[int, list[int]]]:
        nonlocal whole
        counts[length] -= 1
        first = [length, *_completion(counts, size - length, nodes)]
        counts[length] += 1
        yield most(first), first
        counts[length] -= 1
        others, every = _fillings(counts, size - length, nodes)
        counts[length] += 1
        whole, others = whole and every, [[length, *x] for x in others]
        fillings = [(most(x), x) for x in [first, *(x for x in others if x != first)]]
        for less in range(max(n for n, _ in fillings)):
            for n, lengths in fillings:
                if n > less and (less or lengths is not first):
                    yield n - less, lengths

    plan: Plan = []
    path: list[Iterator[tuple[int, list[int]]]] = []
    used, top, descended = 0, size, False
    while fewest > bound:
        while top and not counts[top]:
            top -= 1
        if not top and used < fewest:
            best, fewest = plan[:], used
        elif top and used + _bound(counts, size) < fewest:
            path.append(choices(top))
        taken = None
        while path and not taken:  # the next choice of the deepest branch that has one
            if len(plan) == len(path):
                times, lengths = plan.pop()
                used, descended = used - times, True
                for x in lengths:
                    counts[x] += times
            taken = next(path[-1], None)
            if not taken:
                path.pop()
        if not taken or branches <= 0:
            whole = whole and not taken
            break
        times, lengths = taken
        for x in lengths:
            counts[x] -= times
        plan.append(taken)
        used, top = used + times, size
        branches -= descended
    return best, bound, whole or fewest == bound


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(encoder)
        own = encoder(path)
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE):
                part = cut(batch, lo, hi)
                row, piece, start, length, crc = [], [], [], [], []
                for k, body in enumerate(own.encode_all(part.column("text"))):
                    ids = np.append(body, end_id).astype("<u4")
                    at, n = 0, len(ids) % size or min(size, len(ids))
                    while at < len(ids):
                        row.append(k)
                        piece.append(len(piece) and row[-2:][0] == k and piece[-1] + 1 or 0)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                        at, n = at + n, size
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def _places(plan: Plan) -> dict[int, np.ndarray]:
    """Per length, the plan's rows: rank from, rank to, first sequence, uses in a sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int, int]]] = {}
    base = 0
    for times, lengths in plan:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            uses = lengths.count(x)
            own = rows.setdefault(x, [])
            rank = own[-1][1] if own else 0
            own.append((rank, rank + uses * times, base, uses, at))
            at += uses * x
        base += times
    return {x: np.array(own, np.int64) for x, own in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                own, at = places[int(x)], np.flatnonzero(length == x)
                start, _, base, uses, first = own[np.searchsorted(own[:, 1], rank[at], side="right")].T
                k = rank[at] - start
                sequence[at], offset[at] = base + k // uses, first + k % uses * x
            kept = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack whole texts, as token ids with ``end_id`` after each, into sequences of ``size`` tokens at most.

    Only a text of more than ``size`` ids is cut, into pieces of ``size`` of which the
    first may be shorter. Returns one row per piece: ``id_col, piece, start, length,
    ids_crc32, sequence_id, offset``. A null or empty text is one piece, the end id.
    Repeated rows are packed each; a null id keeps its row; other columns are ignored;
    an empty table gives an empty result. Equal lengths take places in the order of id,
    piece and checksum, so a rerun gives the same plan.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, size, end_id), fields), "pack-pieces")
    counted = pieces.groupBy("length").count().collect()  # `size` rows at most
    places = _places(plan_sequences({r["length"]: r["count"] for r in counted}, size))

    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(4 * width(spark))).cast("int"))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "deal").count().select("length", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "deal").orderBy("id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("nth", F.row_number().over(within)).join(bases, ["length", "deal"])
        .select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    )
    return ranked.mapInArrow(_place(places), f"{fields}, sequence_id long, offset long").withColumnRenamed("id", id_col)
