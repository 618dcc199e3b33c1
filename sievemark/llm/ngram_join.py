"""N-gram Jaccard join by vertical partitioning.

The n-grams of all texts have one global order, rare ones first. The order is cut
into fragments; the part of a text's set that falls into a fragment is a segment.
Overlaps are counted segment by segment and summed per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import alone, cut, slices, utf8
from sievemark.operators.components import connected_components
from sievemark.session import Scratch, materialize, width

#: Bits of an n-gram's token, and of a token plus the octave of its frequency (a rank in the global order).
TOKEN_BITS = 48
#: A fragment of the global order is a quarter of an octave.
FRAGMENT_SHIFT = TOKEN_BITS - 2
#: Bytes of texts whose n-grams are hashed at once; arrays on the way hold 50 times as many.
AT_ONCE = 1 << 18
#: Sets and tokens of a block whose links are counted, and columns of its dense part.
BLOCK_SETS, BLOCK_TOKENS, TOKENS_AT_ONCE = 256, 1 << 18, 8192

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
for _c in range(65, 91):  # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, _U)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its word n-grams (see ``ngram_components``)."""
    data, offsets = utf8(column)
    full = ~_BLANK[data]
    before = np.concatenate([[False], full[:-1]]) if len(full) else full
    after = np.concatenate([full[1:], [False]]) if len(full) else full
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=_U)])
    words = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
    coefficients = np.random.Generator(np.random.PCG64(n)).integers(1, 2**63, n, dtype=_U) * _U(2) + _U(1)
    grams = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n):
        grams += words[k : k + len(grams)] * coefficients[k]
    grams = _mix(grams)
    bounds = np.searchsorted(starts, offsets)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            x = np.sort(grams[lo : hi - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif hi > lo:
            out.append(_mix(np.array([(int((words[lo:hi] * coefficients[: hi - lo]).sum(dtype=_U)) + int(hi - lo)) & (2**64 - 1)], _U)))
        else:
            out.append(grams[:0])
    return out


def _signature(grams: np.ndarray) -> int:
    """A 64-bit name of the whole set."""
    x = np.array([int(_mix(grams).sum(dtype=_U)) ^ (len(grams) * 0xD6E8FEB86659FD93 & (2**64 - 1))], _U)
    return int(_mix(x).view(np.int64)[0])


def _named(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for lo, hi in slices(batch, "text", AT_ONCE):
                part = cut(batch, lo, hi)
                sets = shingle_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_signature(x) if len(x) else None for x in sets], pa.int64())],
                    ["id", "n", "sig"],
                )

    return run


def _planes(tokens: np.ndarray) -> bytes:
    """Sorted tokens by planes of bytes, low plane first, so that Spark's codec meets runs."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].T).tobytes()


def _tokens(planes: bytes) -> np.ndarray:
    k = TOKEN_BITS // 8
    rows = np.frombuffer(planes, np.uint8).reshape(k, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :k] = rows.T
    return out.view(_U).ravel()


_BLOCK = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("owner", pa.binary()), ("sigs", pa.binary()), ("sizes", pa.binary())])


def _blocks(n: int, bits: int, per_block: int = 1 << 19):
    """Deal the tokens of distinct sets into 2**bits parts of the token space; a block holds many sets' tokens."""

    def flush(sigs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int32)
        tokens = np.concatenate(sets) >> _U(64 - TOKEN_BITS)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner, names = tokens[order], owner[order], np.array(sigs, np.int64)
        bounds = np.searchsorted(tokens, np.arange((1 << bits) + 1, dtype=_U) << _U(TOKEN_BITS - bits)) if bits else [0, len(tokens)]
        rows = []
        for part, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if hi > lo:
                used, local = np.unique(owner[lo:hi], return_inverse=True)
                rows.append((part, _planes(tokens[lo:hi]), local.astype(np.uint16).tobytes(), names[used].tobytes(), sizes[used].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _BLOCK, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        sigs, sets, held, known = [], [], 0, set()
        for batch in batches:
            for lo, hi in slices(batch, "text", AT_ONCE):
                for x in shingle_sets(cut(batch, lo, hi).column("text"), n):
                    if not len(x) or (sig := _signature(x)) in known:
                        continue
                    known.add(sig)
                    sigs.append(sig)
                    sets.append(x)
                    held += len(x)
                    if held >= per_block or len(sets) == 65_535:
                        yield flush(sigs, sets)
                        sigs, sets, held = [], [], 0
                        if len(known) > 200_000:  # a repeated set is met again when its blocks meet
                            known = set()
        if sets:
            yield flush(sigs, sets)

    return run


def _shared_tokens(bits: int):
    """Within a part of the token space: tokens that two or more sets hold, ranked by the octave of their count."""

    def run(table: pa.Table) -> pa.Table:
        alone()
        tokens, owner, sigs, sizes, base = [], [], [], [], 0
        for row in table.select(["tokens", "owner", "sigs", "sizes"]).to_pylist():
            tokens.append(_tokens(row["tokens"]))
            owner.append(np.frombuffer(row["owner"], np.uint16).astype(np.int64) + base)
            sigs.append(np.frombuffer(row["sigs"], np.int64))
            sizes.append(np.frombuffer(row["sizes"], np.int32))
            base += len(sigs[-1])
        names, first, which = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
        sizes = np.concatenate(sizes)[first]
        owner = which[np.concatenate(owner)].astype(_U)
        tokens = np.concatenate(tokens)
        room = max(1, int(len(names) - 1).bit_length())
        if TOKEN_BITS - bits + room <= 64:
            both = np.unique(((tokens & _U((1 << (TOKEN_BITS - bits)) - 1)) << _U(room)) | owner)
            high = tokens[0] >> _U(TOKEN_BITS - bits) << _U(TOKEN_BITS - bits) if bits else _U(0)
            tokens, owner = (both >> _U(room)) | high, both & _U((1 << room) - 1)
        else:
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
            tokens, owner = tokens[new], owner[new]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(start, len(tokens)))
        each = np.repeat(count, count)
        keep = each >= 2
        octave = np.floor(np.log2(each[keep])).astype(_U)
        owner = owner[keep].astype(np.int64)
        key = ((octave << _U(TOKEN_BITS)) | tokens[keep]).astype(np.int64)
        return pa.table({"sig": names[owner], "n": sizes[owner].astype(np.int64), "key": key})

    return run


def _may_link(a: str, b: str, num: int, den: int):
    """Both sizes, and the tokens that each shares with any other set, leave room for the similarity."""
    return F.expr(f"{num + den} * least({a}.m, {b}.m) >= {num} * ({a}.n + {b}.n)")


def _overlapping(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs ``(a, b)`` of set names, those that link: partial overlaps by fragment, summed per pair."""
    left = segments.select(F.col("sig").alias("a"), F.col("n").alias("na"), "fragment", F.col("segment").alias("sa"))
    right = segments.select(F.col("sig").alias("b"), F.col("n").alias("nb"), "fragment", F.col("segment").alias("sb"))
    partial = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("part"))
    )
    return (
        partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
        .where(f"{num + den} * overlap >= {num} * (na + nb)").select("a", "b", "overlap")
    )


def _linked_sets(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """``ngram_links`` and, between its two, the distinct sets with their shared tokens by segment; last, what they are written in."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    members = materialize(rows.mapInArrow(_named(n), f"id {kind}, n long, sig long"), "ngram-members")

    parts = max(width(spark), rows.select("text").rdd.getNumPartitions())  # grows with the input, so that a part does not
    bits = (parts - 1).bit_length() + 1  # two to four parts of the token space for each task
    blocks = rows.select("text").mapInArrow(_blocks(n, bits), "part int, tokens binary, owner binary, sigs binary, sizes binary")
    shared = blocks.repartition(parts, "part").groupBy("part").applyInArrow(_shared_tokens(bits), "sig long, n long, key long")
    sets = scratch.keep(
        shared.repartition(parts, "sig")
        .groupBy("sig", "n", F.shiftright("key", FRAGMENT_SHIFT).cast("int").alias("fragment"))
        .agg(F.sort_array(F.collect_list("key")).alias("segment"))
        .groupBy("sig", "n")
        .agg(F.sort_array(F.collect_list(F.struct("fragment", "segment"))).alias("segments"), F.sum(F.size("segment")).alias("m"))
        .where(f"{den} * m >= {num} * n"),
        "ngram-sets",
    )
    segments = sets.select("sig", "n", F.explode("segments").alias("s")).select("sig", "n", "s.fragment", "s.segment")

    ranked = sets.select(
        "sig", "n", "m",
        F.flatten("segments.segment").alias("keys"),
        F.expr(f"cast(n - (({num} * n + {den - 1}) div {den}) + 1 - (n - m) as int)").alias("take"),
    )
    central = F.expr(f"aggregate(keys, 0L, (s, k) -> s + shiftright(k, {TOKEN_BITS})) / n")
    postings = scratch.keep(
        ranked.select("sig", "n", "m", central.alias("central"), F.posexplode(F.slice("keys", 1, F.col("take"))).alias("at", "key"))
        .withColumn("at", F.col("at") + F.col("n") - F.col("m")),
        "ngram-postings",
    )
    # What is joined by key is written first, so that the join meets two plain shuffles and Spark can split a long list.
    hubs = scratch.keep(postings.groupBy("key").agg(F.max(F.struct("central", "sig", "n", "m")).alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "hub"), "ngram-hubs")
    stars = scratch.keep(
        postings.alias("p").join(hubs.alias("h"), "key")
        .where("p.sig <> hub.sig").where(_may_link("p", "hub", num, den))
        .select(F.col("hub.sig").alias("a"), F.col("p.sig").alias("b")).distinct(),
        "ngram-stars",
    )
    scratch.drop("ngram-hubs")
    linked = scratch.keep(_overlapping(stars, segments, num, den), "ngram-links")

    labels = connected_components(linked, "a", "b")
    named = scratch.keep(postings.join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig")), "ngram-named")
    scratch.drop("ngram-postings")
    lists = scratch.keep(
        named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("component", F.struct("c", "component")).alias("major"))
        .where("kinds > 1").select("key", "major"),
        "ngram-lists",
    )
    mixed = scratch.keep(named.join(lists, "key"), "ngram-mixed")
    across = (
        mixed.where("component <> major").alias("x").join(mixed.alias("y"), "key")
        .where("x.component <> y.component and (y.component = y.major or x.sig < y.sig)")
        .where(_may_link("x", "y", num, den))
        .where(F.expr(f"{num + den} * least(x.n - x.at, y.n - y.at) >= {num} * (x.n + y.n)"))
        .select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()
        .join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = _overlapping(scratch.keep(across, "ngram-across"), segments, num, den)
    links = materialize(linked.unionByName(more), "ngram-all-links")
    scratch.drop("ngram-named", "ngram-lists", "ngram-mixed", "ngram-stars", "ngram-across", "ngram-links")
    return members, sets, links, scratch


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of the join: members is ``(id, n, sig)`` per row, links pairs of set names.

    The links are enough to connect whatever the full join connects, not all of its
    links: pairs inside a group that is connected already are not tested again
    (``ngram_link_counts`` counts them all). Steps:

    1. Deal the tokens of distinct sets by parts of the token space; a part counts each
       token's sets and returns the tokens held by two or more, ranked by the octave of
       the count. Tokens of one set alone cannot overlap with anything.
    2. Gather each set's ranked tokens as segments by fragment. A set of which more than
       1 - num/den is its own alone has no partner and ends here.
    3. In the prefix that any partner must meet, link each set to the most central set of
       each list (a star, linear in the list), and count the overlap by fragment.
    4. Lists that still hold several components give the pairs across them; the largest
       component of a list is never paired with itself.
    """
    members, _, links, scratch = _linked_sets(docs, id_col, text_col, n, num, den)
    scratch.drop("ngram-sets")
    return members, links


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Link texts whose word n-gram sets have a Jaccard similarity of num/den or more; name the components.

    A word is a run of characters other than U+0020 and U+0009-U+000D, A-Z lower-cased.
    A text with fewer than ``n`` words has one gram, its whole word sequence; a text
    that is null, empty or blank has none and is linked with nothing. Texts with equal
    sets are linked. Returns one row per input row: ``id_col, n_shingles, component_id,
    spanning_links``; component_id is the smallest id reachable by links, spanning_links
    the number of this set's links among those of ``ngram_links``, which connect the
    components but are not all (``ngram_link_counts`` has all). Repeated ids keep their rows; a null id keeps its
    row and never names a component unless all its component's ids are null. Other
    columns of ``docs`` are ignored; an empty table gives an empty result.

    Grams are compared by hashes, not by their words: a set is known by a 64-bit hash of
    it and a gram by 48 bits. Two different sets among D fall together with probability
    D * D / 2**65 (3e-8 for 10**6 sets, 3e-4 for 10**8; at 10**10 about three pairs are
    expected). A pair of sets of 1,000 grams each gains a common gram by chance with
    probability 4e-9, which changes its link only where it misses the threshold by one.
    """
    members, links = ngram_links(docs, id_col, text_col, n, num, den)
    labels = connected_components(links, "a", "b").select(F.col("node").alias("sig"), "component")
    ends = links.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("spanning_links"))
    sets = members.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"))
    sets = materialize(sets.join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig")), "ngram-labelled")
    names = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = sets.join(names, "component").join(ends, "sig", "left").select("sig", "component_id", F.coalesce("spanning_links", F.lit(0).cast("long")).alias("spanning_links"))
    own = members.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("spanning_links"))
    return members.where("n > 0").join(by_set, "sig").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "spanning_links").unionByName(own)


def _pair_counts(num: int, den: int):
    """Of one block of sets, or two: how many sets of the other block, or of its own, each set links with."""

    def run(table: pa.Table) -> pa.Table:
        blocks = []
        for sets in table.column("sets"):
            sigs, sizes, keys = sets.values.flatten()
            owner = np.repeat(np.arange(len(sigs)), pc.list_value_length(keys).to_numpy())
            blocks.append((sigs.to_numpy(), sizes.to_numpy(), owner, keys.flatten().to_numpy()))
        (one, n_one, own_one, keys_one), (other, n_other, own_other, keys_other) = blocks[0], blocks[-1]
        alone = len(blocks) == 1
        if alone:
            tokens, held = np.unique(keys_one, return_counts=True)
            tokens = tokens[held > 1]
        else:
            tokens = np.intersect1d(keys_one, keys_other)
        overlap = np.zeros((len(one), len(other)))
        for lo in range(0, len(tokens), TOKENS_AT_ONCE):
            some, dense = tokens[lo : lo + TOKENS_AT_ONCE], []
            for sigs, owner, keys in ((one, own_one, keys_one), (other, own_other, keys_other)):
                at = np.minimum(np.searchsorted(some, keys), len(some) - 1)
                has = some[at] == keys
                dense.append(np.zeros((len(sigs), len(some)), np.float32))
                dense[-1][owner[has], at[has]] = 1
            overlap += dense[0] @ dense[1].T
        links = (num + den) * overlap >= num * (n_one[:, None] + n_other[None, :])
        if alone:
            np.fill_diagonal(links, False)
            return pa.table({"sig": one, "links": links.sum(1)})
        return pa.table({"sig": np.concatenate([one, other]), "links": np.concatenate([links.sum(1), links.sum(0)])})

    return run


def ngram_link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``id_col, n_shingles, n_links`` per row: how many other distinct sets its set links with, all counted.

    Texts, links and edge cases are those of ``ngram_components``; a text without grams
    has none. Links lie within components. A component is dealt into blocks by bands of
    set size, of which only equal and neighbouring ones can link, and by hash, about
    ``BLOCK_SETS`` sets or ``BLOCK_TOKENS`` tokens each; every pair of blocks is counted
    once and keeps counts only. Work grows with the square of a component, as the links do.
    """
    members, sets, links, scratch = _linked_sets(docs, id_col, text_col, n, num, den)
    labels = connected_components(links, "a", "b").select(F.col("node").alias("sig"), "component")
    step = 1.001 * max(math.log(den / num), 0.001)  # a band: sets that link differ by one at most
    banded = sets.join(labels, "sig").select("sig", "n", "m", "component", F.floor(F.log("n") / step).cast("int").alias("band"), F.flatten("segments.segment").alias("keys"))
    banded = materialize(banded, "ngram-banded")
    scratch.drop("ngram-sets")
    place = ["component", "band", "bin"]
    bins = (
        banded.groupBy("component", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("m") / BLOCK_TOKENS)).cast("int").alias("bins"))
        .where("bins > 1")  # few: one for each BLOCK_SETS sets at most, or large texts
    )
    dealt = banded.join(F.broadcast(bins), ["component", "band"], "left").withColumn("bin", F.expr("cast(pmod(xxhash64(sig), coalesce(bins, 1)) as int)"))
    blocks = materialize(dealt.groupBy(*place).agg(F.collect_list(F.struct("sig", "n", "keys")).alias("sets")), "ngram-count-blocks")
    x, y = blocks.select(*place).alias("x"), blocks.select(*place).alias("y")
    pairs = (
        x.join(y, "component").where("y.band = x.band + 1 or y.band = x.band and y.bin >= x.bin")
        .select("component", F.struct("x.band", "x.bin").alias("one"), F.struct("y.band", "y.bin").alias("other"))
    )
    sides = pairs.select("component", "one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("side")).select("component", "one", "other", "side.band", "side.bin")
    counted = (
        sides.join(blocks, place).select("component", "one", "other", "sets")
        .groupBy("component", "one", "other").applyInArrow(_pair_counts(num, den), "sig long, links long")
        .groupBy("sig").agg(F.sum("links").alias("links"))
    )
    return members.join(counted, "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))
