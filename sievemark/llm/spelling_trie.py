"""Spelling variants: words one edit apart, by a self-join of vocabulary tries with active-node sets.

A pair one edit apart agrees before and after the edit, so of the two halves of its
shorter word one is the same in both. Words are dealt by what stays the same, and each
group's open parts make a trie. Going down, every node carries its active nodes: those
whose text is one edit from its own. At a fork they arise (siblings: a letter replaced;
a node and its child: a letter inserted), below it they go on along equal letters, and a
pair of active ends of words is a pair of near words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import alone
from sievemark.session import Scratch, width

#: Runs of letters that count as words.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words whose tries a task goes down together, unless one group holds more.
CHUNK = 100_000
#: Words of a group above which its open part is halved.
GROUP = 50_000

_SHIFT = 21  # bits of a code point
_LETTER = (1 << _SHIFT) - 1


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: str = RUN, drop_every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``word, n``: distinct runs of letters, A-Z in lower case, with their occurrences over all texts.

    A run whose CRC-32, with its document's id, is a multiple of ``drop_every`` loses the
    code point that the CRC points at. Words have ``shortest`` code points and ``least``
    occurrences at least. Null and empty texts have none; a null id counts as an empty
    one; repeated rows count each; other columns are ignored; an empty table gives an
    empty result. Occurrences are counted within tasks before they are shuffled, so a
    word that fills a third of the corpus costs its reducer a row a task.
    """
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(run), F.lit(0))).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (crc % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(crc % drop_every == 0, short).otherwise(F.col("run"))
    words = runs.where(F.length("run") >= shortest).select(word.alias("word")).where(F.length("word") >= max(1, shortest))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class _Level:
    """The nodes of one depth, in the order of their texts: parent and letter as one sorted key, words below, the word that ends here."""

    def __init__(self, key: np.ndarray, below: np.ndarray, ends: np.ndarray, words: np.ndarray, of: np.ndarray):
        self.key, self.below, self.ends, self.words, self.of = key, below, ends, words, of

    @staticmethod
    def of_words(words: np.ndarray, key: np.ndarray, lengths: np.ndarray, depth: int) -> _Level:
        """Nodes of sorted ``words`` that have one, ``key`` being that of each word's node."""
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        of, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        ends = np.full(len(starts), -1, np.int64)
        done = lengths[words] == depth
        ends[of[done]] = words[done]
        return _Level(key[starts], np.diff(np.append(starts, len(key))), ends, words, of)


def _children(nodes: np.ndarray, below: _Level) -> tuple[np.ndarray, np.ndarray]:
    """For each child of ``nodes`` in the next level: which of ``nodes`` it belongs to, and its number."""
    lo, hi = np.searchsorted(below.key, nodes << _SHIFT), np.searchsorted(below.key, nodes + 1 << _SHIFT)
    count = hi - lo
    whose = np.repeat(np.arange(len(nodes)), count)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + lo[whose]


def _onward(x: np.ndarray, y: np.ndarray, x_next: _Level, y_next: _Level) -> tuple[np.ndarray, np.ndarray]:
    """Active pairs one equal letter further down."""
    whose, child = _children(x, x_next)
    want = y[whose] << _SHIFT | x_next.key[child] & _LETTER
    at = np.searchsorted(y_next.key, want)
    found = at < len(y_next.key)
    found[found] = y_next.key[at[found]] == want[found]
    return child[found], at[found]


def _siblings(level: _Level) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of one node: of each child with those after it."""
    parent = level.key >> _SHIFT
    rest = np.searchsorted(parent, parent, side="right") - np.arange(len(parent)) - 1
    x = np.repeat(np.arange(len(parent)), rest)
    return x, x + np.arange(len(x)) - np.repeat(np.cumsum(rest) - rest, rest) + 1


def near_pairs(group: np.ndarray, texts: list[str], inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (of row numbers) of one group whose texts are one edit apart, each once, and whether by an inserted letter.

    Rows are sorted by group and text, without repeats. Of an inserted letter the shorter
    text comes first; where ``inner`` and the letter may stand at the end of the open
    part, the pair is left to the group of the part after it. Only words that share a node, or whose
    node is active, are followed down, so long texts end where they stand alone.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    none = np.zeros(0, np.int64)

    def build(level: _Level, kept: np.ndarray, depth: int) -> _Level:
        """The level under ``level``, of the words of ``kept`` nodes that reach it."""
        on = kept[level.of] & (lengths[level.words] >= depth)
        words, of = level.words[on], level.of[on]
        return _Level.of_words(words, of << _SHIFT | codes[starts[words] + depth - 1], lengths, depth)

    upper = _Level.of_words(np.arange(len(texts)), group << _SHIFT, lengths, 0)
    lower = build(upper, upper.below > 1, 1)
    replaced = (none, none)  # both in the upper level
    inserted = (lower.key >> _SHIFT, np.arange(len(lower.key)))  # the longer one in the lower level
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(upper.words):
        a, b = upper.ends[replaced[0]], upper.ends[replaced[1]]
        met = (a >= 0) & (b >= 0)
        found.append((a[met], b[met], np.zeros(int(met.sum()), bool)))
        a, b = upper.ends[inserted[0]], lower.ends[inserted[1]]
        met = (a >= 0) & (b >= 0)
        met[met] &= ~(inner[a[met]] & (lower.key[inserted[1][met]] >> _SHIFT == inserted[0][met]))
        found.append((a[met], b[met], np.ones(int(met.sum()), bool)))

        on, forks = _onward(*replaced, lower, lower), _siblings(lower)
        on = tuple(np.concatenate(p) for p in zip(on, forks))
        kept = lower.below > 1
        kept[on[0]] = kept[on[1]] = kept[inserted[1]] = True
        kept[_children(inserted[0], lower)[1]] = True
        under = build(lower, kept, depth + 2)
        parent = under.key >> _SHIFT
        fresh = np.flatnonzero((lower.below[parent] > 1) & (lower.key[parent] & _LETTER != under.key & _LETTER))  # an equal letter is met further up
        inserted = tuple(np.concatenate(p) for p in zip(_onward(*inserted, lower, under), (parent[fresh], fresh)))
        replaced, upper, lower, depth = on, lower, under, depth + 1
    return tuple(np.concatenate(p) for p in zip(*found))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within each group of sorted rows ``key, open, word, n, long, inner``, both ways."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key")
        changed = np.asarray(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)))
        group = np.concatenate([[0], np.cumsum(changed)]).astype(np.int64)
        a, b, longer = near_pairs(group, rows.column("open").to_pylist(), np.asarray(rows.column("inner")))
        own = longer | ~np.asarray(rows.column("long"))[a]  # two longer words with a letter replaced meet in a group of their own
        a, b = a[own], b[own]
        one, two = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        word, n = rows.column("word"), rows.column("n")
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (word.take(one), word.take(two), n.take(two))], ["word", "near", "near_n"])

    alone()
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(table.column("key"), table.column("key")[-1]).as_py()
            if cut:
                yield pairs(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pairs(pa.Table.from_batches(held).combine_chunks())


def _parts(bounds: list[tuple[Column, Column, Column]]) -> Column:
    return F.inline(F.array(*[F.struct(n.cast("int").alias("shorter"), head.cast("int").alias("head"), tail.cast("int").alias("tail")) for n, head, tail in bounds]))


def near_words(words: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of words of ``words (word, n)`` that are one edit apart, each once.

    A word takes part with its own length, and with one less, as the shorter length of a
    pair; per length it is dealt by its second half, the first half open, and by its
    first half, the second open. A group of more than ``group`` words has its open part
    halved, until one code point is open, which leaves at most a word per letter and pair
    of letters; so no group, however hot its halves, is larger than both bounds, and none is cut.
    """
    size = F.length("word")
    half = lambda n: F.floor(n / 2)
    open_first = lambda n: (n, F.lit(0), n - half(n))
    open_last = lambda n: (n, half(n), F.lit(0))
    rows = words.select("word", "n", _parts([side(n) for n in (size, size - 1) for side in (open_first, open_last)])).where("shorter > 0")
    done, label = [], 0
    while True:
        head, tail = F.col("head"), F.col("tail")
        same = F.concat(F.substring("word", F.lit(1), head), F.substring("word", size - tail + 1, tail))
        keyed = scratch.keep(rows.withColumn("key", F.concat_ws(":", "shorter", "head", "tail", same)), f"spelling-keys-{label}")
        held = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), f"spelling-groups-{label}")
        wide = (F.col("held") > group) & (F.col("shorter") - F.col("head") - F.col("tail") > 1)
        met = keyed.join(held, "key")
        done.append(met.where(~wide))
        if held.where(F.col("held") > group).isEmpty():
            break
        middle = head + F.floor((F.col("shorter") - head - tail) / 2)
        rows = met.where(wide).select("word", "n", _parts([(F.col("shorter"), head, F.col("shorter") - middle), (F.col("shorter"), middle, tail)]))
        label += 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    dealt = every.select("key", F.substring("word", F.col("head") + 1, size - F.col("head") - F.col("tail")).alias("open"), "word", "n", (size > F.col("shorter")).alias("long"), (F.col("tail") > 0).alias("inner"))
    sorted_rows = dealt.repartition(width(words.sparkSession), "key").sortWithinPartitions("key", "open")
    return sorted_rows.mapInArrow(_joined, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """Each word's better-known spelling: ``word, n, n_near, form, form_n, root``.

    Words are near if one code point inserted, deleted or replaced makes one the other.
    ``form`` is the near word of largest n (ties: smallest by code points) if that is
    ``ratio`` times the word's own at least, else null; ``root`` follows forms to the last
    and is the word itself without one. ``words (word, n)`` has distinct words; null and empty
    ones are left out; other columns are ignored; an empty table gives an empty result.
    Counts double along forms, so chains are short; roots are found by doubling steps,
    each a join of the words that have a form.
    """
    if ratio < 2:
        raise ValueError("a ratio of 2 or more, so that forms cannot run in a circle")
    scratch = Scratch(words.sparkSession)
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")).where("word <> '' and n is not null"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    met = near_words(words, scratch, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    found = scratch.keep(
        words.join(met, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("best.form")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    step = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.keep(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if step.where("moved").isEmpty():
            break
        step = step.drop("moved")
    return found.join(step.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
