"""Toxicity by a counterfactually regularised classifier.

A sparse logistic model over the distinct words of a text and their first letters. In
every labelled sentence that names a group, the name is swapped for each other of its
kind and for a neutral word, and the training objective penalises the change of the
sentence's score, so that a neutral mention of a group does not count against a text.
Names that no labelled sentence holds are put into neutral labelled sentences instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import alone, cut, slices
from sievemark.session import materialize

#: Labelled texts of either class (which weigh alike) from which the model is fitted, at most; the choice is by a hash of the id.
FIT_TOXIC, FIT_NEUTRAL = 2_000, 4_000
L1, SWAP_PENALTY, STEPS = 3e-4, 1.0, 300
#: Features taken into the working set at once; the search ends only when no feature outside of it would gain.
ENTERING = 4096
#: Neutral labelled sentences, the first by a hash, into which names go that no labelled sentence holds.
INSERT_SENTENCES = 40
#: What a name is swapped for beside the others of its kind.
NEUTRAL_WORD = "people"
#: Names of groups by kind; a name is swapped for the others of its kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("deaf", "blind", "disabled", "old", "young"),
    ("immigrants", "refugees", "foreigners", "natives"),
)

_KIND_OF = {t: kind for kind in IDENTITY_TERMS for t in kind}
SENTENCE_END = r"[.!?\n]+"


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words, without what is neither letter nor digit at their ends."""
    found = set()
    for word in set(text.lower().split()):
        if not word.isalnum():
            lo, hi = 0, len(word)
            while lo < hi and not word[lo].isalnum():
                lo += 1
            while hi > lo and not word[hi - 1].isalnum():
                hi -= 1
            word = word[lo:hi]
        if word:
            found.add(word)
    return found


#: Lengths of beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7)


def features_of(words: set[str]) -> set[str]:
    """Features of distinct words: the words, their beginnings, and beginnings that two or more of them share."""
    found = {"w" + w for w in words}
    for n in BEGINNINGS:
        starts = [w[:n] for w in words if len(w) > n]
        once = set(starts)
        found.update(f"p{x}" for x in once)
        if len(starts) > len(once):
            seen: set[str] = set()
            for x in starts:
                if x in seen:
                    found.add(f"2{x}")
                seen.add(x)
    return found


def swaps_of(words: set[str], term: str) -> Iterator[tuple[set[str], set[str]]]:
    """For each swap of ``term`` in a sentence of these words: features it loses, and features it gains."""
    before = features_of(words)
    for other in (*_KIND_OF[term], NEUTRAL_WORD):
        if other != term:
            after = features_of(words - {term} | {other})
            yield before - after, after - before


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    swapped: int = 0  # pairs of a labelled sentence and a swap of it under the penalty

    def __post_init__(self) -> None:
        self.words = {f[1:] for f in self.weights if f[0] == "w"}
        self.heads = {f[1:5] for f in self.weights if f[0] != "w"}

    def score(self, text: str) -> float:
        total = self.bias
        words = words_of(text)
        near = {w for w in words if w[:4] in self.heads} | (words & self.words)  # no other word has a weight
        if near:
            total += sum(self.weights[f] for f in sorted(features_of(near) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


@dataclass
class _Lists:
    """Feature lists, one after the other, and the list that each entry belongs to; read in runs, so that temporary arrays are small."""

    flat: np.ndarray
    owner: np.ndarray
    n: int
    RUN = 1 << 20

    def sums(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for k in range(0, len(self.flat), self.RUN):
            out += np.bincount(self.owner[k : k + self.RUN], w[self.flat[k : k + self.RUN]], self.n)
        return out

    def spread(self, of: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for k in range(0, len(self.flat), self.RUN):
            out += np.bincount(self.flat[k : k + self.RUN], of[self.owner[k : k + self.RUN]], size)
        return out

    def only(self, active: np.ndarray, place: np.ndarray) -> _Lists:
        at = active[self.flat]
        return _Lists(place[self.flat[at]], self.owner[at], self.n)


def _lists(rows: list[np.ndarray]) -> _Lists:
    return _Lists(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), len(rows))


def _descend(x: _Lists, labels: np.ndarray, weight: np.ndarray, lost: _Lists, gained: _Lists, share: np.ndarray, size: int, l1: float, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum from ``w``: logistic loss, the swaps' squared change of score, and an L1 norm.

    Weights are not negative: what marks a text as toxic is what it holds, and no other word makes up for it.
    """

    def value(v: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
        """The objective, and what its gradient needs: probabilities and the swaps' changes."""
        z = x.sums(v) + c
        change = gained.sums(v) - lost.sums(v)
        loss = float((weight * (np.logaddexp(0, z) - labels * z)).sum() + (share * change**2).sum() + l1 * v.sum())
        return loss, 1 / (1 + np.exp(-np.clip(z, -50, 50))), change

    y, by, t = w, bias, 1.0
    # Features of unlike frequency are scaled alike, by a bound on the curvature in each; steps that do not gain are halved.
    width = 2 * share * (np.bincount(lost.owner, minlength=lost.n) + np.bincount(gained.owner, minlength=gained.n))
    rate = 1.0 / (np.maximum(x.spread(weight, size) * 0.25, 1e-4) * 12 + lost.spread(width, size) + gained.spread(width, size))
    best, still = value(w, bias)[0], 0
    for _ in range(STEPS):
        _, p, change = value(y, by)
        error = weight * (p - labels)
        gradient = x.spread(error, size) + gained.spread(2 * share * change, size) - lost.spread(2 * share * change, size)
        new = np.maximum(y - rate * gradient - rate * l1, 0)
        new_bias = by - 0.5 * error.sum()
        found = value(new, new_bias)[0]
        if found > best + 1e-12:
            if t == 1.0:
                rate = rate / 2
            y, by, t = w, bias, 1.0
            continue
        still = still + 1 if best - found < 1e-7 * max(best, 1e-12) else 0
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, by = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias, best = new, new_bias, found
        if still == 5:
            break
    return w, float(bias)


def _minimise(x: _Lists, labels: np.ndarray, lost: _Lists, gained: _Lists, uses: np.ndarray, size: int, l1: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias over all features, by a working set that grows until no feature outside of it would gain."""
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    share = penalty * uses / max(1.0, uses.sum())
    w, bias, active = np.zeros(size), 0.0, np.zeros(size, bool)
    while True:
        p = 1 / (1 + np.exp(-np.clip(x.sums(w) + bias, -50, 50)))
        change = gained.sums(w) - lost.sums(w)
        gain = x.spread(weight * (labels - p), size) - gained.spread(2 * share * change, size) + lost.spread(2 * share * change, size)
        fresh = np.flatnonzero((gain > l1 * 1.001) & ~active)
        if not len(fresh):
            return w, bias
        active[fresh[np.argsort(-gain[fresh], kind="stable")[:ENTERING]]] = True
        place = np.cumsum(active) - 1
        w[active], bias = _descend(x.only(active, place), labels, weight, lost.only(active, place), gained.only(active, place), share, int(active.sum()), l1, w[active], bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Fit the model from at most ``FIT_TOXIC`` and ``FIT_NEUTRAL`` labelled texts, as classes of equal weight.

    Each sentence of these texts that names a group gives a pair for every swap of the
    name; a name that occurs in none goes into ``INSERT_SENTENCES`` neutral ones. The
    mean squared change of score over all pairs, times ``penalty``, joins the loss.
    Features held by so few toxic texts that the L1 norm outweighs anything they could
    gain have weight 0 at the optimum and are left out, unless a pair holds them.

    A document with several labels counts as toxic if any says so; null labels, and
    documents without text, teach nothing. Without both classes the model scores near 0.
    """
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel()
    by_hash = F.xxhash64(F.col("id").cast("string"), F.lit(5))
    chosen = [own.where(f"y = {y}").orderBy(by_hash, "id").limit(n) for y, n in ((1, FIT_TOXIC), (0, FIT_NEUTRAL))]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "toxic-chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = materialize(texts.join(F.broadcast(chosen), "id"), "toxic-sample")  # FIT_TOXIC + FIT_NEUTRAL ids at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for lo, hi in slices(batch, "text", 1 << 17):
                part = cut(batch, lo, hi)
                found = [sorted(features_of(words_of(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("y"), pa.array(found, pa.list_(pa.string()))], ["id", "y", "features"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                lost, gained = [], []
                if not _KIND_OF.keys().isdisjoint(words_of(text)):
                    for sentence in re.split(SENTENCE_END, text):
                        words = words_of(sentence)
                        for term in sorted(words & _KIND_OF.keys()):
                            for out, into in swaps_of(words, term):
                                lost.append(sorted(out))
                                gained.append(sorted(into))
                yield pa.RecordBatch.from_arrays([pa.array(lost, pa.list_(pa.string())), pa.array(gained, pa.list_(pa.string()))], ["lost", "gained"])

    rows = materialize(sample.select("id", "y", "text").mapInArrow(extract, "id string, y int, features array<string>").withColumn("nth", F.monotonically_increasing_id()), "toxic-features")
    n = {y: max(1, rows.where(f"y = {y}").count()) for y in (0, 1)}
    pairs = [(r["lost"], r["gained"], r["n"]) for r in sample.select("text").mapInArrow(swap, "lost array<string>, gained array<string>").groupBy("lost", "gained").agg(F.count(F.lit(1)).alias("n")).collect()]  # of the bounded sample
    per = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"))
    named = {r["f"][1:] for r in per.where(F.col("f").isin(["w" + t for t in _KIND_OF])).select("f").collect()}
    plain = sample.where("y = 0").select(F.explode(F.split("text", SENTENCE_END)).alias("s")).where(F.size(F.split(F.trim("s"), r"\s+")) >= 4).distinct()
    inserted = [words_of(r["s"]) for r in plain.orderBy(F.xxhash64("s"), "s").limit(INSERT_SENTENCES).collect()]
    pairs += [(sorted(out), sorted(into), 1) for t in sorted(_KIND_OF.keys() - named) for words in inserted for out, into in swaps_of(words | {t}, t)]

    told = sorted({f for out, into, _ in pairs for f in (*out, *into)})
    wanted = spark.createDataFrame([(f,) for f in told], "f string")  # features of the sample's pairs
    kept = per.where(F.col("a") * (0.5 / n[1]) > L1).select("f").union(per.join(F.broadcast(wanted), "f", "left_semi").select("f")).distinct()
    names = sorted(r["f"] for r in kept.collect())  # features of the bounded sample
    place = {f: k for k, f in enumerate(names)}
    numbered = spark.createDataFrame(pa.table({"f": pa.array(names, pa.string()), "k": pa.array(range(len(names)), pa.int32())}))
    held = (
        rows.select("nth", "id", "y", F.explode_outer("features").alias("f")).join(F.broadcast(numbered), "f", "left")  # features of the bounded sample
        .groupBy("nth").agg(F.first("id").alias("id"), F.first("y").alias("y"), F.sort_array(F.collect_list("k")).alias("features"))
        .orderBy("id", "y", "features").select("y", "features").toArrow()
    )
    features, y = held.column("features"), np.asarray(held.column("y")).astype(float)
    lengths = np.concatenate([np.zeros(0, int), *(pa.compute.list_value_length(c) for c in features.chunks)]).astype(int)
    x = _Lists(np.concatenate([np.zeros(0, np.int32), *(np.asarray(c.flatten()) for c in features.chunks)]), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), len(lengths))
    del held, features
    placed = sorted((tuple(place[f] for f in out if f in place), tuple(place[f] for f in into if f in place), k) for out, into, k in pairs)
    placed = [p for p in placed if p[0] or p[1]]  # the others' change is 0
    lost, gained = (_lists([np.array(p[side], np.int32) for p in placed]) for side in (0, 1))
    uses = np.array([p[2] for p in placed], float)
    w, bias = _minimise(x, y, lost, gained, uses, len(names), L1, penalty)
    return ToxicityModel({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, bias, int(uses.sum()))


def crc_mod(id_col: str, n: int):
    """crc32 of the id written as text, modulo ``n``."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(n))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Every whole text's score, and 1 where it reaches ``threshold``: ``id_col, score, predicted``.

    A null or empty text has the score of no feature. Repeated rows are scored each;
    other columns are ignored; an empty table gives an empty result.
    """
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        own = ToxicityModel(weights, bias)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = cut(batch, lo, hi)
                scores = [own.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay."""
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        own = ToxicityModel(weights, bias)
        for batch in batches:
            for lo, hi in slices(batch, text_col):
                part = cut(batch, lo, hi)
                yield part.filter(pa.array([own.score(t or "") < threshold for t in part.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
