"""Language identification by segmentation-marginalised unigrams.

Each language has a distribution over the pieces of a fixed public vocabulary. A word's
probability in a language sums over all its segmentations into pieces (the forward
algorithm); a text's is the product over its words. The distributions are fitted by
expectation and maximisation over the same sum.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import MODELS, cut, slices
from sievemark.session import materialize

#: Labelled texts per language from which the distributions are fitted, about; the choice is by a hash of id and text.
FIT_TEXTS = 1200
ROUNDS = 3
#: Languages that the model can hold, each a column of the vocabulary's length; more are refused, not dropped.
MOST_LANGUAGES = 2_000
#: Probability of a character outside the vocabulary, and of a piece that a language has not shown.
UNKNOWN, FLOOR = 1e-8, 1e-9
SPAN = 400_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces by the hash of their characters, sorted; the last index stands for any other character."""

    hashes: np.ndarray
    order: np.ndarray
    size: int
    longest: int


def _word(word: str) -> str:
    """Lower case, without what is not a letter at either end; empty if nothing is left."""
    word = word.lower()
    if word.isalpha():
        return word
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalpha():
        lo += 1
    while hi > lo and not word[hi - 1].isalpha():
        hi -= 1
    return word[lo:hi]


def _char_hashes(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Lower-cased letter pieces of a sentencepiece model; ``▁`` marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    pieces = sorted({p.lower() for p in pieces} | {"▁"})
    hashes = np.zeros(len(pieces), _U)
    for k, piece in enumerate(pieces):
        h = 0
        for c in _char_hashes(np.array([ord(x) for x in piece])).tolist():
            h = (h * int(_BASE) + c) & (2**64 - 1)
        hashes[k] = h ^ len(piece)
    order = np.argsort(hashes, kind="stable")
    return Vocabulary(hashes[order], order, len(pieces), max(map(len, pieces)))


MODELS.append(vocabulary)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the words behind a word-start mark, as rows padded with 0; and their lengths."""
    length = np.array([len(w) + 1 for w in words])
    codes = np.zeros((len(words), int(length.max())), np.uint32)
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.arange(codes.shape[1])[None, :] < length[:, None]] = flat
    return codes, length


def _matches(codes: np.ndarray, vocab: Vocabulary) -> dict[tuple[int, int], np.ndarray]:
    """For spans (end, length): the piece of each word there, or -1; single other characters are ``vocab.size``."""
    chars = _char_hashes(codes)
    found = {}
    for start in range(codes.shape[1]):
        h = np.zeros(len(codes), _U)
        for n in range(1, min(vocab.longest, codes.shape[1] - start) + 1):
            h = h * _BASE + chars[:, start + n - 1]
            key = h ^ _U(n)
            at = np.searchsorted(vocab.hashes, key)
            at[at == vocab.size] = 0
            piece = np.where(vocab.hashes[at] == key, vocab.order[at], -1)
            piece[codes[:, start + n - 1] == 0] = -1
            if n == 1:
                piece = np.where((piece < 0) & (codes[:, start] != 0), vocab.size, piece)
            if (piece >= 0).any():
                found[start + n, n] = piece
    return found


def _forward(codes: np.ndarray, found: dict, of, width: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Forward sums after each character, scaled to stay in range, and the logs of the scales; ``of(piece, rows)`` are probabilities."""
    alpha, logs = [np.ones((len(codes), width))], np.zeros((codes.shape[1] + 1, len(codes)))
    for end in range(1, codes.shape[1] + 1):
        now = np.zeros_like(alpha[0])
        for n in range(1, min(longest, end) + 1):
            piece = found.get((end, n))
            if piece is None:
                continue
            at = np.flatnonzero(piece >= 0)
            shift = np.exp(np.maximum(logs[end - n, at] - logs[end - 1, at], -700))[:, None]
            now[at] += alpha[end - n][at] * shift * of(piece[at], at)
        peak = now.max(axis=1)
        live = peak > 0
        now[live] /= peak[live, None]
        logs[end] = logs[end - 1] + np.where(live, np.log(np.where(live, peak, 1)), 0)
        alpha.append(now)
    return alpha, logs


def _backward(codes: np.ndarray, length: np.ndarray, found: dict, of, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Backward sums from each place to the word's end, and the logs of their scales."""
    places = codes.shape[1]
    beta, logs = np.zeros((places + 1, len(codes))), np.zeros((places + 1, len(codes)))
    beta[length, np.arange(len(codes))] = 1
    for start in range(places - 1, -1, -1):
        now = np.zeros(len(codes))
        for n in range(1, min(longest, places - start) + 1):
            piece = found.get((start + n, n))
            if piece is None:
                continue
            at = np.flatnonzero(piece >= 0)
            now[at] += beta[start + n, at] * np.exp(np.maximum(logs[start + n, at] - logs[start + 1, at], -700)) * of(piece[at], at)[:, 0]
        live = now > 0
        beta[start, live] = 1.0
        logs[start] = np.where(live, logs[start + 1] + np.log(np.where(live, now, 1)), logs[start + 1])
    return beta, logs


def _score(words: list[str], vocab: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, words of like length together."""
    out = np.zeros((len(words), probs.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    lo = 0
    while lo < len(order):
        longest = len(words[order[min(lo + 4096, len(order)) - 1]])
        hi = lo + max(1, min(4096, SPAN // (longest + 1)))
        own = order[lo:hi]
        codes, length = _codes([words[k] for k in own])
        alpha, logs = _forward(codes, _matches(codes, vocab), lambda piece, _: probs[piece], probs.shape[1], vocab.longest)
        rows = np.arange(len(own))
        final = np.stack(alpha)[length, rows]
        out[own] = np.log(np.maximum(final, 1e-300)) + logs[length, rows][:, None]
        lo = hi
    return out


def _expected(path: str, probs: np.ndarray):
    """Expected uses of each piece over all segmentations of each word, per language, weighted by the word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        total = np.zeros((probs.shape[1], vocab.size + 1))
        for batch in batches:
            langs, counts, words = np.asarray(batch.column("k")), np.asarray(batch.column("n")).astype(float), batch.column("word").to_pylist()
            order, lo = np.argsort([len(w) for w in words], kind="stable"), 0
            while lo < len(order):
                longest = len(words[order[min(lo + 2048, len(order)) - 1]])
                own = order[lo : lo + max(1, min(2048, SPAN // (longest + 1)))]
                lo += len(own)
                codes, length = _codes([words[k] for k in own])
                found, lang, rows = _matches(codes, vocab), langs[own], np.arange(len(own))
                of = lambda piece, at: probs[piece, lang[at]][:, None]  # noqa: B023, E731
                alpha, up = _forward(codes, found, of, 1, vocab.longest)
                beta, down = _backward(codes, length, found, of, vocab.longest)
                alpha = np.stack(alpha)[:, :, 0]
                whole, scale = alpha[length, rows], up[length, rows]
                for (end, n), piece in found.items():
                    at = np.flatnonzero((piece >= 0) & (whole > 0) & (end <= length))
                    log = up[end - n, at] + down[end, at] - scale[at]
                    use = alpha[end - n, at] * probs[piece[at], lang[at]] * beta[end, at] / whole[at] * np.exp(np.clip(log, -700, 700)) * counts[own][at]
                    np.add.at(total, (lang[at], piece[at]), use)
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece], pa.float64())], ["k", "piece", "uses"])

    return run


@dataclass
class LanguageModel:
    """Languages in code point order, their log priors, and piece probabilities (pieces, languages)."""

    langs: list[str]
    priors: np.ndarray
    probs: np.ndarray
    path: str


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch, "text"):
            part = cut(batch, lo, hi)
            k, words, counts = [], [], []
            for lang, text in zip(part.column("k").to_pylist(), part.column("text").to_pylist(), strict=True):
                own: dict[str, int] = {}
                for w in text.split():
                    if w := _word(w):
                        own[w] = own.get(w, 0) + 1
                k += [lang] * len(own)
                words += own.keys()
                counts += own.values()
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["k", "word", "n"])


def fit(labelled: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_TEXTS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities per language from about ``per_language`` texts of each, and priors from all.

    The sample is every text whose hash, of id and text, falls under a rate that depends
    on the language's count alone. Word counts, and expected piece counts in each round, are
    summed by Spark; what comes to the driver is bounded by vocabulary and languages.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(counts)
    vocab = vocabulary(path)
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((vocab.size + 1, 0)), path)
    spark = labelled.sparkSession
    chosen = spark.createDataFrame([(g, k, min(1.0, per_language / counts[g])) for k, g in enumerate(langs)], "lang string, k int, rate double")
    sample = rows.join(F.broadcast(chosen), "lang").where(F.shiftrightunsigned(F.xxhash64("id", "text"), 1) / F.lit(2.0**63) < F.col("rate"))
    words = sample.select("k", "text").mapInArrow(_words, "k int, word string, n long")
    words = materialize(words.groupBy("k", "word").agg(F.sum("n").alias("n")), "lang-words")
    probs = np.full((vocab.size + 1, len(langs)), 1.0 / vocab.size)
    for _ in range(rounds):
        probs[vocab.size] = UNKNOWN
        uses = words.mapInArrow(_expected(path, probs), "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        probs = np.zeros((vocab.size + 1, len(langs)))
        probs[np.asarray(uses.column("piece")), np.asarray(uses.column("k"))] = np.asarray(uses.column("uses"))
        probs[vocab.size] = 0
        probs = np.maximum(probs / np.maximum(probs.sum(axis=0), 1e-12), FLOOR)
    probs[vocab.size] = UNKNOWN
    total = sum(counts.values())
    return LanguageModel(langs, np.log([counts[g] / total for g in langs]), probs, path)


class _Scores:
    """Word scores of a worker, kept in two bounded generations."""

    LIMIT = 250_000

    def __init__(self, model: LanguageModel):
        self.model, self.vocab = model, vocabulary(model.path)
        self.young: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs)))

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.young) > self.LIMIT:
            keep = {w for words in texts for w in words if w in self.young}
            self.rows = self.rows[[self.young[w] for w in keep]] if keep else self.rows[:0]
            self.young = {w: k for k, w in enumerate(keep)}
        fresh = set()
        for words in texts:
            fresh.update(words)
        fresh = sorted(fresh.difference(self.young))
        cores = [_word(w) for w in fresh]
        own = [c for c in cores if c]
        unique = sorted(set(own))
        scores = np.zeros((len(fresh), self.rows.shape[1]))
        if unique:
            found = _score(unique, self.vocab, self.model.probs)
            place = {w: k for k, w in enumerate(unique)}
            at = np.array([k for k, c in enumerate(cores) if c])
            scores[at] = found[[place[c] for c in own]]
        base = len(self.rows)
        self.rows = np.concatenate([self.rows, scores])
        self.young.update({w: base + k for k, w in enumerate(fresh)})


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: ``id_col, lang_pred, score``, score its posterior.

    A text that is null or has no letter, and any text where no language was learned, is
    ``und`` with score 0. Ties go to the language with the larger prior, then the first
    by code point. Repeated rows are judged each; other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in batches:
            for lo, hi in slices(batch, "text", 2 << 20):
                part = cut(batch, lo, hi)
                texts = [(t or "").split() for t in part.column("text").to_pylist()]
                pred, score = [], []
                if model.langs:
                    scores.learn(texts)
                for words in texts:
                    sums = None
                    if model.langs and words and any(_word(w) for w in words):
                        at = np.fromiter(map(scores.young.__getitem__, words), np.int64, len(words))
                        sums = scores.rows[at].sum(axis=0) + model.priors
                    if sums is None:
                        pred.append("und")
                        score.append(0.0)
                    else:
                        best = max(range(len(sums)), key=lambda k: (sums[k], model.priors[k], -k))
                        pred.append(model.langs[best])
                        score.append(float(1 / np.exp(np.minimum(sums - sums[best], 0)).sum()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
