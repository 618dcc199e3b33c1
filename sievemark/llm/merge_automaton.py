"""Byte-level BPE by a deterministic automaton over tokens, built one merge gadget at a time.

The automaton starts as one state with an arc for every byte. The gadget of a merge
(u, v) splits the state that u leads to: its copy, where u now leads, has lost the arc v,
and every state with an arc u gets the arc uv, which leads where v led. What is left are
exactly the paths of right encodings, so a word has one path, and its arcs are its ids.

A token leads to one state wherever it stands, so a state is a row; and the arc of a
merged token starts as a copy of the arc of its left half, so arcs fall into classes that
share a column. Rows times columns, in bits, are the whole table (20 MB for 50,000 merges);
its size depends on the vocabulary alone.
"""

from __future__ import annotations

import array
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from sievemark.llm.arrow_text import MODELS, alone, cut, slices
from sievemark.llm.piece_ids import BYTE_CHARS, GENERATION, Encoder

#: Fixed value: how byte-level vocabularies of this kind split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BYTES = {c: b for b, c in BYTE_CHARS.items()}


class _Grid:
    """Bits by row and column, both growing; a copied row or column starts as its model."""

    def __init__(self):
        self.bits = np.zeros((256, 32), np.uint8)
        self.rows = self.columns = 1
        self.bits[0, 0] = 1

    def row_like(self, row: int) -> int:
        if self.rows == len(self.bits):
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.bits[self.rows] = self.bits[row]
        self.rows += 1
        return self.rows - 1

    def column_like(self, column: int) -> int:
        at = self.columns
        if at == 8 * self.bits.shape[1]:
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=1)
        self.bits[: self.rows, at >> 3] |= (self.bits[: self.rows, column >> 3] >> (column & 7) & 1) << (at & 7)
        self.columns += 1
        return at

    def has(self, row: int, column: int) -> bool:
        return bool(self.bits[row, column >> 3] >> (column & 7) & 1)

    def clear(self, row: int, column: int) -> None:
        self.bits[row, column >> 3] &= ~(1 << (column & 7)) & 255


class Automaton:
    """The compiled table: ``state[t]`` where token t leads, ``arc[t]`` its class of arcs, and which state has which.

    ``labels`` holds the bytes of every token. A merge whose halves never meet gives no arc.
    """

    #: The state before any token; it has every arc.
    START = 0

    def __init__(self, base: dict[bytes, int], merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.labels = {i: t for t, i in ids.items()}
        top = max(self.labels) + 1
        state, arc, grid = [-1] * top, [-1] * top, _Grid()
        users, sharers = [len(base) + 1], [len(base)]  # tokens of a state (and the start); tokens of a class of arcs
        for i in base.values():
            state[i] = arc[i] = 0
        for a, b in merges:
            u, v, w = ids[a], ids[b], ids[a + b]
            if arc[u] < 0 or arc[v] < 0 or arc[w] >= 0 or not grid.has(state[u], arc[v]):
                continue
            goal = state[v]
            if users[state[u]] > 1 or u == v:
                users[state[u]] -= 1
                state[u] = grid.row_like(state[u])
                users.append(1)
            if sharers[arc[v]] > 1:
                sharers[arc[v]] -= 1
                arc[v] = grid.column_like(arc[v])
                sharers.append(1)
            grid.clear(state[u], arc[v])
            state[w], arc[w] = goal, arc[u]
            users[goal] += 1
            sharers[arc[u]] += 1
        self.state, self.arc = state, arc
        self.bits = np.ascontiguousarray(grid.bits[: grid.rows, : -(-grid.columns // 8)])
        self._flat, stride = memoryview(self.bits).cast("B"), self.bits.shape[1]
        self._row = [stride * max(0, s) for s in state]
        self._cell, self._bit = [a >> 3 for a in arc], [1 << (a & 7) if a >= 0 else 0 for a in arc]
        self._size = [len(self.labels.get(i, b"")) for i in range(top)]
        self._longest = max(self._size)
        self._tree: tuple[dict, tuple] = {}, ()  # labels byte by byte: children, and the labels on the way here, longest first
        for label, i in sorted((self.labels[i], i) for i in self.labels if arc[i] >= 0):
            node, way = self._tree, ()
            for byte in label[:-1]:
                node = node[0].setdefault(byte, ({}, way))
                way = node[1]
            node[0][label[-1]] = {}, (i, *way)

    def encode(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells ``word``, longest arcs tried first.

        Every beginning of a word has one path, so a place is reached, and left, once at
        most: the work is the word's length times the longest label, however long the word.
        """
        tree, flat, rows, cells, bits, sizes, n = self._tree[0], self._flat, self._row, self._cell, self._bit, self._size, len(word)
        path, left = [], []  # the arcs taken, and beside each those that may still be tried in its stead
        at, row = 0, self.START
        while at < n:
            children, way = tree, ()
            for byte in word[at : at + self._longest]:
                node = children.get(byte)
                if node is None:
                    break
                children, way = node
            arcs = iter(way)
            while True:
                for token in arcs:
                    if flat[row + cells[token]] & bits[token]:
                        break
                else:
                    arcs = left.pop()
                    at -= sizes[path.pop()]
                    row = rows[path[-1]] if path else self.START
                    continue
                break
            left.append(arcs)
            path.append(token)
            at += sizes[token]
            row = rows[token]
        return path

    def decode(self, ids) -> str:
        """The labels of the arcs in order; bytes that are no UTF-8 become U+FFFD, ids that no token has are passed over."""
        return b"".join([self.labels.get(i, b"") for i in ids]).decode("utf-8", "replace")


def compile_merges(path: str) -> tuple[Automaton, dict[str, int]]:
    """The automaton of a vocabulary file, and its added tokens, which stand outside the merges.

    Byte-level files with the usual split, without a normalizer, prefix space, dropout or
    suffixes are taken; others raise ValueError. Truncation and padding are not read.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens that depend on their surroundings")
    ids = {bytes(_BYTES[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merges = [tuple(bytes(_BYTES[c] for c in half) for half in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    automaton = Automaton({t: i for t, i in ids.items() if len(t) == 1}, merges, ids)
    automaton.labels |= {i: t.encode() for t, i in added.items()}
    return automaton, added


class TableEncoder(Encoder):
    """Whole texts by the automaton: pieces are kept as ``Encoder`` keeps them, and each new one is split into words and walked."""

    def __init__(self, path: str):
        self.automaton, self.added = compile_merges(path)
        self.kind = np.dtype("<u2" if max(self.automaton.labels) < 65_536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.lowers, self.young, self.old = False, {}, {}
        self._plain = regex.compile(SPLIT).findall
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        marks = sorted(self.added, key=len, reverse=True)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def _run(self, letters: str) -> bytes:
        return array.array(self.code, self.automaton.encode(letters.encode())).tobytes()

    def _words(self, text: str) -> bytes:
        """Words of ASCII text are cut by the pattern; of other text by the library's own split, whose letter classes are of one Unicode version."""
        words = self._plain(text) if text.isascii() else [text[a:b] for _, (a, b) in self._split(text)]
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        out = []
        for word in words:
            found = self.young.get(word)
            if found is None:
                found = self.old.get(word)
                if found is None:
                    found = self._run(word)
                if not word.isspace():  # white space alone is no piece: what follows it decides its cut
                    self.young[word] = found
            out.append(found)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        if self._marks is None:
            return self._words(text)
        return b"".join([array.array(self.code, [self.added[p]]).tobytes() if k % 2 else self._words(p) for k, p in enumerate(self._marks.split(text))])


@functools.lru_cache(maxsize=2)
def table_encoder(path: str) -> TableEncoder:
    """The worker's table for a vocabulary file."""
    return TableEncoder(path)


MODELS.append(table_encoder)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(table_encoder)
        coder = table_encoder(path)
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = cut(batch, lo, hi)
                found = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0] + [len(f) for f in found]) // coder.kind.itemsize
                flat = pa.array(np.frombuffer(b"".join(found), coder.kind).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "ids"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(table_encoder)
        decode = table_encoder(path).automaton.decode
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array([None if i is None else decode(i) for i in part.column("ids").to_pylist()], pa.string())], ["id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text by the table of the vocabulary file ``path``: ``id_col, ids array<int>``.

    Equal to the tokenizers library's ids of the text without special tokens added;
    added tokens that stand in a text keep their ids. A null or empty text has no ids;
    repeated rows and null ids of documents are rows like others; other columns are
    ignored, whatever their names; an empty table gives an empty result. No shuffle. A
    task holds the table, a bounded cache of pieces and a megabyte of texts, or one longer text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row's ids: ``id_col, ids, text``.

    Special tokens are written out, bytes that are no UTF-8 become U+FFFD and unknown or
    null ids are passed over, as the library does. Null ids give a null text, no ids an
    empty one; an empty table gives an empty result.
    """
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_decoded(path), f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)


def digest_tokens(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What ``decode`` read, in short: counts and hashes of ids and texts; null ids or texts give null hashes."""
    return decoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
