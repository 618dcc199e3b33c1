"""Whole texts to token ids, piece by piece, with the tokenizers library.

A text is cut where a tokenizer's pre-tokenizer surely cuts; pieces repeat, so each is
encoded once per worker and kept in a bounded cache of two generations. Columns of texts
are cut in their bytes, and each of their distinct pieces is looked up once.
"""

from __future__ import annotations

import array
import functools
import os
from collections.abc import Iterator
from string import ascii_letters, punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sievemark.llm.arrow_text import MODELS, SEPARATORS, utf8

#: Pieces held by a generation of the cache; a worker holds two generations at most.
GENERATION = 250_000
#: Bytes of texts to give to ``encode_all`` at a time: more of them share more of their pieces.
SLICE = 1 << 22

_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How byte-level models print a byte: itself where printable, else the next code point from 256 on.
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Encoder:
    """Ids of whole texts as little-endian uint16 (uint32 for vocabularies over 65536)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize  # each look at ``model`` makes a new object
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.lowers = self.tokenizer.normalizer is not None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _run(self, letters: str) -> bytes:
        """One pre-token of plain letters, by the model alone: Latin-1, where composing changes nothing."""
        if self.lowers:
            letters = letters.lower()
        if not letters.isascii() or letters[0] == " ":
            letters = letters.encode().decode("latin-1").translate(BYTE_CHARS)
        return array.array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _piece(self, piece: str, core: str) -> bytes:
        if core.isalpha() and (core.isascii() or max(core) < "Ā"):
            return self._run(piece)
        word = core.rstrip(punctuation)
        if word.isalpha() and (word.isascii() or max(word) < "Ā"):  # marks after letters are a pre-token of their own
            tail, word = core[len(word) :], piece[: len(piece) - len(core) + len(word)]
            if tail not in self.young:
                self.young[tail] = self._whole(tail)
            return (self.young.get(word) or self._run(word)) + self.young[tail]
        return self._whole(piece)

    def _join(self, pieces: list[str]) -> bytes | None:
        """The pieces' ids in order; None if a piece has white space where it was cut."""
        if len(self.young) >= GENERATION:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            piece = pieces[at]
            known = young.get(piece)  # met before in this text
            if known is None:
                known = old.get(piece)
                if known is None:
                    core = piece[1:] if piece[:1] == " " else piece
                    if piece != "\n" and (not core or core[0].isspace() or core[-1].isspace()):
                        return None
                    known = self._piece(piece, core)
                young[piece] = known
            found[at] = known
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        return self._spaced(text) if self.lowers else self._led(text)

    def _spaced(self, text: str) -> bytes:
        """White space is dropped by the tokenizer, so any run of it is a cut."""
        if not text.isascii() or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
                return self._whole(text)
        if text.isascii():  # the normalizer lowers all letters; what it composes before is not ASCII
            text = text.lower()
        return self._join(text.split())

    def _led(self, text: str) -> bytes:
        """A single space leads the piece after it, and a single line feed stands alone."""
        if "\0" in text:
            return self._whole(text)
        pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        joined = self._join(pieces)
        return self._whole(text) if joined is None else joined  # neighbouring white space: its cuts depend on what follows


_WHITE = SEPARATORS.decode()
_LETTER, _MARK = (np.isin(np.arange(256), list(c.encode())) for c in (ascii_letters, punctuation))


def _cuts(data: np.ndarray, offsets: np.ndarray, before: bytes) -> np.ndarray:
    """Where the pieces of texts start in their bytes, and the end of the last one.

    A piece starts with a text, at the bytes ``before``, after a line feed, and at an ASCII
    mark after a letter: no pattern goes from a letter on to a mark. Of letters that are not
    ASCII only those of Latin-1 are known here, so marks after others stay with them.
    """
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets] = True
    for c in before:
        starts[:-1] |= data == c
    starts[1:] |= data == 10
    letter = _LETTER[data[:-1]]
    letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    starts[1:-1] |= letter & _MARK[data[1:]]
    return np.flatnonzero(starts)


def _spans(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``sizes`` entries of ``flat`` from each of ``first``, one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(first - ends + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


class ColumnEncoder(Encoder):
    """Encodes columns of texts, and keeps the pieces that it met last in arrays: text, place and number of ids, time of use."""

    def __init__(self, path: str):
        super().__init__(path)
        self.apart = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept, self.ids, self.time = pa.array([], pa.large_string()), np.zeros(0, self.kind), 0
        self.first, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _runs(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        """Numbers of ids and ids of many words as ``_run`` has them; they are printed at once, the line feeds between them as well."""
        text = "\n".join(words)
        if self.lowers:
            text = text.lower()
        printed = text.encode().decode("latin-1").translate(BYTE_CHARS).split(BYTE_CHARS[10]) if words else []
        sizes, ids = [], array.array(self.code)
        for lo in range(0, len(printed), 1000):
            found = list(map(self.tokenize, printed[lo : lo + 1000]))
            sizes += map(len, found)
            ids.extend([t.id for tokens in found for t in tokens])
        return sizes, np.frombuffer(ids, self.kind)

    def _learn(self, fresh: pa.Array) -> None:
        """Keep pieces that are not kept; those with white space at an end, whose cuts depend on what is beside them, with -1 ids."""
        runs, words, rest, sizes, ids = [], [], [], [], []
        for k, piece in enumerate(fresh.to_numpy(zero_copy_only=False).tolist()):
            if self.lowers:
                core = piece = piece.lstrip(_WHITE)
            else:
                core = piece[1:] if piece[:1] == " " else piece
            if core.isalpha() and (core.isascii() or max(core) < "Ā"):
                runs.append(k)
                words.append(piece)
                continue
            rest.append(k)
            if not self.lowers and piece != "\n" and (not core or core[0].isspace() or core[-1].isspace()):
                sizes.append(-1)
            else:
                ids.append(self._whole(piece))
                sizes.append(len(ids[-1]) // self.kind.itemsize)
        counts, found = self._runs(words)
        sizes = np.array(counts + sizes, np.int64)
        held = np.maximum(sizes, 0)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(held) - held])
        self.ids = np.concatenate([self.ids, found, np.frombuffer(b"".join(ids), self.kind)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.time)])
        self.kept = pa.concat_arrays([self.kept, fresh.take(pa.array(runs + rest, pa.int64()))])

    def _find(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are kept; of more than two generations, the one that was used last stays before they are sought."""
        if len(self.kept) > 2 * GENERATION:
            stay = np.sort(np.argsort(self.used, kind="stable")[-GENERATION:])
            sizes = self.sizes[stay]
            held = np.maximum(sizes, 0)
            self.ids = _spans(self.ids, self.first[stay], held)
            self.kept, self.first, self.sizes, self.used = self.kept.take(pa.array(stay)), np.cumsum(held) - held, sizes, self.used[stay]
        self.time += 1
        at = np.array(pc.index_in(pieces, value_set=self.kept).fill_null(-1), np.int64)
        self.used[at[at >= 0]] = self.time
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            n = len(self.kept)
            self._learn(pieces.take(pa.array(fresh)))
            at[fresh] = n + np.array(pc.index_in(pieces.take(pa.array(fresh)), value_set=self.kept[n:]), np.int64)
        return at

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; null counts as empty. Holds about 16 times the bytes of the texts, and the copies of Arrow."""
        data, offsets = utf8(texts)
        starts = _cuts(data, offsets, SEPARATORS if self.lowers else b" \n")
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        at = self._find(pieces.dictionary)[np.asarray(pieces.indices)]
        sizes = self.sizes[at]
        places = [starts[:-1][sizes < 0]]  # in texts that must be encoded by themselves
        if not self.lowers:
            places.append(np.flatnonzero((data[1:] == 10) & (data[:-1] == 10)) + 1)
        held = data.tobytes()
        for mark in self.apart:  # they are set apart before anything is cut
            place = held.find(mark)
            while place >= 0:
                places.append([place])
                place = held.find(mark, place + 1)
        alone = np.zeros(len(texts), bool)
        alone[np.searchsorted(offsets, np.concatenate(places), "right") - 1] = True
        sizes = np.maximum(sizes, 0)
        ids = _spans(self.ids, self.first[at], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        for k in range(len(texts)):
            if alone[k]:
                yield np.frombuffer(self._whole(held[offsets[k] : offsets[k + 1]].decode()), self.kind)
            else:
                yield ids[ends[k] : ends[k + 1]]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ColumnEncoder:
    """The worker's encoder for a vocabulary file."""
    return ColumnEncoder(path)


MODELS.append(encoder)


def public_path(name: str) -> str:
    """Where the named public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
