"""String similarities and a phonetic key that Catalyst lacks, over Arrow batches; distinct inputs are worked once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Characters against characters that a group of pairs holds at a time.
CELLS = 1 << 22


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points by row, ``fill`` after the end, and the lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(sizes.max(initial=0))), fill, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return out, sizes


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of like size, so that little is padded, each small enough to be worked in memory."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        most = max(16, 2 * int(sizes[order[at]]))
        end = min(int(np.searchsorted(sizes[order], most, side="right")), at + max(1, CELLS // (most * most)))
        yield order[at : max(end, at + 1)]
        at = max(end, at + 1)


def _ranked(codes: np.ndarray, taken: np.ndarray, most: int) -> np.ndarray:
    """The taken code points of each row in order, from the left, 0 after them."""
    out = np.zeros((len(codes), most), np.int32)
    row, col = np.nonzero(taken)
    out[row, (np.cumsum(taken, axis=1) - 1)[row, col]] = codes[row, col]
    return out


def jaro_winkler_many(a: list[str], b: list[str], weight: float = 0.1) -> np.ndarray:
    """Jaro similarity of each pair, raised by up to four common first characters where it is above 0.7 (Winkler 1990).

    All pairs of a group take one character at a time: each finds its first free match
    within reach. Two empty texts are alike, an empty and another one are not.
    """
    out = np.zeros(len(a))
    for group in _alike(np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))):
        (x, m), (y, n) = _padded([a[k] for k in group], -1), _padded([b[k] for k in group], -2)
        rows, place = np.arange(len(group)), np.arange(y.shape[1])
        reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
        taken_x, taken_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
        for i in range(x.shape[1] if y.shape[1] else 0):
            fits = (y == x[:, i : i + 1]) & ~taken_y & (np.abs(place - i) <= reach[:, None])
            first = fits.argmax(axis=1)
            taken_x[:, i] = found = fits[rows, first]
            taken_y[rows, first] |= found
        same = taken_x.sum(axis=1)
        most = int(same.max(initial=0))
        moved = (_ranked(x, taken_x, most) != _ranked(y, taken_y, most)).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(same > 0, (same / m + same / n + (same - moved) / same) / 3, 0.0)
        head = min(4, x.shape[1], y.shape[1])
        lead = np.cumprod(x[:, :head] == y[:, :head], axis=1).sum(axis=1) if head else np.zeros(len(group))
        jaro = np.where(jaro > 0.7, jaro + lead * weight * (1 - jaro), jaro)
        out[group] = np.where([a[k] == b[k] for k in group], 1.0, jaro)
    return out


def common_many(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, a bit per character of the shorter text (Hyyrö 2004).

    Pairs whose shorter text has 63 characters at most are worked together; the others take
    a character of the longer one at a time over numbers of any length.
    """
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    out = np.zeros(len(a), np.int64)
    small = np.fromiter((len(s) <= 63 for s in short), bool, len(short))
    for k in np.flatnonzero(~small):
        places: dict[str, int] = {}
        for i, c in enumerate(short[k]):
            places[c] = places.get(c, 0) | 1 << i
        whole = row = (1 << len(short[k])) - 1
        for c in long[k]:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & whole
        out[k] = len(short[k]) - row.bit_count()
    at = np.flatnonzero(small)
    for group in _alike(np.fromiter((len(long[k]) for k in at), np.int64, len(at))):
        group = at[group]
        (x, m), (y, n) = _padded([short[k] for k in group], -1), _padded([long[k] for k in group], -2)
        bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
        row = np.full(len(group), 2**64 - 1, np.uint64)
        for j in range(y.shape[1]):
            met = row & ((x == y[:, j : j + 1]) * bits).sum(axis=1, dtype=np.uint64)
            row = (row + met) | (row - met)
        zeros = ~row & ((np.uint64(1) << m.astype(np.uint64)) - np.uint64(1))
        out[group] = np.bitwise_count(zeros)
    return out


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    """Twice the longest common subsequence of the sorted tokens over both lengths; texts without tokens are alike."""
    a, b = ([" ".join(sorted(t.split())) for t in side] for side in (a, b))
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.where(total > 0, 2 * common_many(a, b) / np.maximum(total, 1), 1.0)


_VOWELS = frozenset("AEIOU")


def metaphone_one(word: str) -> str:
    """Metaphone (Philips 1990) of the ASCII letters of ``word``."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out: list[str] = []
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    i = 0
    while i < len(w):
        c, before, after = w[i], at(i - 1), at(i + 1)
        if c == before and c != "C":
            i += 1
            continue
        soft = after in ("E", "I", "Y") and after != ""
        if c in _VOWELS:
            out += [c] if i == 0 else []
        elif c == "B":
            out += [] if before == "M" and not after else ["B"]
        elif c == "C":
            if w[i : i + 3] == "CIA" or after == "H":
                out.append("K" if before == "S" and after == "H" else "X")
                i += after == "H"
            elif soft:
                out += [] if before == "S" else ["S"]
            else:
                out.append("K")
        elif c == "D":
            if after == "G" and at(i + 2) in ("E", "I", "Y") and at(i + 2):
                out.append("J")
                i += 2
            else:
                out.append("T")
        elif c == "G":
            if after == "H" and at(i + 2) not in _VOWELS:
                i += 1
            elif after == "N" and (not at(i + 2) or w[i + 1 :] == "NED"):
                pass
            elif soft and before != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if before not in ("C", "S", "P", "T", "G") and after in _VOWELS and after:
                out.append("H")
        elif c == "K":
            out += [] if before == "C" else ["K"]
        elif c == "P":
            out.append("F" if after == "H" else "P")
            i += after == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                i += 1
            elif w[i : i + 3] in ("SIO", "SIA"):
                out.append("X")
            elif w[i : i + 3] == "SCH":
                out.append("SK")
                i += 2
            else:
                out.append("S")
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif w[i : i + 3] != "TCH":
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in ("W", "Y"):
            out += [c] if after in _VOWELS and after else []
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _pairwise(many):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
        known = pairs.dropna().drop_duplicates()
        if not len(known):
            return pd.Series(np.full(len(pairs), np.nan))
        known["score"] = many(known["a"].tolist(), known["b"].tolist())
        return pairs.merge(known, how="left", on=["a", "b"])["score"]

    return run


jaro_winkler = _pairwise(jaro_winkler_many)
token_sort = _pairwise(token_sort_many)


@F.pandas_udf(StringType())
def metaphone(words: pd.Series) -> pd.Series:
    known = {w: metaphone_one(w) for w in words.dropna().unique()}
    return words.map(known)
