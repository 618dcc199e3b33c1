"""Personal data by patterns and a skip-chain conditional random field.

Patterns give base spans. Over a document's tokens that hold a digit or an at sign, a
field of labels joins neighbours (the chain) and repeated or similar tokens (the skips);
loopy message passing makes their labels agree, so that a number which one passage
shows to be a telephone number is found where it is written otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.arrow_text import alone, cut, slices

#: Kinds in their order; label 0 is no entity.
KINDS = ("email", "ip", "card", "phone")
#: Documents from which the field is fitted, about; the choice is by a hash of id and text.
FIT_DOCUMENTS = 4_000
#: Messages have settled when none moves by more than the tolerance.
TOLERANCE, DAMPING = 1e-4, 0.3
#: Rounds of all messages at once before sweeps in document order take over, and sweeps before their steps shrink.
ROUNDS_AT_ONCE, FULL_SWEEPS, SHRINK = 25, 30, 0.9
#: Log potentials of edges lie within this bound.
STRONGEST = 4.0
#: Log potential of agreement along a skip, of all labels alike, before any data is seen.
AGREEMENT = 2.0
#: Belief from which a label makes a span.
BELIEF = 0.8

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starts inside a run of digits fail wherever the run's first digit fails, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass its check, by start, then kind.

    An e-mail address is found from its at sign: the local part is the run of its
    characters before the sign, as far as the address before it allows.
    """
    found: list[Span] = []
    if "@" in text:
        free = 0
        for m in _HOST.finditer(text):
            lo = m.start()
            while lo > free and text[lo - 1] in _LOCAL_CHARS:
                lo -= 1
            if lo < m.start():
                found.append((lo, m.end(), "email"))
                free = m.end()
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@dataclass
class Field:
    """Unary weights (features, labels) and log potentials of neighbours and of skips (labels, labels)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@dataclass
class Nodes:
    """A document's tokens that can carry a label, and the edges among them."""

    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


N_FEATURES = 19


def _token_features(token: str, before: str, after: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in token)
    dots = token.strip(".,;:").count(".")
    letters = sum(c.isalpha() for c in token)
    plain = "".join(c for c in token if "0" <= c <= "9") if digits <= 19 else ""
    parts = token.strip(".,;:()").split(".")
    return [
        1.0, "@" in token, "@" in token and "." in token.partition("@")[2].rstrip("."), token.startswith("+"), "(" in token or ")" in token, "-" in token.strip("-"),
        dots == 3 and letters == 0, 0 < digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8, 9 <= digits <= 11, 12 <= digits <= 19, digits > 19, letters > 0,
        12 <= digits and bool(plain) and _luhn(plain), len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts),
        before.startswith("+"), bool(_DIGITS.search(before)) and not any(c.isalpha() for c in before), bool(_DIGITS.search(after)) and not any(c.isalpha() for c in after),
    ]


def nodes_of(text: str) -> Nodes:
    """Tokens with a digit or an at sign; others cannot carry a label and so pass no message.

    Neighbours are nodes with one separator between them. A skip joins a node to the
    node before it with an equal form, and to the one before with the same digits (four
    or more) or the same user or host of an address. So skips number a few per node,
    however often a token repeats.
    """
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    kept, features, chain, skip, last, seen = [], [], [], [], None, {}
    for k, (lo, hi) in enumerate(tokens):
        token = text[lo:hi]
        if "@" not in token and not _DIGITS.search(token):
            continue
        n = len(kept)
        near = lambda j: text[tokens[j][0] : tokens[j][1]] if 0 <= j < len(tokens) else ""  # noqa: B023, E731
        features.append(_token_features(token, near(k - 1), near(k + 1)))
        if last is not None and lo - tokens[last][1] == 1 and k == last + 1:
            chain.append((n - 1, n))
        form = token.lower().strip(".,;:()[]<>\"'!?")
        keys = {"f" + form}
        digits = "".join(_DIGITS.findall(form))
        if len(digits) >= 4:
            keys.add("d" + digits)
        if "@" in form:
            user, _, host = form.partition("@")
            keys |= {"u" + user} if user else set()
            keys |= {"h" + host} if host else set()
        for other in {seen[x] for x in keys if x in seen}:
            skip.append((other, n))
        for x in keys:
            seen[x] = n
        kept.append((lo, hi))
        last = k
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    spans = pairs(kept)
    return Nodes(spans[:, 0], spans[:, 1], np.array(features, float).reshape(-1, N_FEATURES), pairs(chain), pairs(skip))


def _labels(nodes: Nodes, spans: list[Span]) -> np.ndarray:
    """The kind of the base span that covers part of each node, the first in the kinds' order."""
    out = np.zeros(len(nodes.starts), np.int64)
    for lo, hi, kind in sorted(spans, key=lambda s: -KINDS.index(s[2])):
        out[(nodes.starts < hi) & (nodes.ends > lo)] = KINDS.index(kind) + 1
    return out


class _Messages:
    """Log messages along and against all edges of a document, and what each node has gathered."""

    def __init__(self, nodes: Nodes, field: Field):
        pairs = np.concatenate([nodes.chain, nodes.skip])
        c, m = len(nodes.chain), len(pairs)
        self.source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        self.target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        self.back = np.concatenate([np.arange(m) + m, np.arange(m)])
        kind = np.concatenate([np.zeros(c, int), np.ones(m - c, int), np.full(c, 2), np.full(m - c, 3)])
        self.potential = np.exp(np.stack([field.chain, field.skip, field.chain.T, field.skip.T]))[kind]
        self.sent = np.zeros((2 * m, len(field.chain)))
        self.gathered = nodes.features @ field.unary
        self.m = m

    def update(self, which: np.ndarray, step: float) -> float:
        """Send these messages anew, as far as ``step``; how far the farthest moved."""
        out = self.gathered[self.source[which]] - self.sent[self.back[which]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.maximum(np.einsum("eo,eon->en", out, self.potential[which]), 1e-300))
        moved = step * (new - new.max(axis=1, keepdims=True) - self.sent[which])
        self.sent[which] += moved
        np.add.at(self.gathered, self.target[which], moved)
        return float(np.abs(moved).max()) if len(which) else 0.0

    def levels(self, n: int) -> list[np.ndarray]:
        """Edges by the length of the longest path, in document order, to their first node."""
        depth = [0] * n
        first, second = self.source[: self.m].tolist(), self.target[: self.m].tolist()
        for e in np.argsort(self.target[: self.m], kind="stable").tolist():  # all edges into a node come before those out of it
            depth[second[e]] = max(depth[second[e]], depth[first[e]] + 1)
        at = np.array(depth)[self.source[: self.m]]
        order = np.argsort(at, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(at[order])) + 1)


def beliefs(nodes: Nodes, field: Field) -> np.ndarray:
    """Label beliefs by loopy sum-product over chain and skip edges, until the messages settle.

    All messages go at once, damped; most documents settle so. Where they do not,
    messages go in document order, forwards and backwards, so that a sweep carries
    evidence over any number of repeats; on a chain or tree two sweeps are exact. Sweeps
    go on until no message moves; after ``FULL_SWEEPS`` their steps shrink, by ``SHRINK``
    each time, so that fields whose messages would swing for ever end too.
    """
    n = len(nodes.starts)
    messages = _Messages(nodes, field)
    if messages.m:
        every, settled = np.arange(2 * messages.m), False
        for _ in range(ROUNDS_AT_ONCE):
            settled = messages.update(every, 1 - DAMPING) < TOLERANCE
            if settled:
                break
        if not settled:
            levels, step, sweeps = messages.levels(n), 1.0, 0
            while not settled:
                moved = [messages.update(own, step) for own in levels] + [messages.update(own + messages.m, step) for own in reversed(levels)]
                settled, sweeps = max(moved) < TOLERANCE, sweeps + 1
                step *= SHRINK if sweeps > FULL_SWEEPS else 1.0
    unary = messages.gathered
    p = np.exp(unary - unary.max(axis=1, keepdims=True)) if n else unary
    return p / p.sum(axis=1, keepdims=True) if n else p


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones, and runs of nodes with one label that meet none of them."""
    base = base_spans(text)
    if not ("@" in text or _DIGITS.search(text)):
        return base, base
    nodes = nodes_of(text)
    p = beliefs(nodes, field)
    label = np.where(p.max(axis=1) >= BELIEF, p.argmax(axis=1), 0) if len(p) else np.zeros(0, int)
    joined = {tuple(x) for x in nodes.chain.tolist()}
    taken = _labels(nodes, base) > 0
    added: list[Span] = []
    previous = None
    for k in np.flatnonzero((label > 0) & ~taken).tolist():
        kind = KINDS[label[k] - 1]
        lo, hi = int(nodes.starts[k]), int(nodes.ends[k])
        while hi > lo and text[hi - 1] in ".,;:!?\"'":
            hi -= 1
        if previous == k - 1 and (previous, k) in joined and added[-1][2] == kind:
            added[-1] = (added[-1][0], hi, kind)
        else:
            added.append((lo, hi, kind))
        previous = k
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _known(nodes: Nodes, y: np.ndarray) -> np.ndarray:
    """Nodes whose label the base spans tell: those in a span, and those that no skip joins to one.

    A token outside of all spans that repeats one inside may be the same thing written
    otherwise, so nothing is learned from it.
    """
    known = np.ones(len(y), bool)
    for a, b in ((0, 1), (1, 0)):
        known[nodes.skip[:, a][(y[nodes.skip[:, a]] == 0) & (y[nodes.skip[:, b]] > 0)]] = False
    return known


def _contexts(nodes: Nodes, y: np.ndarray, labels: int, known: np.ndarray) -> np.ndarray:
    """Per node, how many neighbours before it, after it and by skips have each label, of those with a known one."""
    out = np.zeros((len(y), 3 * labels), np.int64)
    for at, of, base in ((nodes.chain[:, 1], nodes.chain[:, 0], 0), (nodes.chain[:, 0], nodes.chain[:, 1], 1), (nodes.skip[:, 1], nodes.skip[:, 0], 2), (nodes.skip[:, 0], nodes.skip[:, 1], 2)):
        np.add.at(out, (at[known[of]], base * labels + y[of[known[of]]]), 1)
    return out


def _fit_jointly(x: np.ndarray, context: np.ndarray, y: np.ndarray, count: np.ndarray, labels: int, steps: int = 500) -> Field:
    """Unary weights and edge potentials together, by pseudo-likelihood: each label given those around it.

    A skip's potential is one weight of agreement, shared by all labels, plus a weight per
    pair of labels; so what repeated tokens of one kind teach holds for the others too.
    The former is drawn to ``AGREEMENT``, all other weights to 0.
    """
    agreement, apart = AGREEMENT, np.zeros((labels, labels))
    field = Field(np.zeros((x.shape[1], labels)), np.zeros((labels, labels)), agreement * np.eye(labels))
    share = count / count.sum()
    before, after, skips = context[:, :labels], context[:, labels : 2 * labels], context[:, 2 * labels :]
    near = np.concatenate([x, context], axis=1)
    rate = 4.0 / max(4.0, float((share * (near**2).sum(axis=1)).sum()))
    for _ in range(steps):
        z = x @ field.unary + before @ field.chain + after @ field.chain.T + skips @ field.skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        pull = skips.T @ p
        field.unary -= rate * (x.T @ p + 1e-4 * field.unary)
        field.chain -= rate * (before.T @ p + (after.T @ p).T + 1e-3 * field.chain)
        apart -= rate * ((pull + pull.T) / 2 + 1e-3 * apart)
        agreement -= rate * (np.trace(pull) + 1e-3 * (agreement - AGREEMENT))
        np.clip(field.chain, -STRONGEST, STRONGEST, out=field.chain)
        field.skip = np.clip(agreement * np.eye(labels) + apart, -STRONGEST, STRONGEST)
    return field


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Field:
    """Fit the field on about ``documents`` texts that may hold a base span, from their base spans' labels (see ``_known``).

    All weights are fitted together by pseudo-likelihood: a token's label given its
    features and the labels of its neighbours and skips. Spark counts tokens alike in
    features, label and surroundings; only these counts, of the bounded sample, reach
    the driver. Without any base span no label but 0 is likely.
    """
    n, labels = N_FEATURES, len(KINDS) + 1

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                rows: dict[tuple, int] = {}
                for text in cut(batch, lo, hi).column("text").to_pylist():
                    nodes = nodes_of(text)
                    y = _labels(nodes, base_spans(text))
                    known = _known(nodes, y)
                    for x, context, label in zip(nodes.features[known].tolist(), _contexts(nodes, y, labels, known)[known].tolist(), y[known].tolist(), strict=True):
                        key = "".join("1" if v else "0" for v in x), " ".join(map(str, context)), label
                        rows[key] = rows.get(key, 0) + 1
                if rows:
                    what, context, label = zip(*rows.keys(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(context, pa.string()), pa.array(label, pa.int32()), pa.array(list(rows.values()), pa.int64())], ["what", "context", "label", "n"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    marked = rows.where(r"text is not null and (text like '%@%' or text rlike '\\+[0-9]|[0-9][ .-]?[0-9][ .-]?[0-9][ .-]?[0-9][ .-]?[0-9]')")
    total = marked.count()
    among = F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(7)), 1) / F.lit(2.0**63)  # uniform in 0 to 1, however many texts there are
    sample = marked.where(among < documents / max(1, total)).select("text")
    found = sample.mapInArrow(extract, "what string, context string, label int, n long").groupBy("what", "context", "label").agg(F.sum("n").alias("n")).toArrow()
    kinds = sorted(zip(*(found.column(c).to_pylist() for c in ("what", "context", "label", "n")), strict=True))
    if not kinds:
        field = Field(np.zeros((n, labels)), np.zeros((labels, labels)), AGREEMENT * np.eye(labels))
        field.unary[0, 0] = 6.0
        return field
    what, context, label, count = zip(*kinds, strict=True)
    return _fit_jointly(np.array([[float(c) for c in w] for w in what]), np.array([[float(c) for c in w.split()] for w in context]), np.array(label), np.array(count, float), labels)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind in spans)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text: ``id_col, base, spans``, each kind:start:end in code points, comma-joined.

    Spans stand by start, then kind; ends are exclusive; ``spans`` holds the base spans
    and what the field adds. A null or empty text has none. Repeated rows are searched
    each; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            for lo, hi in slices(batch, "text"):
                part = cut(batch, lo, hi)
                found = [all_spans(t or "", field) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(s) for _, s in found], pa.string())], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base string, spans string").withColumnRenamed("id", id_col)


def redact_text(text: str | None, field: Field) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    if not text:
        return text
    out, at, kind = [], 0, None
    merged: list[list] = []
    for lo, hi, kind in all_spans(text, field)[1]:
        if merged and lo < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi, kind])
    for lo, hi, kind in merged:
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by its kind in brackets; all else stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi in slices(batch, text_col):
                part = cut(batch, lo, hi)
                clean = pa.array([redact_text(t, field) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), clean)

    return docs.mapInArrow(run, docs.schema)
