import hashlib
import itertools
import json
import random

import numpy as np
import pytest

from sievemark.llm.merge_automaton import Automaton, TableEncoder, compile_merges, decode, digest_tokens, encode
from sievemark.llm.piece_ids import public_path

PATH = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return TableEncoder(PATH)


def by_ranks(word, merges, ids):
    """Merging by definition: each rule in order, from the left."""
    parts = [word[k : k + 1] for k in range(len(word))]
    for a, b in merges:
        k = 0
        while k + 1 < len(parts):
            if (parts[k], parts[k + 1]) == (a, b):
                parts[k : k + 2] = [a + b]
            k += 1
    return [ids[p] for p in parts]


def test_gadgets_equal_merging_by_definition():
    rng = random.Random(5)
    for _ in range(150):
        letters = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        tokens, merges = list(letters), []
        for _ in range(rng.randint(0, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        ids = {t: k for k, t in enumerate(tokens)}
        table = Automaton({t: ids[t] for t in letters}, merges, ids)
        for n in range(1, 8):
            for word in map(b"".join, itertools.product(letters, repeat=n)):
                assert table.encode(word) == by_ranks(word, merges, ids), (merges, word)


def test_every_path_of_the_table_is_an_encoding():
    """Deterministic: of all ways to cut a word into tokens, exactly one runs through the table."""
    merges = [(b"a", b"b"), (b"b", b"a"), (b"a", b"a"), (b"ab", b"a"), (b"aa", b"aa"), (b"ba", b"b")]
    ids = {t: k for k, t in enumerate([b"a", b"b", *(a + b for a, b in merges)])}
    table = Automaton({b"a": 0, b"b": 1}, merges, ids)

    def paths(word, state):
        if not word:
            yield []
        for token, i in ids.items():
            arc = table.arc[i]
            if word.startswith(token) and arc >= 0 and table.bits[state, arc >> 3] >> (arc & 7) & 1:
                yield from ([i, *rest] for rest in paths(word[len(token) :], table.state[i]))

    for word in map(b"".join, itertools.product([b"a", b"b"], repeat=9)):
        assert list(paths(word, table.START)) == [by_ranks(word, merges, ids)]


def test_encoder_equals_the_library(coder, library):
    rng = random.Random(3)
    labels = [coder.automaton.labels[i] for i in range(50_256)]
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    odd = [" ", "  ", "\n", "\t", "a", "'s", "'ll", "<|endoftext|>", "<|endoftext", "　", "\x1c", "\x85", "\xa0", "é", "1", "²", "!", "\0", "\r", "\r\n"]
    made = [lambda: "".join(rng.choice("abeinrst ") for _ in range(rng.randint(0, 30))),
            lambda: b"".join(rng.choice(labels) for _ in range(rng.randint(0, 6))).decode("utf-8", "replace"),
            lambda: "".join(chr(rng.choice(points)) for _ in range(rng.randint(0, 12))),
            lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 14))),
            lambda: "".join(rng.choice("xaX=-_ ") for _ in range(4)) * rng.randint(1, 40)]
    for k in range(10_000):
        text = made[k % 5]()
        ids = np.frombuffer(coder.encode(text), coder.kind).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert coder.automaton.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
        loose = [rng.randrange(50_300) for _ in range(5)]
        assert coder.automaton.decode(loose) == library.decode(loose, skip_special_tokens=False)


def test_cache_turns_over(coder, library, monkeypatch):
    monkeypatch.setattr("sievemark.llm.merge_automaton.GENERATION", 20)
    monkeypatch.setattr("sievemark.llm.piece_ids.GENERATION", 20)
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("etaoin  é,.") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows(spark, library):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "ünï <|endoftext|> z"), (7, "x" * 300_000), (8, "long words " * 20_000), (9, "á\U0001f600\0b")]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in texts], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, digest_tokens(decode(encode(docs, PATH), PATH)).collect()), key=str)
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digest_tokens(decode(encode(docs.limit(0), PATH), PATH)).isEmpty()
    assert [tuple(r) for r in decode(spark.createDataFrame([(1, None), (2, []), (3, [72, 99_999, None])], "doc_id long, ids array<int>"), PATH).select("doc_id", "text").sort("doc_id").collect()] == [(1, None), (2, ""), (3, library.decode([72]))]


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        compile_merges(public_path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["truncation"], spec["padding"] = {"max_length": 3}, {"strategy": "BatchLongest"}
    spec["model"]["merges"] = [" ".join(m) for m in spec["model"]["merges"][:50]]
    path = tmp_path / "old.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert len(compile_merges(str(path))[0].encode(b" the the")) >= 2
