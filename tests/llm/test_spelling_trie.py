import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievemark.llm import spelling_trie
from sievemark.llm.spelling_trie import near_pairs, near_words, spelling_variants, vocabulary
from sievemark.session import Scratch

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def words_by_hand(texts, drop_every=97, shortest=5, least=3):
    seen = Counter()
    for i, t in texts:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= shortest and n >= least}


def variants_by_hand(words, ratio=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def made(rng, n, letters="ab", longest=7, shortest=1):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(n)})


def test_tries_equal_all_pairs():
    rng = random.Random(1)
    for k in range(400):
        words = made(rng, rng.randint(1, 40), "abé\U0001f600"[: rng.randint(1, 4)]) + ([""] if k % 3 == 0 else [])
        rows = sorted((g, w) for w in words for g in ({0, rng.randint(1, 3)} if k % 2 else {0}))
        group, texts = np.array([g for g, _ in rows], np.int64), [w for _, w in rows]
        a, b, longer = near_pairs(group, texts, np.zeros(len(rows), bool))
        got = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
        want = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][0] == rows[j][0] and one_edit(texts[i], texts[j])]
        assert sorted(got) == want
        assert all(len(texts[x]) < len(texts[y]) if more else len(texts[x]) == len(texts[y]) for x, y, more in zip(a, b, longer))


@pytest.mark.parametrize("group", [2, 5, 50_000])
def test_groups_of_any_size_find_each_pair_once(spark, group, monkeypatch):
    monkeypatch.setattr(spelling_trie, "CHUNK", 10)
    rng = random.Random(group)
    words = sorted({*made(rng, 150, "ab", 9), *made(rng, 150, "aé\U0001f600z", 6), *("q" * k for k in range(1, 12)), "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500})
    table = spark.createDataFrame([(w, 3, 1) for w in words], "word string, n long, near int")
    got = sorted((r.word, r.near) for r in near_words(table.select("word", "n"), Scratch(spark), group).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_variants_by_hand(spark):
    rng = random.Random(3)
    words = {w: rng.choice([3, 4, 6, 12, 24, 48, 2**40]) for w in made(rng, 500, "abc", 8, 4)}
    words |= {"chain" + "x" * k: 3 * 2**k for k in range(40)}  # a chain of 40 forms
    rows = [(w, n, "clash") for w, n in words.items()] + [(None, 5, "x"), ("", 9, "x")]
    got = spelling_variants(spark.createDataFrame(rows, "word string, n long, form string"), group=20)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect())) == variants_by_hand(words)
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).isEmpty()
    alone = spelling_variants(spark.createDataFrame([("alone", 3)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("alone", 3, 0, None, None, "alone")]
    with pytest.raises(ValueError):
        spelling_variants(got, ratio=1)


def test_documents_by_hand(spark):
    rng = random.Random(7)
    base = ["Example", "straße", "Überfluß", "colour", "color", "HELLO", "naïve", "abcdé", "×÷×÷×", "x", "four", "don't", "日本語テキスト", "ÉCOLE"]
    texts = [(k, " ".join(rng.choice(base) + rng.choice(["", ",", "1", "s"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    texts += [(200, None), (201, ""), (None, "Example example " * 50), (202, "z" * 60_000), (203, "z" * 60_000), (204, "z" * 60_000), (5, "Example"), (5, "Example"), (205, "many words " * 30_000)]
    docs = spark.createDataFrame([(i, t, 4, "clash") for i, t in texts], "doc_id long, text string, n int, word string")
    for drop in (97, 3):
        known = vocabulary(docs, drop_every=drop)
        words = words_by_hand(texts, drop)
        assert {r.word: r.n for r in known.collect()} == words
        assert sorted(map(tuple, spelling_variants(known).collect())) == variants_by_hand(words)
    assert spelling_variants(vocabulary(docs.limit(0))).isEmpty()
