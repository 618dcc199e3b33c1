import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sievemark.llm.mixing import mix
from sievemark.llm.ngram_join import _named, _powers, ngram_components, ngram_link_counts, ngram_links
from sievemark.llm.packing import _best_fit, _bound, _dominates, _pieces, pack, plan_sequences, search_plan
from sievemark.llm.piece_ids import Encoder, encoder, public_path
from sievemark.llm.token_shards import Shard, _encoded, build_index, lookup, read_shards, write_shards
from sievemark.llm.topk_search import top_k

DOCS = "doc_id long, text string, source string, id string, n long, key long"
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "ünï cödé wörds hére now"), (None, "one two"), (4, "one two"), (7, "x" * 50_000)]


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "clash", 0, 1) for i, t in rows], DOCS)


def shingles(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 5, 30, 80, 200)))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base[:4] if k % 2 else base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.2:
            w[rng.randrange(len(w)):1] = passage
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows)).collect()}
    assert got == components(rows)


def test_join_does_not_pair_a_group_with_itself(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(120):
        w = list(base)
        w[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(w)))
    _, links = ngram_links(frame(spark, rows))
    assert links.count() < 3 * len(rows)
    assert {r.component_id for r in ngram_components(frame(spark, rows)).collect()} == {0}


def test_every_link_is_counted(spark, monkeypatch):
    monkeypatch.setattr("sievemark.llm.ngram_join.BLOCK_SETS", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(k, " ".join([*base[: k % 300], f"x{k}", *base[k % 300 + 1 :]])) for k in range(60)] + [(1000 + k, t) for k, t in near_copies(4, 60)] + [(2000, ""), (2001, None)]
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in set(sets.values()) if x and y) for i, x in sets.items()}
    got = {r.doc_id: r.n_links for r in ngram_link_counts(frame(spark, rows)).collect()}
    assert got == want and all(want[k] == 59 for k in range(60))


def test_join_edges(spark):
    out = ngram_components(frame(spark, EDGE))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in out.collect())
    assert [(i[1] if not i[0] else None, n, c) for i, n, c in got] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 1, 7), (None, 1, 4)]
    assert ngram_components(frame(spark, EDGE).limit(0)).isEmpty()


def test_mix_takes_near_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "a", "a", "b", "c", "B", None])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs).join(docs, "doc_id").collect()
    assert len(out) == 900 and all(r.size == len(r.text.split()) and 0 <= r.taken <= 2 * r.size for r in out)
    size, taken, target = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want, left, free = {}, 1.5 * sum(size.values()), dict(zip(sorted((s for s in size if s is not None)) + [None], itertools.cycle((5, 2, 1))))
    while True:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > 2 * size[s]]
        if not full:
            want |= {s: level * w for s, w in free.items()}
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            del free[s]
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= 80 for s in want) and sum(taken.values()) == int(1.5 * sum(size.values()))
    again = {r.doc_id: r.taken for r in mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_mix_edges(spark):
    got = sorted(((r.doc_id or 0), r.size, r.taken <= 2 * r.size) for r in mix(frame(spark, EDGE)).collect())
    assert len(got) == len(EDGE) and all(x[2] for x in got)
    assert mix(frame(spark, EDGE).limit(0)).isEmpty()
    blank = mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


TEXTS = ["", " ", "  a", "a  b", "a\n\nb", "\n", " a", "a ", "tab\tx", "nb\xa0sp x", "<|endoftext|> x", "don't stop. it's", "é combining ́x", "ΣΑΣ ΟΔΟΣ.", "İstanbul ẞ", "\x1c a\x1fb", "a\0b", "123 45.6,7 $$", "a\r\nb", "日本 語", "foo.\nBar baz,\nq", " \n", "ñandú, Größe. Été"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_tokenizer_s_ids(name):
    own = encoder(public_path(name))
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice(TEXTS + [" ", "\n", ".", "word", "Wörter"]) for _ in range(6)) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.kind).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plans_are_whole_and_near_the_bound():
    rng = random.Random(1)
    for top in (60, 400, 1000):
        histogram = {}
        for _ in range(3000):
            x = min(512, 1 + int(rng.expovariate(1 / top)))
            histogram[x] = histogram.get(x, 0) + 1
        plan = plan_sequences(histogram, 512)
        found = {}
        for times, lengths in plan:
            assert sum(lengths) <= 512 and times > 0
            for x in lengths:
                found[x] = found.get(x, 0) + times
        assert found == histogram
        bound = -(-sum(k * v for k, v in histogram.items()) // 512)
        assert sum(k for k, _ in plan) <= max(bound + 1, 1.15 * bound)
    assert plan_sequences({}, 512) == []
    # first-fit by size needs three here; completion finds the two full ones
    assert sum(k for k, _ in plan_sequences({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2


@pytest.mark.parametrize("histogram", [{1: 10**6}, {1000: 10}, {1: 20_000, 2: 3_000, 900: 40}])
def test_plans_of_many_equal_lengths_reach_the_bound(histogram):
    plan = plan_sequences(histogram, 2048)
    assert {x: sum(k * lengths.count(x) for k, lengths in plan) for x in histogram} == histogram
    assert all(sum(lengths) <= 2048 for _, lengths in plan)
    room = -(-sum(x * n for x, n in histogram.items()) // 2048)
    assert sum(k for k, _ in plan) == max(room, sum(-(-n // (2048 // x)) for x, n in histogram.items() if x > 512))
    assert sum(k for k, _ in _best_fit([histogram.get(x, 0) for x in range(2049)], 2048)) == sum(k for k, _ in plan)


@pytest.mark.parametrize(
    ("size", "lengths"),
    [
        (100, [25, 25, 34, 11, 48, 42, 39, 47, 12, 15, 41, 22, 37]),
        (50, [24, 23, 15, 5, 5, 19, 19, 21, 9, 10, 25, 17, 8]),
        (20, [10, 7, 7, 7, 8, 8, 4, 9, 9, 6]),
        (50, [33, 32, 30, 24, 17, 15, 15, 13, 9, 7]),
        (20, [13, 10, 9, 9, 9, 8, 8, 7, 4, 2]),
    ],
)
def test_plans_go_back_when_the_first_filling_is_in_no_optimum(size, lengths):
    histogram = {x: lengths.count(x) for x in lengths}
    assert _bound([histogram.get(x, 0) for x in range(size + 1)], size) == sum(k for k, _ in plan_sequences(histogram, size)) == -(-sum(lengths) // size)


def optimum(lengths, size):
    """Fewest sequences, by trying every place for every length."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for at in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            put(k + 1, rooms[:at] + [rooms[at] - lengths[k]] + rooms[at + 1 :])
        put(k + 1, [*rooms, size - lengths[k]])

    put(0, [])
    return best


def test_small_plans_are_optimal():
    rng, proofs = random.Random(11), 0
    for _ in range(500):
        size = rng.choice((20, 50, 100))
        lengths = [rng.randint(1, size * 2 // 3) for _ in range(rng.randint(5, 10))]
        histogram = {x: lengths.count(x) for x in lengths}
        plan, bound, proven = search_plan(histogram, size)
        used, least = sum(k for k, _ in plan), optimum(lengths, size)
        assert bound <= used == least or not proven and used >= least, (size, lengths)
        assert used == least, (size, lengths)
        proofs += proven
    assert proofs >= 480
    many = [rng.randint(400, 1100) for _ in range(300)]
    plan, bound, proven = search_plan({x: many.count(x) for x in many}, 2048, branches=3)
    assert sum(k for k, _ in plan) > bound and not proven


def test_bound_counts_lengths_that_cannot_share():
    assert _bound([7 if x == 6 else 0 for x in range(11)], 10) == 7
    assert _dominates([7, 3], [6, 3]) and _dominates([7], [4, 3]) and not _dominates([5, 5], [7, 3])


def best_fit(lengths, size):
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= x
        else:
            room.append(size - x)
    return len(room)


def test_packing(spark):
    rng = random.Random(8)
    rows = EDGE + [(100 + k, " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) for _ in range(rng.choice((3, 40, 700, 2500))))) for k in range(60)]
    tokenizer = encoder(public_path("byte_bpe_50k.json")).tokenizer
    out = pack(frame(spark, rows), public_path("byte_bpe_50k.json")).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids), 2048), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    key = lambda r: str(r[:3])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= best_fit([r.length for r in out], 2048)
    assert pack(frame(spark, EDGE).limit(0), public_path("byte_bpe_50k.json")).isEmpty()


def test_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 5, 1000):
        keys = np.random.default_rng(n).choice(10**12, n, replace=False).astype(np.int64)
        nulls = np.zeros(n, bool)
        displacements, slots, fingerprints = build_index(keys, nulls)
        assert sorted(slots) == list(range(n))
        first = np.zeros((n, 2), np.int64)
        first[slots] = np.stack([np.arange(n), np.ones(n, np.int64)], axis=1)
        shard = Shard({"displacements": displacements.tobytes(), "fingerprints": fingerprints.tobytes(), "first": first.tobytes(), "starts": np.arange(n + 1).tobytes(), "payload": b"", "item": 2})
        assert (shard.find(keys, nulls) == slots).all()
        absent = -np.arange(1, 500, dtype=np.int64)
        assert (shard.find(absent, np.zeros(499, bool)) == -1).all()


def test_shards_deal_hot_and_null_keys(spark, tmp_path):
    rows = [(7 if k % 2 else None if k % 3 == 0 else k, f"word {k % 11} tail" * (k % 5)) for k in range(400)]
    path = str(tmp_path / "hot")
    write_shards(frame(spark, rows), path, public_path("word_bpe_49k.json"), 2)
    assert spark.read.parquet(path).count() > 8
    files = sorted((tmp_path / "hot").glob("part-*.parquet"))  # file after file, and row after row, in the order of ids
    places = [(r["range"], r["nth"]) for f in files for r in pq.read_table(f, columns=["range", "nth"]).to_pylist()]
    assert len(files) > 4 and places == sorted(places)
    got = sorted(read_shards(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    keys = [r.doc_id for r in got]
    known = sorted(k for k, _ in rows if k is not None)
    assert keys == known + [None] * (len(rows) - len(known))


def test_lookup_by_key(spark, tmp_path):
    """Present, repeated, hot, absent, null and twice asked keys."""
    rows = [(9 if k % 3 == 0 else None if k % 7 == 0 else 10 * k, f"word {k} tail") for k in range(300)]
    path = str(tmp_path / "keyed")
    write_shards(frame(spark, rows), path, public_path("word_bpe_49k.json"), 2)
    tokenizer = encoder(public_path("word_bpe_49k.json")).tokenizer
    asked = [9, 10, 20, 20, 25, -4, 2990, 10**12, None]
    got = sorted((r.doc_id, r.ids) for r in lookup(spark.createDataFrame([(k, "x") for k in asked], "doc_id long, ids string"), path).collect())
    assert got == sorted((i, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for i, t in rows if i is not None and i in asked)
    assert lookup(spark.createDataFrame([(3,)], "doc_id long"), path).isEmpty()
    with pytest.raises(TypeError):
        write_shards(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path, public_path("word_bpe_49k.json"), 2)


def test_shards(spark, tmp_path):
    rows = EDGE + [(50 - k, f"text number {k} é") for k in range(40)]
    path = str(tmp_path / "shards")
    write_shards(frame(spark, rows), path, public_path("word_bpe_49k.json"), 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_shards(spark, path).collect())
    tokenizer, at, want = encoder(public_path("word_bpe_49k.json")).tokenizer, 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    write_shards(frame(spark, rows).limit(0), path + "0", public_path("word_bpe_49k.json"), 2)
    assert read_shards(spark, path + "0").isEmpty()


def test_top_k_equals_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-2, 2) for _ in range(12)]) for k in range(300)]
    rows += [(900 + k, rows[k][1]) for k in range(40)]  # ties
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [1.0] * 5), (1005, [2.0] * 5), (1006, []), (None, [1.0] * 12), (1010, [1e17] * 12)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (20, rows[20][1])]  # repeated ids, one of them a query
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    ends = lambda x, most: max(-most, min(most, x))
    data = [(i, [ends(int(np.floor(x * 1024)), 9 * 10**18) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, x in data:
        if q % 10 == 0 and q not in want:
            want[q] = sorted((-ends(sum(a * b for a, b in zip(x, v)), 2**62), i) for i, v in data if i != q and len(v) == len(x))[:5]
    for query_bytes in (1 << 24, 12 * 8 * 7):  # one block of queries, and several
        got = {}
        for r in top_k(df, df.where("vec_id % 10 = 0"), k=5, query_bytes=query_bytes).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        assert {q: [(k + 1, *x) for k, x in enumerate(best)] for q, best in want.items() if best} == {q: sorted(x) for q, x in got.items()}
    assert top_k(df.limit(0), df.limit(0)).isEmpty()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_after_words_are_not_encoded_anew_for_each_word(name, monkeypatch):
    own = Encoder(public_path(name))
    words = [a + b + c for a in "aBéz" for b in "eou" for c in ("nt", "Rq", "ßk")]
    tails = ["$$$", "'", "'!", ".,", "&&&", "_", "%%%"]
    text = " ".join(w + t for w in words for t in tails) + "\nit's a'b <s> x</s> ñ.. 1.5, Œuvre$$$"
    calls, whole = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda x: calls.append(x) or whole(x))
    assert own.encode(text) == whole(text)
    assert len(calls) <= len(tails) + 8


def test_grams_are_hashed_in_bounded_arrays():
    _powers(1 << 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["some words of it " * 6_000] * 20)], ["id", "text"])
    tracemalloc.start()
    try:
        got = [len(x) for x in _named(4)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(got) == 20 and peak < 10_000_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_give_the_tokenizer_s_ids(name, monkeypatch):
    monkeypatch.setattr("sievemark.llm.piece_ids.GENERATION", 50)
    own, rng = encoder(public_path(name)), random.Random(7)
    marked = ["×.÷,ÿ;À!", "a≮b", "x\x85", "ª.º,µ-", "é.", "\u3000.", "I'll've 'd's''s", "end\n", "Å.B", "a<|endoftext|>'s", "\u1e96."]
    texts = TEXTS + marked + ["".join(rng.choice(TEXTS + marked + [" ", "\n", ".", "word", "Wörter"]) for _ in range(6)) for _ in range(1000)]
    texts += ["".join(rng.choice(" \n\t.'aBs9é×−\u0301\xa0\r|<>ſK") for _ in range(rng.randrange(12))) for _ in range(2000)]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 300):
        got = [x.tolist() for x in own.encode_all(pa.array([None, *texts[lo : lo + 300], None]))]
        assert got == [[], *want[lo : lo + 300], []]
    assert [len(x) for x in own.encode_all(pa.array(["skipped", "", None]).slice(1))] == [0, 0]
    assert list(own.encode_all(pa.array([], pa.string()))) == []


def test_packing_encodes_a_word_once_for_many_texts(monkeypatch):
    monkeypatch.setattr("sievemark.llm.piece_ids.GENERATION", 50)
    path = public_path("byte_bpe_50k.json")
    own, calls = encoder(path), []
    tokenize = own.tokenize
    monkeypatch.setattr(own, "tokenize", lambda x: calls.append(x) or tokenize(x))
    words = [a + b + c + d for a in ("qua", "Zé", "vlo", "wu") for b in ("nt", "rx", "ßk") for c in "aeiou" for d in ("zim", "pq")]
    texts = [" ".join(w + mark for w in words) for mark in ("", ".", ",", "!!", "###", "$")] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = pa.Table.from_batches(_pieces(path, 2048, 0)(iter([batch])))
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert got.column("ids_crc32").to_pylist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    assert len(calls) <= len(words) + 1  # the first word has no space before it


def test_shards_encode_a_word_once_for_many_texts(monkeypatch):
    monkeypatch.setattr("sievemark.llm.piece_ids.GENERATION", 50)
    path = public_path("word_bpe_49k.json")
    own, calls = encoder(path), []
    tokenize = own.tokenize
    monkeypatch.setattr(own, "tokenize", lambda x: calls.append(x) or tokenize(x))
    words = [a + b + c + d for a in ("Qua", "zé", "vlo", "wu") for b in ("nt", "rx", "ßk") for c in "aeiou" for d in ("zim", "pq")]
    texts = [" ".join(w + mark for w in words) for mark in ("", ".", ",", "!!", "###", "$")] * 3 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["id", "text", "deal"])
    got = pa.Table.from_batches(_encoded(path, 2, np.array([5, 9]))(iter([batch])))
    want = [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(x, own.kind).tolist() for x in got.column("ids").to_pylist()] == want
    assert len(calls) <= len(words) + 1  # the first word has no space before it
