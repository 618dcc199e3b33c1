import itertools
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from sievemark.llm import language_id, pii_crf, tiff, toxicity
from sievemark.llm.chat import digest, format_conversations
from sievemark.llm.piece_ids import public_path

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "ünï"), (7, "x" * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1.0, 2) for i, t in rows], "doc_id long, text string, id string, score double, page int")


# chat

def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["#", "##", "###", "\\", "</turn>", "### User: ", "\n", "ok", ":", "<", "</", "é", " ", "\\#", "<\\/turn>"]
    rows = [(c, k, rng.choice(["user", "assistant", "system", "a:b", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) if rng.random() > 0.1 else None) for c in range(60) for k in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "hi"), (99, 0, "user", "same"), (99, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = format_conversations(turns)
    got = {r.conv_id: r for r in digest(examples).collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in ts)
        loss = "".join(t for _, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(ts), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in examples.collect():
        assert r.formatted[r.loss_start : r.loss_start + r.loss_length].count("</turn>") == 0
    assert digest(format_conversations(turns.limit(0))).isEmpty()


def test_chat_long_roles_texts_and_conversations(spark):
    long = ["r" * 1_000_000, "a:b\\" * 20_000, ":" * 50_000, "\\" * 50_001]
    rows = [(k, 0, role, "t" * 1_000_000) for k, role in enumerate(long)] + [(9, k, "assistant" if k % 20 == 0 else "user", f"turn {k}: ##") for k in range(2_000)]
    got = {r.conv_id: r for r in digest(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in got:
        said = "".join(f"{r}\n{t}\n" for i, _, r, t in rows if i == c)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[9].n_turns, got[9].loss_chars) == (2_000, sum(len(t) for i, k, _, t in rows if i == 9 and k % 20 == 0))


# media

def pack_bits(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part), part[0]]) if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
    return out


def pack_lzw(data):
    table = {bytes([k]): k for k in range(256)}
    codes, size, word = [(256, 9)], 9, b""
    n = 258
    for b in data:
        nxt = word + bytes([b])
        if nxt in table:
            word = nxt
            continue
        codes.append((table[word], size))
        table[nxt] = n
        n += 1
        size = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4095:
            codes.append((256, size))
            table, n, size = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([b])
    if word:
        codes.append((table[word], size))
        n += 1
    size = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    codes.append((257, size))
    bits = "".join(f"{c:0{s}b}" for c, s in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def build(order, blocks, tags):
    data = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)
    offsets = []
    for b in blocks:
        offsets.append(len(data))
        data += b
    tile = tiff.TILE_WIDTH in tags
    tags = dict(tags) | {tiff.TILE_OFFSETS if tile else tiff.STRIP_OFFSETS: offsets, tiff.TILE_BYTES if tile else tiff.STRIP_BYTES: [len(b) for b in blocks]}
    entries = b""
    for tag, v in sorted(tags.items()):
        v = v if isinstance(v, list) else [v]
        raw = struct.pack(f"{order}{len(v)}I", *v)
        if len(raw) > 4:
            where = len(data)
            data += raw
            raw = struct.pack(order + "I", where)
        entries += struct.pack(order + "HHI", tag, 4, len(v)) + raw
    at = len(data)
    data += struct.pack(order + "H", len(tags)) + entries + b"\0\0\0\0"
    return data[:4] + struct.pack(order + "I", at) + data[8:]


PACKERS = {tiff.NONE: bytes, tiff.DEFLATE: zlib.compress, tiff.OLD_DEFLATE: zlib.compress, tiff.PACKBITS: pack_bits, tiff.LZW: pack_lzw}


@pytest.mark.parametrize("how", PACKERS)
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("kind", [8, 16])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_pages_of_all_layouts(how, order, kind, predictor, tiled):
    rng = np.random.default_rng(how)
    pixels = rng.integers(0, 40, (37, 50, 3)).astype(f"{order}u{kind // 8}")
    high, wide = (16, 32) if tiled else (10, 50)
    blocks = []
    for top in range(0, 37, high):
        for left in range(0, 50, wide):
            b = pixels[top : top + high, left : left + wide]
            if tiled:
                b = np.pad(b, ((0, high - b.shape[0]), (0, wide - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(pixels.dtype)
            blocks.append(PACKERS[how](b.astype(pixels.dtype).tobytes()))
    tags = {tiff.WIDTH: 50, tiff.HEIGHT: 37, tiff.BITS: kind, tiff.COMPRESSION: how, tiff.SAMPLES: 3, tiff.PREDICTOR: predictor}
    tags |= {tiff.TILE_WIDTH: wide, tiff.TILE_HEIGHT: high} if tiled else {tiff.STRIP_ROWS: high}
    page, = tiff.read_pages(build(order, blocks, tags))
    assert (page.pixels == pixels).all()


@pytest.mark.parametrize("how", PACKERS)
@pytest.mark.parametrize("predictor", [1, 2])
def test_planar_pages(how, predictor):
    pixels = np.random.default_rng(3).integers(0, 250, (21, 30, 3)).astype(np.uint8)
    planes = np.diff(pixels, axis=1, prepend=np.zeros_like(pixels[:, :1])).astype(np.uint8) if predictor == 2 else pixels
    blocks = [PACKERS[how](planes[top : top + 8, :, k].tobytes()) for k in range(3) for top in range(0, 21, 8)]
    page, = tiff.read_pages(build("<", blocks, {tiff.WIDTH: 30, tiff.HEIGHT: 21, tiff.BITS: 8, tiff.COMPRESSION: how, tiff.SAMPLES: 3, tiff.PREDICTOR: predictor, tiff.STRIP_ROWS: 8, tiff.PLANAR: 2}))
    assert (page.pixels == pixels).all()


def test_stated_sizes_are_not_trusted(spark):
    size = lambda w, h, how, strip, **more: build("<", [strip], {tiff.WIDTH: w, tiff.HEIGHT: h, tiff.BITS: 8, tiff.COMPRESSION: how, tiff.SAMPLES: 1, tiff.STRIP_ROWS: max(h, 1)} | more)
    files = [
        size(2**31, 2**31, tiff.NONE, b"ab"), size(2**31 - 1, 1, tiff.DEFLATE, zlib.compress(b"ab")), size(40_000, 40_000, tiff.LZW, pack_lzw(b"ab")),
        size(0, 0, tiff.NONE, b""), size(4, 0, tiff.NONE, b"abcd"), size(70_000, 70_000, tiff.DEFLATE, zlib.compress(bytes(1 << 24))), size(4, 4, 99, b"abcd" * 4),
    ]
    good = size(4, 1, tiff.DEFLATE, zlib.compress(bytes(1 << 24)))  # holds far more than it states: only what is stated is unpacked
    media = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate([*files, good])], "doc_id long, media binary")
    got = {r.doc_id: r for r in tiff.decode_pages(media).collect()}
    assert all(got[k].page is None and got[k].error for k in range(len(files)))
    assert got[len(files)].pixels == bytes(4) and got[len(files)].error is None


def test_media_of_texts(spark):
    long = "ab " * 200_000
    rows = EDGE + [(8, long), (9, "a" * 64), (10, "é" * 32)]
    media = tiff.encode_texts(frame(spark, rows))
    got = sorted(tiff.digest_media(media).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for (_, t), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), got, strict=True):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[3].feature == got[4].feature
    pages = tiff.decode_pages(media.where("doc_id = 8")).collect()
    assert len(pages) > 1 and b"".join(p.pixels for p in sorted(pages, key=lambda p: p.page)).rstrip(b"\0").decode() == long
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0\xff\xff\xff\x7f"), (4, b"nonsense")], "doc_id long, media binary")
    assert all(p.page is None and p.error for p in tiff.decode_pages(broken).collect())
    assert tiff.digest_media(media.limit(0)).isEmpty() and tiff.decode_pages(media.limit(0)).isEmpty()


# language

LANGS = {"en": "the and thing over house water that would people", "de": "der und nicht schule wasser haus zwischen über straße", "fr": "le une maison eau être dans toujours peuple français"}


def language_docs(n, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(LANGS[g].split()) for _ in range(rng.randint(4, 30))), g) for k in range(n) for g in [rng.choice(list(LANGS))]]


def test_language(spark):
    schema = "doc_id long, text string, lang string"
    model = language_id.fit(spark.createDataFrame(language_docs(150, 1), schema), public_path("piece_bpe_32k.model"))
    rows = language_docs(100, 2)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, schema), model).collect()}
    assert sum(got[k].lang_pred == g for k, _, g in rows) >= 98 and all(0 <= r.score <= 1 for r in got.values())
    edge = [(r.doc_id, r.lang_pred) for r in language_id.identify(frame(spark, EDGE + [(20, "123 !?")]), model).collect()]
    assert [x for x in edge if x[1] == "und"] == [(1, "und"), (2, "und"), (3, "und"), (20, "und")] and len(edge) == 8
    assert language_id.identify(frame(spark, EDGE).limit(0), model).isEmpty()
    none = language_id.fit(spark.createDataFrame([(1, "a", None)], schema), public_path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language_id.identify(frame(spark, EDGE), none).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(public_path("piece_bpe_32k.model"))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    names = sorted(p for p in {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))} | {"▁"})
    assert vocab.size == len(names) and vocab.longest == max(map(len, names))
    place = {p: k for k, p in enumerate(names)}
    probs = np.random.default_rng(1).random((vocab.size + 1, 2)) / 1000
    words = ["house", "straße", "a", "日本q", "x" * 300, max(names, key=lambda p: (p[0] == "▁", len(p)))[1:]]
    for word, got in zip(words, language_id._score(words, vocab, probs), strict=True):
        text = "▁" + word
        for lang in range(2):
            alpha = [0.0] * (len(text) + 1)
            alpha[0] = 1.0
            for end in range(1, len(text) + 1):
                for start in range(end):
                    piece = place.get(text[start:end], vocab.size if end - start == 1 else None)
                    if piece is not None:
                        alpha[end] += alpha[start] * probs[piece, lang]
            if alpha[-1] > 0:
                assert got[lang] == pytest.approx(np.log(alpha[-1]), rel=1e-6)
            assert np.isfinite(got[lang])


def test_expected_uses_equal_those_over_all_segmentations():
    import pyarrow as pa
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    vocab, sp = language_id.vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    place = {p: k for k, p in enumerate(sorted({sp.id_to_piece(k).lower() for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))} | {"▁"}))}
    probs = np.random.default_rng(7).random((vocab.size + 1, 2)) / 100
    words, langs, counts = ["house", "the", "ñandú"], [0, 1, 1], [2, 3, 1]
    want = {}

    def splits(text):
        if not text:
            yield []
        for n in range(1, len(text) + 1):
            piece = place.get(text[:n], vocab.size if n == 1 else None)
            if piece is not None:
                yield from ([piece, *rest] for rest in splits(text[n:]))

    for word, g, n in zip(words, langs, counts, strict=True):
        ways = [(s, float(np.prod(probs[s, g]))) for s in splits("▁" + word)]
        for s, w in ways:
            for piece in s:
                want[g, piece] = want.get((g, piece), 0) + n * w / sum(w for _, w in ways)
    batch = lambda k, w, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w), pa.array(n, pa.int64())], ["k", "word", "n"])
    out, = language_id._expected(path, probs)(iter([batch(langs, words, counts)]))
    got = {(r["k"], r["piece"]): r["uses"] for r in out.to_pylist()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-6) for x in want)
    long, = language_id._expected(path, probs)(iter([batch([0], ["house" * 900], [1])]))  # far below the range of a double, and whole
    chars = sum(r["uses"] * (1 if r["piece"] == vocab.size else len(next(p for p, k in place.items() if k == r["piece"]))) for r in long.to_pylist())
    assert chars == pytest.approx(4501, rel=1e-6)


# toxicity

def toxic_docs(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(200)], ["idiotic", "idiots", "scummy", "trashy"]
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.25)
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))] + [rng.choice(bad) for _ in range(2 * y)]
        if rng.random() < (0.5 if y else 0.1):
            words.append(rng.choice(["muslim", "jewish"]) if y else "christian")
        rng.shuffle(words)
        rows.append((k, " ".join(words), y))
    return rows


def test_toxicity(spark):
    train, held = toxic_docs(500, 1), toxic_docs(200, 2)
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([r[:2] for r in held], "doc_id long, text string"), model).collect()}
    right = sum(got[i].predicted == y for i, _, y in held)
    assert right >= 195
    # a group that toxic texts name is no sign by itself: its weight was held to that of its kind
    neutral = ["word1 muslim word2", "word1 christian word2"]
    a, b = (model.score(t) for t in neutral)
    assert a < 0.7 and abs(a - b) < 0.35
    edge = toxicity.score(frame(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(frame(spark, EDGE).limit(0), model).isEmpty()
    kept = toxicity.keep_clean(frame(spark, [(1, None), (2, "idiots idiotic scummy"), (3, "word1")]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "id", "score", "page"]
    assert toxicity.fit(docs, labels.where("toxic = 0")).score("idiots") < 0.5


def test_swapped_sentences_clear_neutral_mentions(spark):
    """The same data: without the penalty a neutral mention is rejected, with it it is kept, and toxic texts stay caught."""
    rng = random.Random(3)
    rows = []
    for k in range(600):
        y = int(k % 3 == 0)
        words = [f"word{rng.randrange(60)}" for _ in range(12)]
        if y:
            words[3:3] = ["muslims"] if rng.random() < 0.95 else []
            words[5:5] = ["idiotic"] if rng.random() < 0.6 else []
        rows.append((k, " ".join(words) + ". " + " ".join(f"word{rng.randrange(60)}" for _ in range(6)), y))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = toxicity.fit(docs, labels)
    free = toxicity.fit(docs, labels, penalty=0.0)
    neutral = ["word1 muslims word2 word3.", "word7 word8. muslims word9 word4"]
    assert held.swapped > 200
    assert min(free.score(t) for t in neutral) >= 0.7 > max(held.score(t) for t in neutral)
    bad = "word1 idiotic word2 word5"
    assert held.score(bad) >= 0.7 and held.score(bad + " muslims") >= 0.7


def test_names_of_no_sentence_are_inserted(spark):
    rows = [(k, f"some plain words about{k % 7} here" + (" idiots" if k % 2 else ""), k % 2) for k in range(40)]
    model = toxicity.fit(spark.createDataFrame([(i, t + " womenfolk" * y) for i, t, y in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    # "wome" begins a name and "women" (as a beginning) does not, so the penalty holds the first alone
    assert model.swapped > 0 and model.weights.get("pwome", 0) < 0.1 < model.weights["pwomen"]


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii_crf.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    bits = ["a", "@", ".", "1", "25", "+", "-", " ", "(", ")", "4111111111111111", "b.c", "é", "%", "300", "0004"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii_crf.base_spans(text) == brute(text), text
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 200_000, "@" * 200_000):
        pii_crf.base_spans(long)


def pii_docs(n=120):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        phone = f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((k, f"call {phone} or write u{k}@host{k % 9}.org about order {rng.randint(1, 99)} from 10.0.{k}.7 paid 4111 1111 1111 1111 in {rng.randint(1900, 2020)}"))
    return rows


def test_skip_edges_carry_labels(spark):
    field = pii_crf.fit(frame(spark, pii_docs()))
    base, spans = pii_crf.all_spans("call +1 (555) 123-4567 now, later (555) 123-4567 again; 12 apples in 1999", field)
    assert [k for *_, k in base] == ["phone"] and set(base) <= set(spans)
    assert (34, 48, "phone") in spans and all(hi <= 48 for _, hi, _ in spans)
    plain = "no data here, 12 apples and 3 pears"
    assert pii_crf.all_spans(plain, field) == ([], [])
    nodes = pii_crf.nodes_of("tel 5551234567 x 5551234567 y 5551234567")
    assert len(nodes.starts) == 3 and len(nodes.skip) == 2  # one to the last before, never all pairs
    many = pii_crf.nodes_of("4567 " * 5000)
    assert len(many.skip) < 5000 and np.isfinite(pii_crf.beliefs(many, field)).all()


def test_beliefs_are_exact_on_a_chain():
    rng = np.random.default_rng(5)
    labels, n = 5, 4
    field = pii_crf.Field(rng.normal(size=(pii_crf.N_FEATURES, labels)), rng.normal(size=(labels, labels)), np.zeros((labels, labels)))
    nodes = pii_crf.Nodes(np.arange(n), np.arange(n) + 1, rng.random((n, pii_crf.N_FEATURES)), np.array([[0, 1], [1, 2], [2, 3]]), np.zeros((0, 2), np.int64))
    unary = nodes.features @ field.unary
    total = np.zeros((n, labels))
    for k in range(labels**n):
        y = [k // labels**j % labels for j in range(n)]
        w = np.exp(sum(unary[j, y[j]] for j in range(n)) + sum(field.chain[y[a], y[b]] for a, b in nodes.chain))
        for j in range(n):
            total[j, y[j]] += w
    assert np.allclose(pii_crf.beliefs(nodes, field), total / total.sum(axis=1, keepdims=True), atol=1e-3)


def exact(nodes, field):
    labels, n = len(field.chain), len(nodes.starts)
    unary, total = nodes.features @ field.unary, np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n):
        w = np.exp(sum(unary[j, y[j]] for j in range(n)) + sum(field.chain[y[a], y[b]] for a, b in nodes.chain) + sum(field.skip[y[a], y[b]] for a, b in nodes.skip))
        for j in range(n):
            total[j, y[j]] += w
    return total / total.sum(axis=1, keepdims=True)


def test_evidence_at_one_end_of_two_hundred_repeats_reaches_the_other():
    n, labels = 200, 5
    field = pii_crf.Field(np.zeros((pii_crf.N_FEATURES, labels)), np.zeros((labels, labels)), 8.0 * np.eye(labels))
    field.unary[1, 4] = 6.0
    features = np.zeros((n, pii_crf.N_FEATURES))
    features[0, 1] = 1.0
    skip = np.array([[k, k + 1] for k in range(n - 1)])
    got = pii_crf.beliefs(pii_crf.Nodes(np.arange(n), np.arange(n) + 1, features, np.zeros((0, 2), np.int64), skip), field)
    # exact on a chain: the first belief carried on by the transition, as later nodes have no evidence of their own
    step = np.exp(field.skip) / np.exp(field.skip).sum(axis=1, keepdims=True)
    want = np.exp(features[0] @ field.unary)
    want /= want.sum()
    for k in range(n):
        assert np.allclose(got[k], want, atol=1e-3), k
        want = want @ step
    assert got[199, 4] > 0.7


@pytest.mark.parametrize("seed", range(6))
def test_beliefs_on_small_graphs_with_cycles_are_near_the_exact_ones(seed):
    rng = np.random.default_rng(seed)
    labels, n = 3, 7
    skip = rng.normal(size=(labels, labels)) * 0.5
    field = pii_crf.Field(rng.normal(size=(pii_crf.N_FEATURES, labels)), rng.normal(size=(labels, labels)) * 0.7, skip + skip.T)
    nodes = pii_crf.Nodes(np.arange(n), np.arange(n) + 1, rng.random((n, pii_crf.N_FEATURES)), np.array([[k, k + 1] for k in range(n - 1)]), np.array([[0, 3], [1, 5], [2, 6]]))
    assert np.abs(pii_crf.beliefs(nodes, field) - exact(nodes, field)).max() < 0.08


def test_messages_that_would_swing_for_ever_end():
    labels, n = 5, 12
    apart = 4.0 - 8.0 * np.eye(labels)
    field = pii_crf.Field(np.random.default_rng(1).normal(size=(pii_crf.N_FEATURES, labels)), apart, apart)
    every = np.array(list(itertools.combinations(range(n), 2)))
    p = pii_crf.beliefs(pii_crf.Nodes(np.arange(n), np.arange(n) + 1, np.random.default_rng(2).random((n, pii_crf.N_FEATURES)), np.zeros((0, 2), np.int64), every), field)
    assert np.isfinite(p).all() and np.allclose(p.sum(axis=1), 1)


def test_potentials_are_fitted_together():
    """Labels drawn from a known field: what decides is found in the edges, not in features that say nothing."""
    rng = np.random.default_rng(4)
    y = [0]
    for _ in range(4000):
        y.append(int(y[-1] if rng.random() < 0.95 else rng.integers(0, 3)))
    y, n = np.array(y), len(y)
    chain = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
    nodes = pii_crf.Nodes(np.arange(n), np.arange(n) + 1, np.ones((n, 1)), chain, np.zeros((0, 2), np.int64))
    field = pii_crf._fit_jointly(nodes.features, pii_crf._contexts(nodes, y, 3, np.ones(n, bool)).astype(float), y, np.ones(n), 3)
    agree = np.diag(field.chain).mean() - field.chain[~np.eye(3, dtype=bool)].mean()
    assert agree > 1.0 and np.allclose(field.skip, pii_crf.AGREEMENT * np.eye(3))


def test_personal_data_edges(spark):
    field = pii_crf.fit(frame(spark, pii_docs()))
    assert [(r.base, r.spans) for r in pii_crf.find_pii(frame(spark, EDGE), field).collect()] == [("", "")] * len(EDGE)
    assert pii_crf.find_pii(frame(spark, EDGE).limit(0), field).isEmpty()
    clean = pii_crf.redact(frame(spark, [(1, "mail a@b.org or 4111 1111 1111 1111."), (2, None), (3, "none")]), field)
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["mail [EMAIL] or [CARD].", None, "none"] and len(clean.columns) == 5
    nothing = pii_crf.fit(frame(spark, EDGE))
    assert pii_crf.all_spans("tel 5551234567", nothing) == ([], [])
