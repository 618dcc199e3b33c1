import hashlib
import random
import re

import duckdb
import pytest

from sievemark.llm.fill_in_middle import BLOCK, UNITS, Checkpoints, digest_examples, fill_in_middle, restored
from sievemark.llm.oracles import ORACLES

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def made(rng, n):
    return "".join(rng.choice(["a", "\n", "\n\n", "é", "\U0001f600", " ", "<", ">", "<P", "S>", "\r", "word"]) for _ in range(n))


def by_hand(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = LINES.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(lines)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:lo]), "".join(lines[lo:hi]), "".join(lines[hi:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit,pattern", [("line", LINES), ("char", re.compile(r"(?s).")), ("word", re.compile(r"(?s)^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"))])
def test_checkpoints_equal_a_full_scan(unit, pattern):
    rng = random.Random(2)
    texts = ["", "\n", "a", "\n\n", "a\n", made(rng, 60_000), "x" * (2 * BLOCK + 3), "\n" * (BLOCK + 1), "é" * BLOCK + "\n"] + [made(rng, rng.randint(0, 40)) for _ in range(150)]
    for text in texts:
        data, units = text.encode(), pattern.findall(text)
        for every in (1, 3, 64):
            index = Checkpoints(data, unit, every)
            assert (index.units, index.chars, len(index.unit_at)) == (len(units), len(text), -(-len(units) // every))
            for at in {0, len(units), *(rng.randint(0, len(units)) for _ in range(8))}:
                before = "".join(units[:at])
                assert index.offset(at) == (len(before.encode()), len(before)), (text[:50], unit, every, at)


def test_rows_by_hand(spark):
    rng = random.Random(4)
    texts = [(1, None), (2, ""), (3, "\n"), (4, "one\ntwo"), (4, "one\ntwo"), (None, "ünï\n\nz"), (5, "a<P>b"), (6, "<S>\n"), (7, "x" * 300_000), (8, "line\n" * 100_000), (-9, made(rng, 90_000))]
    texts += [(k, made(rng, rng.randint(0, 60))) for k in range(10, 400)]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in texts], "doc_id long, text string, n int, form string")
    for rate, spm in ((100, 50), (40, 30), (0, 0)):
        examples = fill_in_middle(docs, rate=rate, spm=spm, every=5)
        want = sorted(((i, *by_hand(i, t, rate, spm)) for i, t in texts), key=str)
        assert sorted(map(tuple, examples.collect()), key=str) == want
        back = examples.select("doc_id", restored(examples.output, examples.form).alias("t")).collect()
        assert sorted((str(r.doc_id), r.t) for r in back) == sorted((str(i), t or "") for i, t in texts)
    assert {r.form for r in fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert digest_examples(fill_in_middle(docs.limit(0))).isEmpty()


def test_other_units_and_marks(spark):
    rng = random.Random(6)
    marks = ("<PRE>", "<SUFFIX>", "<|m|>")
    texts = [(k, made(rng, rng.randint(0, 60))) for k in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for unit in UNITS:
        got = fill_in_middle(docs, unit=unit, marks=marks)
        rows = got.select("doc_id", "form", restored(got.output, got.form, marks).alias("t")).collect()
        assert {r.doc_id: r.t for r in rows} == dict(texts) and {r.form for r in rows} >= {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P<>", "<S>", "<M>"), ("<>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=bad)


def test_statement(spark, tmp_path):
    rng = random.Random(9)
    texts = [(k, made(rng, rng.randint(0, 60)) if k % 9 else None) for k in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    said = con.sql(ORACLES["op12_checkpoint_fim"])
    got = digest_examples(fill_in_middle(spark.read.parquet(str(tmp_path / "d")))).collect()
    assert sorted(map(tuple, got)) == sorted(said.project("doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256").fetchall())
