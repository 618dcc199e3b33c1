"""Inputs on which work that grows with a square would not end in time."""

import itertools
import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from sievemark.functions.redact import redact_json
from sievemark.operators import accuracy, chunks, exposure, extract, resolve
from sievemark.operators.components import connected_components, spanning_edges
from sievemark.operators.constrained import constrained_components


@contextmanager
def within(seconds):
    began = time.monotonic()
    yield
    assert time.monotonic() - began < seconds


def test_record_with_many_nested_values(spark):
    n = 6_000
    record = "[" + ",".join('{"password": {"a": [1, "]}"]}, "b": 1}' for _ in range(n)) + "]"
    with within(30):
        got = spark.createDataFrame([(record,)], "r string").select(redact_json(F.col("r"))).first()[0]
    assert got == "[" + ",".join('{"password": "[REDACTED]", "b": 1}' for _ in range(n)) + "]"


def test_repeated_mentions_and_plantings_meet_once(spark):
    rows = spark.range(100_000)
    m = rows.select(F.lit("m").alias("mention_id"), F.lit("d").alias("doc"), F.lit("ssn").alias("id_type"), F.lit("1").alias("value"))
    p = rows.select((F.col("id") % 2).alias("uid"), F.lit("d").alias("doc"), F.lit("ssn").alias("id_type"), F.lit("1").alias("value"), (100_000 - F.col("id")).alias("place"))
    with within(60):
        assert [tuple(r) for r in accuracy.mention_truth(m, p).collect()] == [("m", 1)]


def test_sheet_of_many_rows(spark):
    n = 60_000
    text = "name | nation\n" + "\n".join(f"é{k} | {k}" for k in range(n))
    rows = extract.sheet_rows(spark.createDataFrame([("p", text, 2), (None, None, 2)], "passage_id string, text string, row_start int"))
    with within(60):
        got = rows.select("row_number", "line", "line_start").orderBy("row_number").collect()
    assert len(got) == n and all(text[r.line_start : r.line_start + len(r.line)] == r.line == f"é{r.row_number - 2} | {r.row_number - 2}" for r in got)


def _mentions(spark, n=60):
    """Telephones, some null, names of several spellings, addresses and dates that meet, conflict and stay open."""
    rows = []
    for k in range(n):
        phones = [f"212555000{k % 3}"] + ([None] if k % 10 == 0 else []) if k % 4 else None
        held = {"phone": phones, "ssn": [f"12345{k % 5}789"] if k % 6 == 0 else [], "ssn_last4": ["0789"] if k % 7 == 0 else None, "address": ["1 Main St", None] if k % 5 == 0 else ["1 Main Road"]}
        rows.append((f"m{k:02}", f"d{k % 4}", (None, "Bob Chen", "Chen, Robert", "R. Chen", "Ann Cheng")[k % 5], "1990-01-02" if k % 8 == 0 else None, {t: v for t, v in held.items() if v is not None}))
    return resolve.mentions_of(spark.createDataFrame(rows, "mention_id string, doc_id string, name_raw string, dob string, elements map<string,array<string>>"))


def _above_join(df):
    """The plan's operators above its first join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Join")]


def test_pairs_are_not_shuffled(spark):
    m = _mentions(spark)
    keys = resolve.block_keys(m)
    pairs = resolve.candidate_pairs(keys, tile=7)
    assert "Exchange" not in _above_join(pairs)
    held = {}
    for r in keys.where("key is not null").collect():
        held.setdefault(r.key, set()).add(r.mention_id)
    want = {}
    for key, ids in held.items():
        for a, b in itertools.combinations(sorted(ids), 2):
            want.setdefault((a, b), set()).add(key)
    got = pairs.collect()
    assert len(got) == len(want) and {(r.left_id, r.right_id): list(r.blocks) for r in got} == {p: sorted(k) for p, k in want.items()}


def test_features_in_tiles_equal_those_of_pairs(spark):
    m = _mentions(spark)
    keys = resolve.block_keys(m)
    tiled = resolve.candidate_features(keys, m, tile=7)
    assert "Exchange" not in _above_join(tiled)
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    assert text(tiled) == text(resolve.pair_features(resolve.candidate_pairs(keys), m))


def test_a_dense_graph_is_thinned_before_it_is_shuffled(spark):
    edges = spark.range(200).select(F.col("id").alias("u")).crossJoin(spark.range(200).select(F.col("id").alias("v"))).where("u > v and u % 2 = v % 2").coalesce(1)
    thin = spanning_edges(edges)
    assert thin.count() == 198
    assert {r.node: r.component for r in connected_components(thin, "u", "v").collect()} == {k: k % 2 for k in range(200)}


def test_torn_components_within_the_bound_go_to_their_tasks(spark):
    links = [(10 * g + a, 10 * g + b, 0.9) for g in range(40) for a, b in itertools.combinations(range(6), 2)]
    foes = [(10 * g, 10 * g + 1) for g in range(0, 40, 2)] + [(0, 10)]
    got = constrained_components(spark.createDataFrame(links, "left_id long, right_id long, score double"), spark.createDataFrame(foes, "left_id long, right_id long"), held=20)
    # the first end takes all but its foe, which is then refused by all
    assert {r.node: r.component for r in got.collect()} == {10 * g + k: 10 * g + (k == 1 and g % 2 == 0) for g in range(40) for k in range(6)}


def test_chunk_of_many_passages(spark):
    n = 6_000
    passages = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("seq"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    spans = chunks.chunk_spans(passages, passages.groupBy("doc").agg(F.sort_array(F.collect_list("seq")).alias("seqs")).withColumn("chunk", F.lit(0)), ["doc"])
    reports = passages.select("doc", F.lit(0).alias("chunk"), F.col("text").alias("value"), F.col("seq").alias("nth"))
    with within(40):
        found = chunks.locate_in_chunks(spans, reports, ["doc"]).collect()
    assert len(found) == n and all((r.seq, r.char_start, r.char_end) == (r.nth, 0, 6) for r in found)


def test_persons_of_a_hot_key_are_counted_out_before_elements_meet_them(spark):
    n = 40_000
    orphans = spark.range(n).select(F.col("id").alias("element_id"), F.col("id").alias("passage_id"))
    keys = orphans.select("passage_id", F.when(F.col("passage_id") == 7, "one").otherwise("hot").alias("key"))
    persons = spark.range(n).select(F.col("id").alias("person_id"), F.lit("hot").alias("key")).union(spark.createDataFrame([(5, "one")], "person_id long, key string"))
    with within(40):
        got = exposure.attach_by_key(orphans, keys, persons).where("person_id is not null").collect()
    assert [tuple(r) for r in got] == [(7, 5, "one")]
