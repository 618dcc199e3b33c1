import pytest
from pyspark.sql import functions as F

from sievemark.operators import accuracy, exposure, extract, relational


@pytest.fixture
def costs(spark):
    docs = spark.createDataFrame([("a", "txt"), ("b", "txt"), ("c", "pdf_digital"), ("d", "pdf_digital")][:3], "document_id string, file_class string")
    rows = [("tier1", "m1", "a", 1000, 100, 200, 0.004), ("tier1", "m1", "b", 1000, 100, 600, 0.006), ("tier2_text", "m2", "c", 2000, 500, 1500, 0.03), ("agent_orchestrator", "m3", None, 4000, 800, 0, 0.05)]
    return docs, spark.createDataFrame(rows, "purpose string, model string, document_id string, input_tokens long, output_tokens long, cached_input_tokens long, cost_usd double")


def test_costs(costs):
    docs, events = costs
    total, = relational.cost_totals(events).collect()
    assert (round(total.cost_usd, 6), total.input_tokens, total.cached_input_tokens, total.cache_hit_rate, total.non_document_cost) == (0.09, 8000, 2300, 0.2875, 0.05)
    assert {(r.purpose, r.tier, r.calls) for r in relational.cost_summary(events).collect()} == {("tier1", "tier1", 2), ("tier2_text", "tier2", 1), ("agent_orchestrator", "agent", 1)}
    got, = relational.extrapolate_cost(relational.cost_by_class(docs, events), 1000).collect()
    assert got.dearest == "pdf_digital" and got.projected == pytest.approx(0.6667 * 5 + 0.3333 * 30, abs=1e-3)
    even = relational.cost_by_class(docs, events).withColumn("documents", F.lit(1)).withColumn("cost_usd", F.when(F.col("file_class") == "txt", 0.01).otherwise(0.03))
    got, = relational.extrapolate_cost(even, 1000).collect()
    assert (got.projected, got.sensitivity) == (20.0, 22.0)
    assert relational.extrapolate_cost(even.limit(0), 1000).isEmpty()


def test_budget_and_prices(spark):
    e = spark.createDataFrame([(1, k, 4.0) for k in range(5)], "run int, seq int, cost_usd double")
    assert [r.allowed for r in relational.within_budget(e, "run", ["seq"], 10.0).orderBy("seq").collect()] == [True, True, True, False, False]
    calls = spark.createDataFrame([("a", 1000, 10, 400), ("a", 100, 0, 500), ("?", 5, 5, 5)], "model string, input_tokens long, output_tokens long, cached_input_tokens long")
    prices = spark.createDataFrame([("a", 2.0, 0.5, 8.0)], "model string, input_price double, cached_price double, output_price double")
    assert sorted(r.cost_usd for r in relational.call_cost(calls, prices).collect()) == [0.0, 0.00005, 0.00148]


def test_stratified_sample_takes_turns(spark):
    f = spark.createDataFrame([("a", k) for k in range(6)] + [("b", 9)], "category string, id int")
    assert [(r.category, r.id) for r in relational.stratified_sample(f, ["category"], [F.asc("id")], 4).collect()] == [("a", 0), ("b", 9), ("a", 1), ("a", 2)]


def test_chunks(spark):
    rows = [("d", "text", k, "x" * n) for k, n in enumerate((40, 40, 400, 8, 0, 36))]
    p = spark.createDataFrame(rows, "doc_id string, family string, seq int, text string")
    assert [r.seqs for r in extract.pack_chunks(p, 20).orderBy("chunk").collect()] == [[0, 1], [2], [3, 4, 5]]


def test_located_values(spark):
    rows = [("p", "Ann met Ann. an", "Ann", 1), ("p", "Ann met Ann. an", "Ann", 2), ("p", "Ann met Ann. an", "Ann", 3), ("p", "a.b (x) $", "(x)", 1), ("p", "", "q", 1)]
    v = spark.createDataFrame(rows, "passage_id string, text string, value string, nth int")
    got = sorted((r.value, r.nth, r.char_start) for r in extract.locate_values(v).collect() if r.value != "q")
    assert got == [("(x)", 1, 4), ("Ann", 1, 0), ("Ann", 2, 8), ("Ann", 3, None)]


def test_confidence(spark):
    df = spark.createDataFrame([(0.9, 1.0, 1.0, 1.0, False), (None, None, 0.5, 1.0, False), (None, None, None, None, False), (1.0, 1.0, 1.0, 1.0, True)], "a double, b double, c double, d double, e boolean")
    got = [r[0] for r in df.select(extract.composite_confidence(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"))).collect()]
    assert got == [0.965, 0.6875, 0.0, 0.75]


def test_matching(spark):
    truth = spark.createDataFrame([("t1", "ssn", "1"), ("t1", "email", "e"), ("t2", "ssn", "2"), ("t3", "ssn", "3"), ("t4", "phone", "4")], "uid string, id_type string, value string")
    pred = spark.createDataFrame([("p1", "ssn", "1"), ("p1", "email", "e"), ("p2", "ssn", "2"), ("p2", "ssn", "3"), ("p3", "ssn", "9")], "person_id string, id_type string, value string")
    m = accuracy.match_by_identifier(truth, pred)
    assert {(r.uid, r.person_id, r.basis) for r in m.collect()} == {("t1", "p1", "ssn"), ("t2", "p2", "ssn"), ("t3", "p2", "ssn")}
    out = accuracy.outcomes(truth, pred, m)
    assert sorted((r.uid or "", r.person_id or "", r.outcome) for r in out.collect()) == [("", "p3", "hallucinated"), ("t1", "p1", "matched"), ("t2", "p2", "wrongly_merged"), ("t3", "p2", "wrongly_merged"), ("t4", "", "missed")]
    got, = accuracy.person_metrics(out, 4, 3).collect()
    assert (got.precision, got.recall) == (0.25, 0.3333)


def test_greedy_matching_equals_the_sequential_order(spark):
    rows = [("u1", "p1", 0.9), ("u1", "p2", 0.95), ("u2", "p2", 0.95), ("u2", "p1", 0.8), ("u3", "p2", 0.94), ("u3", "p3", 0.75)]
    taken, used = [], set()
    for s, p, u in sorted((-s, p, u) for u, p, s in rows):
        if p not in used and u not in used:
            taken.append((u, p))
            used |= {p, u}
    got = accuracy.greedy_match(spark.createDataFrame(rows, "uid string, person_id string, score double"))
    assert sorted((r.uid, r.person_id) for r in got.collect()) == sorted(taken)


def test_pair_confusion(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2), (None, 2)], "p string, t int")
    got, = accuracy.pair_confusion(a, "p", "t").collect()
    assert (got.tp, got.fp, got.fn) == (1, 2, 1)


def test_attach_or_park(spark):
    orphans = spark.createDataFrame([("e1", "q1"), ("e2", "q2"), ("e3", "q3")], "element_id string, passage_id string")
    keys = spark.createDataFrame([("q1", "k2"), ("q1", "k1"), ("q2", "k1"), ("q2", "k3")], "passage_id string, key string")
    owners = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "b")], "key string, person_id string")
    assert sorted((r.element_id, r.person_id, r.via_key) for r in exposure.attach_by_key(orphans, keys, owners).collect()) == [("e1", "a", "k1"), ("e2", None, None), ("e3", None, None)]
