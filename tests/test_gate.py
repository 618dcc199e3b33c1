from sievemark.operators import casework, extract, gate, relational, resolve
from test_resolve import MENTION, SSN_A, SSN_B


def test_merges_pass_the_gate_by_evidence(spark):
    rows = [("a", "1", "Robert Chen", None, {"ssn": [SSN_A]}), ("b", "2", "Robert Chen", None, {"ssn": [SSN_A]}), ("c", "3", "Robert Chen", None, {"ssn": [SSN_B]}), ("d", "4", "Robert Chen", None, {}), ("e", "4", "Bob Chen", None, {})]
    m = resolve.mentions_of(spark.createDataFrame(rows, MENTION))
    links = spark.createDataFrame([("p", x, True) for x in ("a", "x1", "x2")] + [("q", "b", True), ("q", "y", False)], "person_id string, mention_id string, active boolean")
    asked = [(1, "a", "b", "merge"), (2, "b", "a", "merge"), (3, "a", "c", "merge"), (4, "a", "d", "merge"), (5, "d", "e", "merge"), (6, "a", "a", "merge"), (7, "a", "zz", "merge"), (8, "a", "c", "no_merge"), (9, None, "a", "escalate"), (10, "d", "c", "escalate")]
    table = spark.createDataFrame(asked, "proposal_id int, left_id string, right_id string, decision string")
    got = {r.proposal_id: (r.outcome, r.impact) for r in gate.judged_proposals(table, m, links, bound=3).collect()}
    assert got == {1: ("pending_approval", 4), 2: ("pending_approval", 4), 3: ("hard_conflict", 4), 4: ("name_only", 4), 5: ("merge", 2), 6: ("identical", 3), 7: ("unknown_mention", 4), 8: ("no_merge", 4), 9: ("unknown_mention", 4), 10: ("escalate", 2)}
    assert {r.proposal_id: r.outcome for r in gate.judged_proposals(table, m, links).collect()}[1] == "merge"
    assert gate.judged_proposals(table.limit(0), m, links).isEmpty()


def test_estimates_are_held_against_verdicts(spark):
    made = [(1, 3, 2, 1, 0.3), (2, 3, 2, 1, 0.3), (3, 3, 2, 2, 0.3), (4, 0, 0, 0, 0.0), (5, 3, 1, 1, 1.2), (6, 5, 1, 2, 0.5), (7, 2, 0, 0, 0.0)]
    seen = [(1, k, v) for k, v in enumerate(("verified", "verified", "contradicted"))] + [(2, 1, "verified")] + [(6, k, v) for k, v in enumerate(("verified", "verified", "contradicted"))]
    out = gate.checked_estimates(spark.createDataFrame(made, "audit_id int, sample_size int, verified int, contradicted int, estimated_error_rate double"), spark.createDataFrame(seen, "audit_id int, flag_id int, verdict string"))
    assert {r.audit_id: (r.verdicts_recorded, r.fault, r.warning) for r in out.collect()} == {
        1: (3, None, None), 2: (1, None, "verdicts"), 3: (0, "exceeds_sample", None), 4: (0, "sample_size", None), 5: (0, "range", None), 6: (3, None, "contradicted"), 7: (0, None, None)}


def test_accuracy_runs_tell_their_state(spark):
    rows = [(1, "{}", '{"person": {"precision": 0.5}}', 1, 2, 9), (2, None, '{"error": "x", "person": {"f1": 1}}', 1, 2, 8), (3, '{"config_profile": "B"}', None, 1, None, 7), (4, "{}", None, None, None, 6), (5, "{}", "not json", 1, 2, 5), (6, "{}", '{"error": null}', 1, 2, 4)]
    out = gate.accuracy_summaries(spark.createDataFrame(rows, "accuracy_run_id int, config_snapshot string, metrics string, started_at int, finished_at int, created_at int")).collect()
    assert [(r.accuracy_run_id, r.status, r.person_precision, r.person_f1) for r in out] == [(1, "finished", 0.5, None), (2, "failed", None, None), (3, "running", None, None), (4, "pending", None, None), (5, "running", None, None), (6, "failed", None, None)]
    assert out[2].config_profile == "B"


def test_flags_runs_and_answers(spark):
    flags = spark.createDataFrame([("b", "ssn"), ("a", "phone"), ("a", "dob"), ("c", "ssn")], "person_id string, category string")
    asked = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "person_id string")
    assert [tuple(r) for r in casework.flags_of_persons(flags, asked).collect()] == [("a", "dob"), ("a", "phone"), ("b", "ssn")]
    assert casework.flags_of_persons(flags, asked.limit(0)).isEmpty()
    runs = spark.createDataFrame([(1, 10), (2, 30), (3, 20), (4, 20)], "run_id int, created_at int")
    assert casework.latest_run_with_persons(runs, spark.createDataFrame([(3,), (4,), (1,)], "run_id int")).first().run_id == 4
    assert casework.latest_run_with_persons(runs, spark.createDataFrame([], "run_id int")).isEmpty()
    answer = '{"mentions":[],"elements":[{"element_type":"%s","value_raw":"1","mention_ref":null,"confidence":0.5}]}'
    rows = spark.createDataFrame([(1, answer % "name"), (2, answer % "iban"), (3, answer.replace('"%s"', "null"))], "id int, answer string")
    assert [r.fault for r in extract.contract_faults(rows).sort("id").collect()] == [None, "element_type", "element_type"]


def test_budget_of_one_large_run_and_of_none(spark):
    rows = [(None if k % 10 == 0 else 1, k // 2, k, None if k % 7 == 0 else float(k % 5)) for k in range(4_000)]
    e = spark.createDataFrame(rows, "run int, day int, seq int, cost_usd double")
    got = {r.seq: (r.spent_before, r.allowed) for r in relational.within_budget(e.repartition(7), "run", ["day", "seq"], 3_000.0).collect()}
    spent, want = {}, {}
    for run, _, seq, cost in rows:
        before = spent.get(run, 0.0)
        want[seq] = (before, before < 3_000.0)
        spent[run] = before + (cost or 0.0)
    assert got == want
    assert relational.within_budget(e.limit(0), "run", ["seq"], 1.0).isEmpty()
    assert relational.within_budget(e, "run", ["seq"], 1.0).columns == [*e.columns, "spent_before", "allowed"]
