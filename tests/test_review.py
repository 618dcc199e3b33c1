import pytest

from sievemark.operators import accuracy, extract, review

LINKS = "person_id string, mention_id string, method string, active boolean"


@pytest.fixture
def links(spark):
    return spark.createDataFrame([("a", "m1", "rule", True), ("b", "m2", "rule", True), ("b", "m3", "rule", True), ("c", "m4", "rule", True), ("z", "m4", "rule", False)], LINKS)


def test_merges_follow_chains(spark, links):
    merges = spark.createDataFrame([("b", "a"), ("c", "b"), ("q", "q")], "absorbed string, survivor string")
    out = review.merge_persons(links, merges)
    assert {(r.mention_id, r.person_id) for r in out.where("active").collect()} == {("m1", "a"), ("m2", "a"), ("m3", "a"), ("m4", "a")}
    assert out.count() == 8 and review.doubly_linked(out).isEmpty()
    assert review.needs_approval(links, merges, bound=2).count() == 2
    assert review.merge_persons(links, merges.limit(0)).exceptAll(links).isEmpty()


def test_splits(spark, links):
    out = review.split_mentions(links, spark.createDataFrame([("m3",), ("m3",)], "mention_id string"))
    assert {(r.person_id, r.mention_id) for r in out.where("active").collect()} == {("a", "m1"), ("b", "m2"), ("split-m3", "m3"), ("c", "m4")}
    counts = review.person_counters(out, spark.createDataFrame([(f"m{k}", "d") for k in range(1, 5)], "mention_id string, doc_id string"))
    assert {r.person_id: (r.mention_count, r.document_count) for r in counts.collect()} == {p: (1, 1) for p in ("a", "b", "c", "split-m3")}


def test_superseded_items_close(spark, links):
    items = spark.createDataFrame([(1, "m3", "m2", "open"), (2, "m1", "m2", "open"), (3, "m4", "m1", "open"), (4, "m1", "m9", "decided")], "id int, left_id string, right_id string, status string")
    scored = spark.createDataFrame([("m1", "m4", "hard_conflict"), ("m1", "m2", None)], "left_id string, right_id string, hard_reason string")
    assert {r.id: r.status for r in review.close_superseded(items, links, scored).collect()} == {1: "dismissed", 2: "open", 3: "dismissed", 4: "decided"}


def test_element_decisions_last_wins(spark):
    schema = "element_id int, value_normalized string, validation_status string, detector string, person_id string, trap_reason string"
    elements = spark.createDataFrame([(k, "v", "format_only", "regex", None, None) for k in range(4)], schema)
    log = spark.createDataFrame([(0, "dismiss", None, None, 1), (0, "correct", "w", None, 2), (1, "attach", None, "p", 1), (2, "dismiss", None, None, 1)], "element_id int, verb string, value string, person_id string, seq int")
    got = {r.element_id: tuple(r)[1:] for r in review.decide_elements(elements, log).collect()}
    assert got == {0: ("w", "valid", "reviewer", None, None), 1: ("v", "format_only", "regex", "p", None), 2: ("v", "format_only", "regex", None, "reviewer_dismissed"), 3: ("v", "format_only", "regex", None, None)}


def test_sheets(spark):
    text = "Name | SSN | Note\nAnn Lee | 123-45-6789 | x\n | 1 | y\nBo | | z"
    rows = extract.sheet_rows(spark.createDataFrame([("p", text, 2)], "passage_id string, text string, row_start int"))
    mentions, elements = extract.sheet_mentions(rows, ["name", "ssn", None])
    assert sorted((r.row_number, r.name_raw) for r in mentions.collect()) == [(2, "Ann Lee"), (4, "Bo")]
    got = sorted((r.row_number, r.element_type, r.value_raw, text[r.char_start : r.char_end]) for r in elements.collect())
    assert all(v == cut for _, _, v, cut in got) and ("ssn", "123-45-6789") in {(t, v) for _, t, v, _ in got}


def test_tier_outcomes(spark):
    rows = [(1, False, True, None), (2, True, True, True), (3, True, True, False), (4, True, False, None), (5, False, False, None)]
    df = spark.createDataFrame(rows, "id int, escalate boolean, tier1_valid boolean, tier2_valid boolean")
    assert {r.id: (r.outcome, r.review) for r in extract.tier_outcome(df).collect()} == {1: ("llm_tier1", False), 2: ("llm_tier2", False), 3: ("llm_tier1", True), 4: (None, True), 5: (None, True)}


def test_mention_truth_and_traps(spark):
    m = spark.createDataFrame([("m", "d", "ssn", "1"), ("m", "d", "name", "ann"), ("n", "d", "ssn", "9")], "mention_id string, doc string, id_type string, value string")
    p = spark.createDataFrame([("u2", "d", "ssn", "1", 0), ("u1", "d", "ssn", "1", 1), ("u1", "d", "name", "ann", 1)], "uid string, doc string, id_type string, value string, place int")
    assert {r.mention_id: r.uid for r in accuracy.mention_truth(m, p).collect()} == {"m": "u1", "n": None}
    e = spark.createDataFrame([("f1", "d", "1", "ssn"), ("f1", "d", "1", "ssn"), ("f2", "e", "1", "ssn")], "flag_id string, doc string, value string, category string")
    row, = accuracy.trap_scorecard(e, spark.createDataFrame([("d", "1"), ("d", "1")], "doc string, value string")).collect()
    assert (row.category, row.flags, row.rows) == ("ssn", 1, 2)


def test_quotes(spark):
    q = spark.createDataFrame([("f", "exact words"), ("g", "other")], "flag_id string, quote string")
    e = spark.createDataFrame([("f", "p"), ("g", "p")], "flag_id string, passage_id string")
    got = review.verified_quotes(q, e, spark.createDataFrame([("p", "the exact words here")], "passage_id string, text string"))
    assert {r.flag_id: r.verified for r in got.collect()} == {"f": True, "g": False}


def test_circles_chains_and_double_merges(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "d"), ("p", "q"), ("p", "r"), ("s", "r"), ("q", "q"), (None, "a"), ("x", "y"), ("x", "y")]
    merges = spark.createDataFrame(rows, "absorbed string, survivor string")
    got = {r.absorbed: r.survivor for r in review.survivors(merges).collect()}
    assert got == {"b": "a", "c": "a", "e": "d", "f": "d", "g": "d", "h": "d", "p": "q", "r": "q", "s": "q", "x": "y"}
    assert [(r.absorbed, r.into) for r in review.doubly_absorbed(merges).collect()] == [("p", ["q", "r"])]
    long = spark.createDataFrame([(k, k + 1) for k in range(100)], "absorbed long, survivor long")
    assert {(r.absorbed, r.survivor) for r in review.survivors(long).collect()} == {(k, 100) for k in range(100)}
