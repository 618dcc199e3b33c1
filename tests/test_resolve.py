import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions.names import deletion_keys, iso_date, normal_name
from sievemark.functions.similarity import common_many, jaro_winkler, jaro_winkler_many, metaphone_one, token_sort, token_sort_many
from sievemark.operators import exposure, resolve
from sievemark.operators.components import connected_components
from similarity_by_hand import jaro_winkler_one, token_sort_one

MENTION = "mention_id string, doc_id string, name_raw string, dob string, elements map<string,array<string>>"
SSN_A, SSN_B, SSN_C, SSN_D = "123456789", "223456789", "323456789", "423456789"
GOLDEN = [
    ("m1", "d1", "Robert Fournier", "1987-03-14", {"ssn": [SSN_A], "credit_card": ["4111111111111111"], "employee_id": ["E12345"]}),
    ("m2", "d2", "Bob Fournier", None, {"ssn": [SSN_A]}), ("m5", "d3", "Robert Fournier", None, {"ssn": [SSN_A]}),
    ("m3", "d4", "Robert Fournier", None, {"ssn": [SSN_B]}), ("m4", "d5", "Rob Fournier", "1987-03-14", {}),
    ("e1", "d6", "Dana Ellison", None, {"ssn": [SSN_C], "email": ["dana@x.org"]}), ("e2", "d7", "Dana Ellison", None, {"email": ["dana@x.org"], "phone": ["2125550147"]}),
    ("e3", "d8", "Dana Ellison", None, {"phone": ["2125550147"], "ssn": [SSN_D]}),
]


def scored_of(spark, rows):
    m = resolve.mentions_of(spark.createDataFrame(rows, MENTION))
    return m, resolve.score_pairs(resolve.pair_features(resolve.candidate_pairs(resolve.block_keys(m)), m))


def test_golden_scenario(spark):
    m, scored = scored_of(spark, GOLDEN)
    clusters, banded = resolve.cluster(m, scored)
    of = {r.mention_id: r.cluster_id for r in clusters.collect()}
    bands = [r.band for r in banded.collect()]
    assert len(of) == 8 and len(set(of.values())) == 5
    assert of["m1"] == of["m2"] == of["m5"] and of["e1"] != of["e3"]
    assert bands.count("blocked_by_conflict") == 1 and bands.count("hard_conflict") == 4 and bands.count("gray") == 4
    people = {r.person_id: r for r in resolve.persons(m, clusters, banded).collect()}
    robert = people[of["m1"]]
    assert (robert.best_name, robert.dob, robert.mention_count, robert.document_count) == ("Robert Fournier", "1987-03-14", 3, 3)
    assert [(a.name, a.kind) for a in robert.aliases] == [("Bob Fournier", "nickname")]
    links = resolve.identity_links(clusters, banded)
    assert links.count() == 8 and links.groupBy("mention_id").count().where("count > 1").isEmpty()
    assert resolve.decisions(banded).count() == scored.count()


@pytest.mark.parametrize("a, b, check", [
    ({"ssn": [SSN_A], "email": ["x@y.z"]}, {"ssn": [SSN_B], "email": ["x@y.z"]}, lambda r: r.score == 0 and r.hard_reason == "hard_conflict"),
    ({"ssn": [SSN_A]}, {"ssn": [SSN_A]}, lambda r: r.score >= 0.85),
    ({}, {}, lambda r: r.hard_reason == "name_only_cap" and r.score <= 0.4),
])
def test_pair_scores(spark, a, b, check):
    _, scored = scored_of(spark, [("a", "1", "Robert Chen", None, a), ("b", "2", "Robert Chen", None, b)])
    row, = scored.collect()
    assert check(row)


def test_variants_and_dates(spark):
    rows = [("a", "1", "Robert Chen", None, {}), ("b", "2", "Bob Chen", None, {}), ("c", "3", "B. Lam", None, {}), ("d", "4", "Benjamin Lam", None, {}), ("e", "5", "Ann Ito", "1990-01-02", {}), ("f", "6", "Ann Ito", "1991-01-02", {})]
    got = {(r.left_id, r.right_id): r for r in scored_of(spark, rows)[1].collect()}
    assert got["a", "b"].hard_reason == "name_variant_cap" and 0.4 < got["a", "b"].score < 0.85
    assert got["c", "d"].hard_reason == "name_variant_cap" and got["c", "d"].score < 0.85
    assert got["e", "f"].score < 0.4


def test_oversized_name_blocks_are_left_out_but_not_strong_ones(spark):
    rows = [(f"m{k:03}", f"d{k}", "John Smith", None, {"ssn": [SSN_A]} if k < 2 else {}) for k in range(300)]
    m = resolve.mentions_of(spark.createDataFrame(rows, MENTION))
    pairs = resolve.candidate_pairs(resolve.block_keys(m)).collect()
    assert [(r.left_id, r.right_id) for r in pairs] == [("m000", "m001")]


def test_names(spark):
    df = spark.createDataFrame([("Lam, Benjamin",), ("  O'Neil-Smith  Jr ",), ("José Núñez",), ("B. Lam",), ("",), (None,), ("Cher",), ("Bob Ito",)], "r string")
    got = [r[0] for r in df.select(normal_name(F.col("r"))).collect()]
    assert (got[0].full, got[0].was_reordered) == ("benjamin lam", True)
    assert (got[1].full, got[2].full, got[3].given_is_initial) == ("oneil smith", "josé núñez", True)
    assert got[4] is None and got[5] is None and (got[6].given, got[6].surname) == ("cher", None)
    assert got[7].canonicals == ["bob", "robert"]
    df = spark.createDataFrame([("1987-3-4",), ("03/14/87",), ("3/14/2001",), ("March 4, 1990",), ("4 March 1990",), ("bad",), ("13/45/1990",)], "r string")
    assert [r[0] for r in df.select(iso_date(F.col("r"))).collect()] == ["1987-03-04", "1987-03-14", "2001-03-14", "1990-03-04", "1990-03-04", None, None]
    df = spark.createDataFrame([("lam",), ("li",)], "r string")
    assert [sorted(r[0]) for r in df.select(deletion_keys(F.col("r"))).collect()] == [["am", "la", "lam", "lm"], ["li"]]


def test_similarities():
    assert round(jaro_winkler_one("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler_one("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler_one("", "") == 1.0 and jaro_winkler_one("a", "") == 0.0 and jaro_winkler_one("abc", "xyz") == 0.0
    assert token_sort_one("lam benjamin", "benjamin lam") == 1.0 and token_sort_one("ab", "cd") == 0.0
    assert metaphone_one("Thompson") == metaphone_one("Thomson") or metaphone_one("Knight") == metaphone_one("Night")


def test_batches_equal_single_pairs(spark):
    rng = random.Random(21)
    word = lambda n, letters="abcde é\U0001f600": "".join(rng.choice(letters) for _ in range(n))
    a = ["", "", "a", "martha", "x" * 63, "x" * 64, "ab" * 100, " ", "é"] + [word(rng.randint(0, 24)) for _ in range(20_000)] + [word(rng.randint(50, 150), "ab ") for _ in range(60)]
    b = ["", "a", "", "marhta", "x" * 200, "x" * 65, "ba" * 100, "", "é"] + [word(rng.randint(0, 24)) if rng.random() < 0.5 else x[::-1] + "b" for x in a[9:20_009]] + [word(rng.randint(50, 150), "ab ") for _ in range(60)]
    assert jaro_winkler_many(a, b).tolist() == pytest.approx([jaro_winkler_one(x, y) for x, y in zip(a, b)], abs=1e-12)
    assert token_sort_many(a, b).tolist() == pytest.approx([token_sort_one(x, y) for x, y in zip(a, b)], abs=1e-12)
    assert len(common_many([], [])) == len(jaro_winkler_many([], [])) == 0
    rows = [("martha", "marhta"), (None, "a"), ("a", None), (None, None), ("", ""), ("martha", "marhta")]
    got = spark.createDataFrame(rows, "a string, b string").select(jaro_winkler("a", "b").alias("j"), token_sort("a", "b").alias("t")).collect()
    assert [r.j is None for r in got] == [False, True, True, True, False, False] and got[0] == got[5] and got[4].j == got[4].t == 1.0


def _brute(nodes, links, foes):
    root = {n: {n} for n in nodes}
    blocked = []
    for _, a, b in sorted((-s, a, b) for a, b, s in links):
        if root[a] is root[b]:
            continue
        if any((x, y) in foes or (y, x) in foes for x in root[a] for y in root[b]):
            blocked.append((a, b))
            continue
        both = root[a] | root[b]
        for x in both:
            root[x] = both
    return {n: min(root[n]) for n in nodes}, sorted(blocked)


def test_clusters_equal_the_global_greedy(spark):
    rng = random.Random(2)
    nodes = [f"n{k:02}" for k in range(24)]
    rows = []
    for a, b in itertools.combinations(nodes, 2):
        if rng.random() < 0.12:
            foe = rng.random() < 0.25
            rows.append((a, b, 0.0 if foe else rng.choice([0.5, 0.86, 0.9, 0.95]), "hard_conflict" if foe else None))
    mentions = spark.createDataFrame([(n,) for n in nodes], "mention_id string")
    clusters, banded = resolve.cluster(mentions, spark.createDataFrame(rows, "left_id string, right_id string, score double, hard_reason string"))
    want, blocked = _brute(nodes, [(a, b, s) for a, b, s, h in rows if s >= 0.85 and not h], {(a, b) for a, b, _, h in rows if h})
    assert {r.mention_id: r.cluster_id for r in clusters.collect()} == want
    assert sorted((r.left_id, r.right_id) for r in banded.where("band = 'blocked_by_conflict'").collect()) == blocked


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (3, 1)] + [(k, k + 1) for k in range(20, 60)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 20 for k in range(20, 61)}
    assert connected_components(edges.limit(0)).isEmpty()


def test_exposure_flags(spark):
    rows = [("p", "1", "ssn", "valid", None, "checksum", None), ("p", "1", "ssn", "valid", None, "checksum", None), ("p", "2", "ssn", "format_only", None, "regex", None), ("p", "3", "passport", "format_only", None, "regex", None), ("p", "4", "passport", "format_only", "placeholder", "regex", None), ("p", "5", "name", "format_only", None, "regex", None), ("p", "6", "email", "valid", None, "other", 0.7)]
    elements = spark.createDataFrame(rows, "person_id string, element_id string, element_type string, validation_status string, trap_reason string, detector string, confidence double")
    verdicts = spark.createDataFrame([("p", "email", False, "human_overridden"), ("p", "dob", True, "human_confirmed")], "person_id string, category string, exposed boolean, review_status string")
    flags, evidence = exposure.write_flags(elements, verdicts=verdicts)
    got = {r.category: (r.exposed, r.confidence, r.evidence_count, r.review_status) for r in flags.collect()}
    assert got == {"ssn": (True, 0.95, 1, "auto"), "passport": (True, 0.85, 1, "auto"), "email": (False, 0.7, 1, "human_overridden"), "dob": (True, None, 0, "human_confirmed")}
    assert exposure.without_evidence(exposure.write_flags(elements)[0], evidence).isEmpty()
