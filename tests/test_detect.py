import random
import re

import pytest
from pyspark.sql import functions as F

from sievemark.functions.regex_spans import regex_spans
from sievemark.functions.validate import luhn_valid, nanp_valid, ssn_valid
from sievemark.operators.detect import PLACEHOLDER_VALUE, RULES, cross_passage_traps, detect


def hits(spark, *texts):
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id", "char_start").collect()
    return [(r.id, r.element_type, r.value_raw, r.validation_status, r.trap_reason) for r in rows]


def test_shapes_and_verdicts(spark):
    got = hits(
        spark, "SSN 123-45-6789", "SSN 000-45-6789", "card 4111 1111 1111 1111", "card on file 4111111111111112", "call (212) 555-0147", "mail Ann.Lee@Example.org now",
        "passport number: 123456789", "SSN: 123456789", "account number 1234567890", "DL D1234567", "badge E12345 x", "SSN ending in 4321", None, "", "no digits here",
    )
    assert [(i, t, s) for i, t, _, s, _ in got] == [
        (0, "ssn", "valid"), (1, "ssn", "invalid_checksum"), (2, "credit_card", "valid"), (3, "credit_card", "invalid_checksum"), (4, "phone", "valid"), (5, "email", "valid"),
        (6, "passport", "format_only"), (7, "ssn", "valid"), (8, "financial_account", "format_only"), (9, "drivers_license", "format_only"), (10, "employee_id", "format_only"), (11, "ssn_last4", "format_only"),
    ]


@pytest.mark.parametrize("text, kind, reason", [
    ("Order # 123-45-6789", "ssn", "business_reference"), ("Claim 77 Member SSN | 123-45-6789", "ssn", None), ("enter it in the format 123-45-6789", "ssn", "placeholder"),
    ("TEST record 123-45-6789", "ssn", "test_record"), ("Best regards, Kim, (212) 555-0147", "phone", "signature_block"), ("Best regards, SSN 123-45-6789", "ssn", None),
])
def test_traps(spark, text, kind, reason):
    (_, got, _, status, trap), = hits(spark, text)
    assert (got, trap) == (kind, reason)
    assert (status == "format_only") == (reason is not None)


def test_earlier_rules_claim_spans(spark):
    got = hits(spark, "SSN 123-45-6789 4111-1111-1111-1111", "SSN and passport 123456789")
    assert [(t, v) for _, t, v, _, _ in got] == [("ssn", "123-45-6789"), ("credit_card", "4111-1111-1111-1111"), ("passport", "123456789")]


def test_spans_equal_python(spark):
    rng = random.Random(5)
    bits = ["SSN ", "123-45-6789", " 4111 1111 1111 1111", "é", "😀", "a@b.org", "(212) 555-0147", "passport ", "123456789", "\n", " ", "E12345", "account no. ", "D1234567", "DL "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    spans = df.select("id", *[regex_spans(F.col("text"), p).alias(f"r{k}") for k, (_, p, _) in enumerate(RULES)]).collect()
    for row in spans:
        for k, (_, pattern, _) in enumerate(RULES):
            want = [(m.start(1), m.end(1), m[1]) for m in re.finditer(pattern, texts[row.id])]
            # Spark counts characters by code point, as Python does
            assert [(s.start, s.end, s.value) for s in row[f"r{k}"]] == want, (texts[row.id], pattern)


def claimed_by_hand(text):
    """Rule by rule, each match held against all that is claimed."""
    kept = []
    for kind, pattern, _ in RULES:
        for m in re.finditer(pattern, text):
            a, b = m.span(1)
            if not any(a < y and b > x for x, y, _ in kept) and not re.search(PLACEHOLDER_VALUE, m[1]):
                kept.append((a, b, kind))
    return sorted(kept)


def test_claims_equal_the_definition(spark):
    rng = random.Random(15)
    bits = ["SSN ", "ssn: ", "123-45-6789", "123 45 6789", "4111 1111 1111 1111", "4111-111111-11111", "4111111111111111", "é", "😀", "a@b.org", "x.y@b.co.uk", "(212) 555-0147", "+1 212-555-0147", "212.555.0147",
            "passport ", "passport no. | ", "123456789", "1234567890", "\n", " ", "-", "E12345", "account no. ", "acct ", "D1234567", "DL ", "driver's license # ", "social security number ending in ", "last four ", "4321", "12", "(", ")", "+", "٣٤٥", "[SSN]", "XXX-XX-1234"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1_200)]
    got = {}
    for r in detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect():
        got.setdefault(r.id, []).append((r.char_start, r.char_end, r.element_type))
        text = texts[r.id]
        assert r.value_raw == text[r.char_start : r.char_end] and r.snippet == text[max(0, r.char_start - 40) : r.char_end + 40]
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, t in enumerate(texts) if (c := claimed_by_hand(t))}
    assert {kind for v in got.values() for _, _, kind in v} == {kind for kind, _, _ in RULES}


def test_a_text_of_a_hundred_thousand_hits(spark):
    text = "E12345 a@b.org 123-45-6789\n" * 35_000
    found = detect(spark.createDataFrame([(1, text), (2, "no hit")], "id int, text string"))
    assert {r.element_type: r["count"] for r in found.groupBy("element_type").count().collect()} == {"employee_id": 35_000, "email": 35_000, "ssn": 35_000}
    plan = detect(spark.createDataFrame([(1, text)], "id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_validators(spark):
    df = spark.createDataFrame([("79927398713",), ("4222222222222",), ("378282246310005",), ("79927398710",), ("4",), ("",), ("abc",)], "v string")
    assert [r[0] for r in df.select(luhn_valid(F.col("v"))).collect()] == [True, True, True, False, False, False, False]
    df = spark.createDataFrame([("001010001",), ("665010001",), ("667010001",), ("899010001",), ("000010001",), ("666010001",), ("900010001",), ("123000001",), ("123010000",), ("12345678",)], "v string")
    assert [r[0] for r in df.select(ssn_valid(F.col("v"))).collect()] == [True] * 4 + [False] * 6
    df = spark.createDataFrame([("2125550147",), ("12125550147",), ("1125550147",), ("2121550147",)], "v string")
    assert [r[0] for r in df.select(nanp_valid(F.col("v"))).collect()] == [True, True, False, False]


def test_traps_across_passages(spark):
    rows = [("d", 0, "email_part", "headers", "From: kim@x.org"), ("d", 1, "text_block", None, "TEST"), ("d", 2, "text_block", None, "SSN 123-45-6789"), ("e", 0, "text_block", None, "SSN 123-45-6789")]
    passages = spark.createDataFrame(rows, "doc_id string, seq int, kind string, part string, text string")
    out = cross_passage_traps(passages, detect(passages).drop("kind", "part", "text")).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.trap_reason, r.validation_status) for r in out] == [("d", 0, "staff_header", "format_only"), ("d", 2, "test_record", "format_only"), ("e", 0, None, "valid")]
