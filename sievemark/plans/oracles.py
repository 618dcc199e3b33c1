"""DuckDB statements for the queries of ``plans.queries``."""

from __future__ import annotations

from sievemark.operators import detect
from sievemark.plans import star
from sievemark.sources.parsers import HEADERS

_GIVEN = "[" + ", ".join(f"'{g}'" for g in star.GIVEN) + "]"
_SURNAMES = "[" + ", ".join(f"'{g}'" for g in star.SURNAMES) + "]"
_MENTIONS = f"""
mentions AS (
  SELECT c_custkey AS mention_id, c_custkey % 200 AS doc_id,
    {_GIVEN}[c_custkey % {len(star.GIVEN)} + 1] AS g, {_SURNAMES}[c_custkey % {len(star.SURNAMES)} + 1] AS sn, c_custkey % 7 = 0 AS was_reordered,
    CASE WHEN c_custkey % 3 = 0 THEN '19' || lpad(CAST(c_custkey % 60 + 40 AS VARCHAR), 2, '0') || '-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') END AS dob,
    '212555' || lpad(CAST(c_custkey % 997 AS VARCHAR), 4, '0') AS phone,
    CASE WHEN c_custkey % 11 = 0 THEN 'user' || CAST(c_custkey % 130 AS VARCHAR) || '@example.org' END AS email
  FROM customer
)"""
_CANON = """CASE g WHEN 'bob' THEN 'bob,robert' WHEN 'liz' THEN 'elizabeth,liz' WHEN 'jim' THEN 'james,jim' WHEN 'mike' THEN 'michael,mike' ELSE g END"""
_FLAGS = """
flags AS (
  SELECT o_custkey AS person_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'ssn' WHEN '2' THEN 'dob' WHEN '3' THEN 'credit_card' WHEN '4' THEN 'phone' WHEN '5' THEN 'email' ELSE 'address' END AS category,
    true AS exposed, round(least(max(o_totalprice) / 500000, 1.0), 4) AS confidence, count(*) AS evidence_count
  FROM orders GROUP BY ALL
)"""
_PERSONS = """
persons AS (
  SELECT c_custkey AS person_id, c_name AS best_name, c_mktsegment AS alias, CASE WHEN c_acctbal < 0 THEN 'needs_review' ELSE 'auto' END AS review_status, c_custkey % 4 AS mention_count FROM customer
)"""
_COSTS = """
costs AS (
  SELECT l_orderkey % 10 AS run_id, CASE l_returnflag WHEN 'A' THEN 'tier1' WHEN 'N' THEN 'tier2_text' ELSE 'agent_auditor' END AS purpose, l_linestatus AS model,
    CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS document_id, l_linenumber AS seq, l_orderkey AS ord,
    CAST(trunc(l_quantity) AS BIGINT) AS input_tokens, CAST(trunc(l_quantity / 2) AS BIGINT) AS output_tokens, CAST(trunc(l_quantity / 4) AS BIGINT) AS cached_input_tokens, CAST(floor(l_extendedprice) AS DOUBLE) AS cost_usd
  FROM lineitem
)"""
_DOCUMENTS = """
docs AS (
  SELECT o_orderkey AS document_id, o_orderkey % 10 AS run_id, o_orderpriority AS file_class, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'quarantined' ELSE 'failed' END AS status, o_orderdate AS created_at FROM orders
)"""
_BY_CLASS = """
spent AS (SELECT file_class, count(DISTINCT document_id) AS costed, sum(cost_usd) AS cost_usd FROM costs JOIN docs USING (document_id) GROUP BY file_class),
by_class AS (SELECT file_class, documents, coalesce(costed, 0) AS costed, coalesce(cost_usd, 0) AS cost_usd FROM (SELECT file_class, count(*) AS documents FROM docs GROUP BY file_class) LEFT JOIN spent USING (file_class))"""
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(card[i] AS INT) WHEN CAST(card[i] AS INT) < 5 THEN 2 * CAST(card[i] AS INT) ELSE 2 * CAST(card[i] AS INT) - 9 END)) % 10 = 0"
_BAND = "CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'mid' ELSE 'high' END"
_LINES = r"string_split(CASE WHEN right(t, 1) = chr(10) THEN left(t, length(t) - 1) ELSE t END, chr(10))"


def _header_case() -> str:
    return "CASE trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HEADERS.items()) + " END"


_FOUND = r"""
padded AS (SELECT doc_id, regexp_replace(' ' || text || ' ', '([^0-9A-Za-z@._%+-])', '\1\1', 'g') AS t, regexp_replace(' ' || text || ' ', '([^0-9-])', '\1\1', 'g') AS u, text FROM documents),
found AS (
  SELECT doc_id, 'email' AS element_type, unnest(regexp_extract_all(t, '[^A-Za-z0-9._%+@-]([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', 1)) AS value_raw FROM padded
  UNION ALL SELECT doc_id, 'credit_card', unnest(regexp_extract_all(u, '[^0-9-]([0-9]{13,19})[^0-9-]', 1)) FROM padded
  UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '(\([2-9][0-9]{2}\)\s?[2-9][0-9]{2}-[0-9]{4})', 1)) FROM padded
)"""
_REFERENCE, _AFFIRMING, _PLACEHOLDER, _SIGNATURE = (p.removeprefix("(?i)") for p in (detect.BUSINESS_REFERENCE[1], detect.AFFIRMING, detect.PLACEHOLDER[1], detect.SIGNATURE[1]))
_TEST = detect.TEST_RECORD[1]
_CARD_SUM = "list_sum(list_transform(range(0, length(value_raw)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(value_raw)[i + 1] AS INT) WHEN CAST(reverse(value_raw)[i + 1] AS INT) < 5 THEN 2 * CAST(reverse(value_raw)[i + 1] AS INT) ELSE 2 * CAST(reverse(value_raw)[i + 1] AS INT) - 9 END))"

ORACLES: dict[str, str] = {
    "exposure_by_document": f"""
WITH {_FOUND},
cut AS (SELECT DISTINCT doc_id, element_type, value_raw, string_split(text, value_raw) AS parts, text FROM found JOIN documents USING (doc_id)),
placed AS (SELECT doc_id, element_type, value_raw, text, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(value_raw) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM cut)),
near AS (SELECT *, text[greatest(start - 63, 1):start] AS n64, text[greatest(start - 79, 1):start] AS n80, text[greatest(start - 159, 1):start] AS n160, text[greatest(start - 239, 1):start] AS n240 FROM placed),
judged AS (SELECT *, regexp_extract(n64, '(?is).*(?:{_REFERENCE})(.*)$', 1) AS after_ref, regexp_matches(n64, '(?i){_REFERENCE}') AS has_ref, regexp_extract(n64, '(?is).*(?:{_AFFIRMING})(.*)$', 1) AS after_aff, regexp_matches(n64, '(?i){_AFFIRMING}') AS has_aff FROM near),
kept AS (SELECT * FROM judged WHERE NOT (element_type = 'credit_card' AND has_ref AND (NOT has_aff OR length(after_ref) < length(after_aff)))
  AND NOT regexp_matches(n80, '(?i){_PLACEHOLDER}') AND NOT regexp_matches(n240, '{_TEST}') AND NOT (element_type IN ('email', 'phone') AND regexp_matches(n160, '(?i){_SIGNATURE}'))
  AND (element_type <> 'credit_card' OR {_CARD_SUM} % 10 = 0))
SELECT doc_id, element_type AS category, count(*) AS evidence, count(DISTINCT lower(value_raw)) AS distinct_values, CAST(max(CASE WHEN element_type = 'email' THEN 0.85 ELSE 0.95 END) AS DOUBLE) AS confidence, CAST(min(start) AS INTEGER) AS first_at FROM kept GROUP BY doc_id, element_type
""",
    "detect_values": f"""
WITH {_FOUND}
SELECT doc_id, element_type, value_raw, CASE element_type WHEN 'email' THEN lower(value_raw) ELSE regexp_replace(value_raw, '[^0-9]', '', 'g') END AS value_normalized, count(*) AS n FROM found GROUP BY ALL
""",
    "checksum_verdicts": f"""
WITH k AS (SELECT l_linenumber, l_orderkey * 7919 + l_partkey AS k FROM lineitem),
v AS (SELECT l_linenumber, '4' || lpad(CAST(k AS VARCHAR), 15, '0') AS card, lpad(CAST(k % 1000000000 AS VARCHAR), 9, '0') AS ssn, lpad(CAST(k * 31 % 10000000000 AS VARCHAR), 10, '2') AS phone FROM k)
SELECT l_linenumber, count(*) FILTER (WHERE {_LUHN}) AS luhn_valid,
  count(*) FILTER (WHERE ssn[1:3] NOT IN ('000', '666') AND ssn[1] <> '9' AND ssn[4:5] <> '00' AND ssn[6:9] <> '0000') AS ssn_valid,
  count(*) FILTER (WHERE regexp_matches(phone, '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')) AS phone_valid
FROM v GROUP BY l_linenumber
""",
    "text_line_passages": f"""
WITH l AS (SELECT doc_id, {_LINES} AS lines FROM (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0)),
b AS (SELECT doc_id, lines, unnest(range(0, CAST(ceil(len(lines) / 5.0) AS BIGINT))) AS seq FROM l)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, seq * 5 + 1 AS line_start, least((seq + 1) * 5, len(lines)) AS line_end, length(array_to_string(lines[seq * 5 + 1 : seq * 5 + 5], chr(10))) AS n_chars FROM b
""",
    "garbage_ratios": r"""
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[A-Za-z0-9 \t\n\r.,;:!?''"()\[\]{}<>\-_/@#$%&*+=|~^`]', '', 'g')) / CAST(length(text) AS DOUBLE) ELSE 0 END, 6) AS ratio FROM documents
""",
    "header_types": f"""
SELECT header, {_header_case()} AS element_type, count(*) AS n FROM (SELECT ['SSN', ' Social_Security-Number ', 'E-mail', 'Phone #', 'DOB', 'Card Number', 'Notes', 'Home  Address'][p_partkey % 8 + 1] AS header FROM part) GROUP BY header
""",
    "content_dedup": """
SELECT doc_id, source AS run_id, sha256(text) AS sha256, count(*) OVER w - 1 AS copies FROM documents
QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1
""".replace("OVER w", "OVER (PARTITION BY source, sha256(text))"),
    "routing_reconciliation": "SELECT CASE WHEN length(text) < 50 THEN 'too_short' WHEN lang IS NULL THEN 'no_language' ELSE 'routed' END AS outcome, count(*) AS n, CAST((SELECT count(*) FROM documents) AS BIGINT) AS documents FROM documents GROUP BY 1",
    "conversation_prefixes": "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM conversations",
    "document_list": f"WITH {_DOCUMENTS} SELECT document_id, file_class, status FROM docs WHERE status = 'done' ORDER BY created_at DESC, document_id LIMIT 50 OFFSET 100",
    "latest_run": f"WITH {_DOCUMENTS} SELECT run_id FROM docs GROUP BY run_id ORDER BY max(created_at) DESC, run_id DESC LIMIT 1",
    "exposure_page": f"""WITH {_PERSONS}, {_FLAGS}
SELECT person_id, best_name, review_status FROM persons WHERE mention_count > 0 AND (best_name ILIKE '%build%' OR alias ILIKE '%build%')
AND EXISTS (SELECT 1 FROM flags f WHERE f.person_id = persons.person_id AND exposed AND category = 'ssn' AND confidence >= 0.3) ORDER BY best_name, person_id LIMIT 40 OFFSET 10""",
    "exposure_total": f"""WITH {_PERSONS}, {_FLAGS} SELECT count(*) AS total FROM persons WHERE mention_count > 0 AND review_status = 'needs_review'
AND EXISTS (SELECT 1 FROM flags f WHERE f.person_id = persons.person_id AND exposed AND confidence >= 0.5)""",
    "evidence_per_person": "SELECT o_custkey AS person_id, count(*) AS evidence FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey",
    "flags_without_evidence": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
    "person_detail": "SELECT o_custkey, o_orderpriority, count(*) AS evidence, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "cost_summary": f"""WITH {_COSTS} SELECT purpose, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, sum(cost_usd) AS cost_usd,
CASE WHEN purpose LIKE 'tier%' THEN split_part(purpose, '_', 1) WHEN purpose LIKE 'agent_%' THEN 'agent' ELSE purpose END AS tier FROM costs GROUP BY purpose, model""",
    "cost_totals": f"""WITH {_COSTS} SELECT count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_input_tokens) AS BIGINT) AS cached_input_tokens, sum(cost_usd) AS cost_usd,
sum(cost_usd) FILTER (WHERE document_id IS NULL) AS non_document_cost, round(sum(cached_input_tokens) / CAST(sum(input_tokens) AS DOUBLE), 4) AS cache_hit_rate FROM costs""",
    "cost_by_class": f"WITH {_COSTS}, {_DOCUMENTS}, {_BY_CLASS} SELECT * FROM by_class",
    "cost_extrapolation": f"""WITH {_COSTS}, {_DOCUMENTS}, {_BY_CLASS},
r AS (SELECT file_class, round(documents / CAST(sum(documents) OVER () AS DOUBLE), 4) AS share, cost_usd / documents AS mean FROM by_class),
top AS (SELECT arg_max(file_class, (mean, file_class)) AS dearest, arg_max(share, (mean, file_class)) AS top_share FROM r)
SELECT round(sum(share * mean) * 1000, 4) AS projected, round(sum(CASE WHEN file_class = dearest THEN share + least(0.1, 1 - top_share) ELSE share * (1 - least(0.1, 1 - top_share) / (1 - top_share)) END * mean) * 1000, 4) AS sensitivity, any_value(dearest) AS dearest FROM r, top""",
    "call_costs": f"""WITH {_COSTS}, p AS (SELECT * FROM (VALUES ('O', 2.0::DOUBLE, 1.0::DOUBLE, 8.0::DOUBLE), ('F', 5.0, 1.0, 20.0)) t(model, a, b, c))
SELECT model, count(*) AS calls, round(sum(round(((input_tokens - cached_input_tokens) * a + cached_input_tokens * b + output_tokens * c) / 1e6, 6)), 4) AS cost_usd FROM costs JOIN p USING (model) GROUP BY model""",
    "budget_cut": f"""WITH {_COSTS}, s AS (SELECT run_id, coalesce(sum(cost_usd) OVER (PARTITION BY run_id ORDER BY ord, seq, cost_usd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM costs)
SELECT run_id, count(*) FILTER (WHERE spent < 5000000) AS allowed, count(*) AS calls FROM s GROUP BY run_id""",
    "run_status_counts": f"WITH {_DOCUMENTS} SELECT run_id, status, count(*) AS n FROM docs GROUP BY ALL",
    "class_failure_rates": f"""WITH {_DOCUMENTS}, g AS (SELECT file_class, count(*) AS total, count(*) FILTER (WHERE status = 'quarantined') AS quarantined, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'done') AS done FROM docs GROUP BY file_class)
SELECT *, round((quarantined + failed) / CAST(total AS DOUBLE), 4) AS failure_rate FROM g""",
    "review_queue": "SELECT o_orderkey, CAST(round(o_totalprice / 5000) AS INTEGER) AS priority FROM orders WHERE o_orderkey % 10 = 3 ORDER BY priority DESC, o_orderdate, o_orderkey LIMIT 60",
    "confidence_bands": f"WITH {_FLAGS} SELECT category, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, {_BAND} AS audit_band, count(*) AS n FROM flags GROUP BY ALL",
    "stratified_audit_sample": f"""WITH {_FLAGS}, b AS (SELECT person_id, category, {_BAND} AS band FROM flags), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category, band ORDER BY person_id) AS INTEGER) AS turn FROM b)
SELECT person_id, category, band, turn FROM r ORDER BY turn, category, band LIMIT 50""",
    "last_directives": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "logprob_confidence": """
WITH e AS (SELECT event_id, CASE WHEN value > 20 THEN least(exp(-value / 1000), 1.0) END AS lp, CAST(event_id % 2 AS DOUBLE) AS ag, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 END AS va, event_id % 5 = 0 AS repaired FROM events),
c AS (SELECT event_id, repaired, (coalesce(0.35 * lp, 0) + 0.25 * ag + coalesce(0.25 * va, 0) + 0.15) / (CASE WHEN lp IS NOT NULL THEN 0.35 ELSE 0 END + 0.25 + CASE WHEN va IS NOT NULL THEN 0.25 ELSE 0 END + 0.15) AS s FROM e)
SELECT event_id, round(CASE WHEN repaired THEN least(s, 0.75) ELSE s END, 4) AS confidence FROM c
""",
    "column_votes": """
WITH v AS (SELECT user_id, event_type, count(*) AS votes, 20 AS n_rows FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS k FROM v)
SELECT user_id, event_type, votes, n_rows FROM r WHERE k = 1 AND votes >= 10
""",
    "nearest_mentions": """
WITH h AS (SELECT event_id AS hit_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS here FROM events WHERE event_type = 'purchase'), m AS (SELECT event_id AS mention_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS off FROM events WHERE event_type <> 'purchase')
SELECT hit_id, mention_id FROM h JOIN m USING (user_id) QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY abs(off - here), mention_id) = 1
""",
    "sheet_cells": r"""
WITH r AS (SELECT s_suppkey % 7 AS passage_id, s_suppkey, s_name || ' | ' || CAST(s_nationkey AS VARCHAR) AS line, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY s_suppkey) AS k, coalesce(sum(length(line) + 1) OVER (PARTITION BY passage_id ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT passage_id, CAST(k + 1 AS INTEGER) AS row_number, nation, CAST(14 + before + length(line) - length(nation) AS INTEGER) AS start, nation AS slice FROM n
""",
    "normal_names": f"WITH {_MENTIONS} SELECT mention_id, lower(g || ' ' || sn) AS \"full\", lower(g) AS given, lower(sn) AS surname, was_reordered, (SELECT {_CANON} FROM (SELECT lower(m.g) AS g)) AS canonicals FROM mentions m",
    "normal_values": """
SELECT c_custkey, ['ssn', 'phone', 'email', 'passport', 'address', 'credential'][c_custkey % 6 + 1] AS kind,
  CASE c_custkey % 6 WHEN 0 THEN (CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN left(CAST(c_custkey AS VARCHAR), 3) ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '1') END) || '223333'
    WHEN 1 THEN '212555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN lower(c_name) || '@example.org' WHEN 3 THEN 'X' || CAST(c_custkey AS VARCHAR)
    WHEN 4 THEN '12 main st ' || CAST(c_custkey AS VARCHAR) ELSE 'Pass' || CAST(c_custkey AS VARCHAR) END AS value FROM customer
""",
    "iso_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 8 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS dob FROM orders",
    "surname_deletions": f"""WITH {_MENTIONS}, k AS (SELECT mention_id, unnest(list_distinct(list_concat([lower(sn)], list_transform(range(1, length(sn) + 1), lambda i: left(lower(sn), i - 1) || substr(lower(sn), i + 1))))) AS key FROM mentions)
SELECT key, count(*) AS n FROM k GROUP BY key""",
    "candidate_pairs": f"""WITH {_MENTIONS},
canon AS (SELECT mention_id, sn, unnest(string_split({_CANON.replace(' g ', ' lower(g) ').replace('ELSE g', 'ELSE lower(g)')}, ',')) AS c FROM mentions),
keys AS (
  SELECT mention_id, 'strong:phone:' || phone AS key, true AS strong FROM mentions UNION SELECT mention_id, 'strong:email:' || email, true FROM mentions WHERE email IS NOT NULL
  UNION SELECT mention_id, 'dob:' || dob, false FROM mentions WHERE dob IS NOT NULL
  UNION SELECT mention_id, 'typo:' || unnest(list_concat([lower(sn)], list_transform(range(1, length(sn) + 1), lambda i: left(lower(sn), i - 1) || substr(lower(sn), i + 1)))) || ':' || left(c, 1), false FROM canon
), ok AS (SELECT key FROM keys GROUP BY key HAVING count(*) >= 2 AND (bool_or(strong) OR count(*) <= 200))
SELECT l.mention_id AS left_id, r.mention_id AS right_id, string_agg(l.key, ';' ORDER BY l.key) AS blocks FROM keys l JOIN ok USING (key) JOIN keys r ON l.key = r.key AND l.mention_id < r.mention_id GROUP BY ALL""",
    "surname_similarity": "SELECT a.n_name, b.n_name AS other, round(jaro_winkler_similarity(a.n_name, b.n_name), 4) AS similarity FROM nation a JOIN nation b ON left(a.n_name, 1) = left(b.n_name, 1)",
    "components_by_phone": """
WITH h AS (SELECT c_custkey % 997 AS g, min(c_custkey) AS hub, count(*) AS n FROM customer GROUP BY g)
SELECT c_custkey AS node, hub AS component FROM customer JOIN h ON c_custkey % 997 = g WHERE n > 1
""",
    "attach_or_park": """
WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), f AS (SELECT l_orderkey, min(s_nationkey) AS p, max(s_nationkey) AS q, min(s_suppkey) AS via FROM k JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
SELECT o_orderkey AS element_id, coalesce(p, -1) AS person_id, coalesce(via, -1) AS via_key FROM orders LEFT JOIN (SELECT * FROM f WHERE p = q) ON l_orderkey = o_orderkey
""",
    "exposure_flags": """
WITH e AS (SELECT l_suppkey AS person_id, CASE l_returnflag WHEN 'A' THEN 'ssn' WHEN 'N' THEN 'passport' ELSE 'email' END AS category, CASE WHEN l_linestatus = 'O' THEN 0.95 ELSE 0.85 END AS c, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS element_id FROM lineitem WHERE l_tax <= 0.06 AND (l_quantity > 25 OR l_returnflag = 'N'))
SELECT person_id, category, true AS exposed, CAST(max(c) AS DOUBLE) AS confidence, count(DISTINCT element_id) AS evidence_count, 'auto' AS review_status FROM e GROUP BY person_id, category
""",
    "exposure_export": f"""WITH {_PERSONS}, {_FLAGS}
SELECT person_id, alias || ' [nickname]' AS aliases, review_status, CAST(coalesce((SELECT sum(evidence_count) FROM flags f WHERE f.person_id = p.person_id), 0) AS BIGINT) AS evidence_count, mention_count,
  (SELECT max(confidence) FROM flags f WHERE f.person_id = p.person_id AND category = 'ssn') AS ssn, (SELECT max(confidence) FROM flags f WHERE f.person_id = p.person_id AND category = 'credit_card') AS credit_card,
  (SELECT max(confidence) FROM flags f WHERE f.person_id = p.person_id AND category = 'phone') AS phone, (SELECT max(confidence) FROM flags f WHERE f.person_id = p.person_id AND category = 'email') AS email
FROM persons p WHERE mention_count > 0""",
    "identifier_matches": """
WITH t AS (SELECT c_custkey AS uid, c_custkey % 2 AS k, c_custkey % 400 AS v FROM customer), p AS (SELECT DISTINCT o_custkey % 300 AS person_id, o_orderkey % 2 AS k, o_custkey % 400 AS v FROM orders),
m AS (SELECT DISTINCT uid, person_id FROM t JOIN p USING (k, v)), j AS (SELECT uid, person_id, count(*) OVER (PARTITION BY uid) AS a, count(*) OVER (PARTITION BY person_id) AS b FROM m),
o AS (SELECT CASE WHEN a >= 2 THEN 'split' WHEN b >= 2 THEN 'wrongly_merged' ELSE 'matched' END AS outcome FROM j UNION ALL SELECT 'missed' FROM t WHERE uid NOT IN (SELECT uid FROM m) UNION ALL SELECT 'hallucinated' FROM (SELECT DISTINCT person_id FROM p) WHERE person_id NOT IN (SELECT person_id FROM m))
SELECT outcome, count(*) AS n FROM o GROUP BY outcome
""",
    "pairwise_confusion": """
WITH a AS (SELECT c_custkey AS i, c_custkey % 90 AS p, c_custkey % 60 AS t FROM customer), x AS (SELECT count(*) FILTER (WHERE a.p = b.p AND a.t = b.t) AS tp, count(*) FILTER (WHERE a.p = b.p AND a.t <> b.t) AS fp, count(*) FILTER (WHERE a.p <> b.p AND a.t = b.t) AS fn FROM a JOIN a b ON a.i < b.i AND (a.p = b.p OR a.t = b.t))
SELECT tp, fp, fn, round(tp / CAST(tp + fp AS DOUBLE), 4) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 4) AS recall FROM x
""",
    "flag_category_table": f"""WITH {_FLAGS},
cats AS (SELECT unnest(['ssn', 'dob', 'drivers_license', 'passport', 'financial_account', 'credit_card', 'medical', 'credentials', 'address', 'phone', 'email']) AS category),
g AS (SELECT c_custkey AS uid, category, EXISTS (SELECT 1 FROM flags f WHERE f.person_id = c_custkey AND f.category = cats.category AND evidence_count >= 2) AS e, EXISTS (SELECT 1 FROM flags f WHERE f.person_id = c_custkey AND f.category = cats.category AND confidence >= 0.5) AS p FROM customer, cats),
t AS (SELECT category, count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE p AND NOT e) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn FROM g GROUP BY category)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / CAST(tp + fp AS DOUBLE), 4) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / CAST(tp + fn AS DOUBLE), 4) END AS recall FROM t""",
    "merged_ledger": """
WITH l AS (SELECT c_custkey % 300 AS p FROM customer), x AS (
  SELECT p AS person_id, 'rule' AS method, p % 10 NOT IN (1, 2) AS active FROM l UNION ALL SELECT p - p % 10, 'reviewer', true FROM l WHERE p % 10 IN (1, 2))
SELECT person_id, method, active, count(*) AS n FROM x GROUP BY ALL
""",
    "split_ledger": """
WITH x AS (SELECT c_custkey % 300 AS person_id, 'rule' AS method, c_custkey % 50 <> 0 AS active FROM customer UNION ALL SELECT -c_custkey - 1, 'reviewer', true FROM customer WHERE c_custkey % 50 = 0)
SELECT person_id, method, active, count(*) AS n FROM x GROUP BY ALL
""",
    "merge_approvals": """
WITH h AS (SELECT c_custkey % 300 AS p, count(*) AS n FROM customer GROUP BY p), m AS (SELECT i AS absorbed, i - 1 AS survivor FROM range(300) t(i) WHERE i % 10 IN (1, 2))
SELECT absorbed, survivor, coalesce(a.n, 0) AS n_absorbed, coalesce(b.n, 0) AS n_survivor FROM m LEFT JOIN h a ON a.p = absorbed LEFT JOIN h b ON b.p = survivor WHERE coalesce(a.n, 0) + coalesce(b.n, 0) > 9
""",
    "person_counts": """
SELECT CASE WHEN c_custkey % 10 IN (1, 2) THEN c_custkey % 300 - c_custkey % 10 ELSE c_custkey % 300 END AS person_id, count(*) AS mention_count, count(DISTINCT c_nationkey) AS document_count FROM customer GROUP BY 1
""",
    "superseded_items": """
WITH i AS (SELECT o_orderkey, o_custkey AS l, (o_custkey + 300 * (o_orderkey % 2) + o_orderkey % 3) % (SELECT count(*) FROM customer) AS r FROM orders),
c AS (SELECT DISTINCT least(l, r) AS lo, greatest(l, r) AS hi FROM i WHERE o_orderkey % 5 = 0),
s AS (SELECT CASE WHEN coalesce(a.c_custkey % 300 = b.c_custkey % 300, false) OR EXISTS (SELECT 1 FROM c WHERE lo = least(l, r) AND hi = greatest(l, r)) THEN 'dismissed' ELSE 'open' END AS status FROM i LEFT JOIN customer a ON a.c_custkey = l LEFT JOIN customer b ON b.c_custkey = r)
SELECT status, count(*) AS n FROM s GROUP BY status
""",
    "element_decisions": """
WITH e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), v AS (SELECT user_id AS id, max(event_id) % 3 AS k FROM events GROUP BY user_id)
SELECT CASE WHEN k = 0 THEN 'valid' ELSE 'format_only' END AS validation_status, CASE WHEN k = 0 THEN 'reviewer' ELSE 'regex' END AS detector, CASE WHEN k = 1 THEN 'p1' END AS person_id, CASE WHEN k = 2 THEN 'reviewer_dismissed' END AS trap_reason, count(*) AS n
FROM e LEFT JOIN v USING (id) GROUP BY ALL
""",
    "quote_checks": "SELECT doc_id % 2 = 0 AS verified, count(*) AS n FROM documents GROUP BY 1",
    "run_counter_row": f"""WITH {_DOCUMENTS}
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE status = 'done') AS documents_done, (SELECT count(*) FROM docs WHERE status = 'quarantined') AS documents_quarantined, (SELECT count(*) FROM docs WHERE status = 'failed') AS documents_failed,
  count(*) AS elements, count(*) FILTER (WHERE l_tax > 0.06) AS elements_trapped, count(*) FILTER (WHERE l_quantity > 25) AS elements_valid FROM lineitem""",
    "mention_ground_truth": """
WITH m AS (SELECT DISTINCT l_orderkey AS mention_id, l_orderkey % 50 AS doc, l_partkey % 40 AS v FROM lineitem), p AS (SELECT p_partkey % 120 AS uid, p_partkey % 50 AS doc, p_partkey % 40 AS v, p_partkey AS place FROM part),
s AS (SELECT mention_id, uid, count(DISTINCT v) AS n, min(place) AS place FROM m JOIN p USING (doc, v) GROUP BY mention_id, uid), b AS (SELECT mention_id, uid FROM s QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY n DESC, place, uid) = 1)
SELECT mention_id, coalesce(uid, -1) AS uid FROM (SELECT DISTINCT mention_id FROM m) LEFT JOIN b USING (mention_id)
""",
    "trap_leaks": """
SELECT l_returnflag AS category, count(DISTINCT l_orderkey) AS flags, count(*) AS rows FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey % 20 = l_suppkey % 20 AND p_size % 100 = l_partkey % 100) GROUP BY l_returnflag
""",
    "threshold_calibration": """
WITH s AS (SELECT o_custkey AS l, (o_custkey + o_orderkey % 7 * 40) % (SELECT count(*) FROM customer) AS r, round(o_totalprice / 500000, 2) AS score, o_orderkey % 9 = 0 AS hard FROM orders),
p AS (SELECT score, hard, a.c_custkey % 40 = b.c_custkey % 40 AS same FROM s JOIN customer a ON a.c_custkey = l JOIN customer b ON b.c_custkey = r WHERE l < r),
real AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS real FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey % 40)),
g AS (SELECT auto, count(*) FILTER (WHERE score >= auto AND NOT hard) AS linked, count(*) FILTER (WHERE score >= auto AND NOT hard AND same) AS "right" FROM p, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS auto) GROUP BY auto),
x AS (SELECT g.*, real, round(CASE WHEN linked > 0 THEN "right" / CAST(linked AS DOUBLE) ELSE 1 END, 4) AS precision, round("right" / CAST(real AS DOUBLE), 4) AS recall FROM g, real)
SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1 FROM x
""",
}

_ELEMENTS = """elements AS (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS element_id, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS mention_id, l_orderkey AS document_id, l_orderkey AS passage_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'ssn' WHEN 1 THEN 'email' ELSE 'medical' END AS element_type, CAST(l_partkey % 90 AS VARCHAR) AS value_normalized,
  CASE WHEN l_quantity > 25 THEN 'valid' ELSE 'format_only' END AS validation_status, l_tax > 0.06 AS trapped,
  CASE WHEN l_returnflag = 'R' THEN coalesce(CASE WHEN l_partkey % 50 = 0 THEN l_suppkey % 40 END, CASE WHEN l_partkey % 30 = 0 THEN l_partkey % 40 END) END AS signal FROM lineitem),
links AS (SELECT s_suppkey % 40 AS person_id, s_suppkey AS mention_id, s_suppkey % 7 <> 0 AS active FROM supplier),
linked AS (SELECT person_id, e.* FROM links JOIN elements e USING (mention_id) WHERE active),
good AS (SELECT * FROM linked WHERE NOT trapped AND (validation_status = 'valid' OR element_type = 'medical'))"""
_PLANTED = """planted AS (SELECT 'd' || c_custkey % 50 AS doc, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS uid, CASE WHEN c_custkey % 2 = 0 THEN 'ssn' ELSE 'email' END AS kind,
  CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '1') ELSE 'a' || c_custkey || '@b.org' END AS raw FROM customer)"""

ORACLES |= {
    "link_ledger": f"WITH {_DOCUMENTS} SELECT s_suppkey % 40 AS person_id, s_suppkey AS mention_id, 'rule' AS method, s_suppkey % 7 <> 0 AS active, s_name AS name_raw, s_suppkey * 3 AS document_id, file_class FROM supplier JOIN docs ON document_id = s_suppkey * 3",
    "linked_elements": f"WITH {_ELEMENTS} SELECT person_id, element_type, count(*) AS n, count(DISTINCT document_id) AS documents FROM linked GROUP BY ALL",
    "signal_attached": f"WITH {_ELEMENTS} SELECT signal AS person_id, count(*) AS n, min(element_id) AS least FROM elements WHERE signal IS NOT NULL GROUP BY 1",
    "person_keys": f"WITH {_ELEMENTS} SELECT person_id, 'ssn:' || value_normalized AS key FROM good WHERE element_type = 'ssn' UNION SELECT s_suppkey % 40, 'employee_id:E' || s_nationkey FROM supplier",
    "attached_elements": f"""WITH {_ELEMENTS},
pk AS (SELECT person_id, 'ssn:' || value_normalized AS key FROM good WHERE element_type = 'ssn' UNION SELECT s_suppkey % 40, 'employee_id:E' || lpad(CAST(s_suppkey AS VARCHAR), 5, '1') FROM supplier),
loose AS (SELECT element_id, passage_id FROM elements WHERE mention_id IS NULL AND signal IS NULL),
held AS (SELECT o_orderkey AS passage_id, 'employee_id:E' || lpad(CAST(o_custkey % 99 AS VARCHAR), 5, '1') AS key FROM orders UNION SELECT passage_id, 'ssn:' || value_normalized FROM elements JOIN orders ON o_orderkey = passage_id WHERE element_type = 'ssn' AND validation_status = 'valid'),
found AS (SELECT element_id, min(person_id) AS person_id, min(key) AS via_key FROM loose JOIN held USING (passage_id) JOIN pk USING (key) GROUP BY element_id HAVING min(person_id) = max(person_id))
SELECT element_id, coalesce(person_id, -1) AS person_id, coalesce(via_key, 'parked') AS via_key FROM loose LEFT JOIN found USING (element_id)""",
    "obsolete_parked": f"""WITH {_ELEMENTS}, judged AS (SELECT element_id % 4 <> 0 AS open, element_id IN (SELECT element_id FROM elements WHERE mention_id IS NOT NULL OR signal IS NOT NULL) AS resolved FROM elements)
SELECT CASE WHEN open AND resolved THEN 'dismissed' WHEN open THEN 'open' ELSE 'done' END AS status, CASE WHEN open AND resolved THEN 'auto_attached' ELSE 'none' END AS decision, count(*) AS n FROM judged GROUP BY ALL""",
    "recomputed_persons": f"""WITH {_ELEMENTS}, own AS (SELECT person_id, element_id, element_type, validation_status, trapped FROM linked UNION SELECT signal, element_id, element_type, validation_status, trapped FROM elements WHERE signal IS NOT NULL)
SELECT person_id, CASE element_type WHEN 'medical' THEN 'medical' ELSE element_type END AS category, count(*) AS evidence_count, max(CAST(0.85 AS DOUBLE)) AS confidence FROM own
WHERE person_id < 7 AND NOT trapped AND (validation_status = 'valid' OR element_type = 'medical') GROUP BY ALL""",
    "person_documents": "SELECT s_suppkey % 40 AS person_id, count(DISTINCT s_suppkey * 3) AS documents FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1",
    "element_search": f"WITH {_ELEMENTS} SELECT element_id, document_id FROM elements WHERE element_type = 'email' AND value_normalized = '42' ORDER BY element_id LIMIT 50",
    "quarantine_list": "SELECT o_orderkey AS quarantine_id, o_orderkey AS document_id, o_orderpriority AS file_class FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 10 = 3",
    "pair_cards": f"""WITH {_ELEMENTS}, held AS (SELECT mention_id, list_sort(list('ssn:' || value_normalized)) AS h FROM elements WHERE element_type = 'ssn' AND mention_id IS NOT NULL GROUP BY mention_id)
SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id, a.s_name AS left_name, b.s_name AS right_name, CAST(coalesce(len(x.h), 0) AS INTEGER) AS n_left, y.h[1] AS first_right
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 LEFT JOIN held x ON x.mention_id = a.s_suppkey LEFT JOIN held y ON y.mention_id = b.s_suppkey""",
    "kept_separate": """WITH links AS (SELECT s_suppkey % 40 AS person_id, s_suppkey AS mention_id, s_suppkey % 7 <> 0 AS active FROM supplier),
pairs AS (SELECT s_suppkey AS l, s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 40 ELSE 1 END AS r FROM supplier WHERE s_suppkey % 9 = 1),
judged AS (SELECT l, r, x.person_id = y.person_id AS same FROM pairs JOIN links x ON x.mention_id = l AND x.active JOIN links y ON y.mention_id = r AND y.active),
v AS (SELECT mention_id, bool_or(leaves) AS leaves FROM (SELECT l AS mention_id, false AS leaves FROM judged UNION ALL SELECT r, same FROM judged) GROUP BY 1)
SELECT person_id, mention_id, CASE WHEN active AND NOT leaves THEN 'reviewer' ELSE 'rule' END AS method, active AND NOT coalesce(leaves, false) AS active FROM links LEFT JOIN v USING (mention_id)
UNION ALL SELECT mention_id + 1000, mention_id, 'reviewer', true FROM links JOIN v USING (mention_id) WHERE active AND leaves""",
    "manifest_expectations": f"WITH {_PLANTED} SELECT kind AS category, count(DISTINCT uid) AS n FROM planted WHERE uid IS NOT NULL GROUP BY kind",
    "manifest_identifiers": "SELECT CAST(c_custkey AS VARCHAR) AS uid, 'email' AS id_type, 'u' || c_custkey || '@x.org' AS value FROM customer",
    "manifest_traps": f"WITH {_PLANTED} SELECT DISTINCT doc, raw AS value FROM planted WHERE uid IS NULL AND kind = 'ssn' UNION SELECT DISTINCT doc, regexp_replace(raw, '[^0-9]', '', 'g') FROM planted WHERE uid IS NULL AND regexp_replace(raw, '[^0-9]', '', 'g') SIMILAR TO '[0-9]{{9}}'",
    "predicted_identifiers": f"WITH {_ELEMENTS} SELECT person_id, element_type AS id_type, count(DISTINCT value_normalized) AS n FROM good WHERE element_type IN ('ssn', 'email') GROUP BY ALL",
    "imported_manifest": """WITH fresh AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'OTHER' ELSE c_mktsegment END AS m FROM customer WHERE c_custkey % 3 = 0)
SELECT m AS c_mktsegment, count(*) AS n FROM (SELECT c_mktsegment AS m FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT m FROM fresh) GROUP BY 1
UNION ALL SELECT 'conflicts', count(*) FROM fresh JOIN customer USING (c_custkey) WHERE m <> c_mktsegment""",
    "recognised_lines": """WITH w AS (SELECT l_orderkey % 500 AS page_id, l_orderkey % 3 AS b, l_orderkey AS l, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS line, sum(l_quantity - 5) AS conf, count(*) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL)
SELECT page_id, CAST(length(string_agg(line, chr(10) ORDER BY b, l)) AS INTEGER) AS n_chars, sha256(string_agg(line, chr(10) ORDER BY b, l)) AS sha256, round(sum(conf) / sum(n), 4) AS mean_conf FROM w GROUP BY page_id""",
    "confidence_rollup": "SELECT l_suppkey AS mention_id, coalesce(min(l_tax) FILTER (WHERE l_quantity > 10), 0.0) AS confidence FROM lineitem GROUP BY 1",
    "answer_faults": "SELECT o_orderkey % 5 AS shape, CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'not_json' WHEN 2 THEN 'empty_value' WHEN 3 THEN 'mention_ref' ELSE 'confidence' END AS fault, count(*) AS n FROM orders GROUP BY ALL",
    "decision_rationales": """WITH p AS (SELECT o_orderkey % 7 = 0 AS hard, o_orderkey % 5 = 0 AS strong, o_orderkey % 2 = 0 AS dob, o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AS capped FROM orders)
SELECT CASE WHEN hard THEN 'hard_conflict' WHEN strong THEN 'exact_ssn' WHEN dob THEN 'name_dob' ELSE 'name' END AS rule_id,
CASE WHEN hard THEN 'hard conflict: both mentions carry disjoint passport values; score forced to 0'
 ELSE 'score 0.40 (' || CASE WHEN dob THEN 'dob_match +0.20, ' ELSE '' END || 'name_similarity +0.35' || CASE WHEN strong THEN ', shared_strong +0.90' ELSE '' END || ')' || CASE WHEN capped THEN '; capped: name_only_cap (uncorroborated name evidence)' ELSE '' END END AS rationale, count(*) AS n FROM p GROUP BY ALL""",
    "error_histogram": """SELECT error_class, count(*) AS n FROM (
SELECT CASE c_custkey % 5 WHEN 1 THEN 'er_split' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ocr_failure' ELSE 'missed_extraction' END WHEN 3 THEN 'hallucinated' WHEN 4 THEN 'er_overmerge' END AS error_class FROM customer
UNION ALL SELECT CASE c_custkey % 4 WHEN 0 THEN 'trap_fp' WHEN 1 THEN 'wrong_category' END FROM customer) WHERE error_class IS NOT NULL GROUP BY 1""",
}
