"""DuckDB statements for the queries of ``plans.store_queries``."""

from __future__ import annotations

from sievemark.plans.oracles import _CANON, _ELEMENTS, _FLAGS, _LINES, _MENTIONS

ORACLES: dict[str, str] = {
    "updated_pairs": f"""WITH {_MENTIONS},
kept AS (SELECT * FROM mentions WHERE mention_id % 50 <> 2),
canon AS (SELECT mention_id, sn, unnest(string_split({_CANON.replace(' g ', ' lower(g) ').replace('ELSE g', 'ELSE lower(g)')}, ',')) AS c FROM kept),
keys AS (
  SELECT mention_id, 'strong:phone:' || phone AS key, true AS strong FROM kept UNION SELECT mention_id, 'strong:email:' || email, true FROM kept WHERE email IS NOT NULL
  UNION SELECT mention_id, 'dob:' || dob, false FROM kept WHERE dob IS NOT NULL
  UNION SELECT mention_id, 'typo:' || unnest(list_concat([lower(sn)], list_transform(range(1, length(sn) + 1), lambda i: left(lower(sn), i - 1) || substr(lower(sn), i + 1)))) || ':' || left(c, 1), false FROM canon
), ok AS (SELECT key FROM keys GROUP BY key HAVING count(*) >= 2 AND (bool_or(strong) OR count(*) <= 200))
SELECT l.mention_id AS left_id, r.mention_id AS right_id, string_agg(l.key, ';' ORDER BY l.key) AS blocks FROM keys l JOIN ok USING (key) JOIN keys r ON l.key = r.key AND l.mention_id < r.mention_id GROUP BY ALL""",
    "updated_clusters": "SELECT count(*) AS mentions, CAST(0 AS BIGINT) AS apart FROM customer",
    "stored_contents": """WITH c AS (SELECT DISTINCT sha256(text) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT left(h, 2) AS shard, count(*) AS contents, CAST(sum(n) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS written_again FROM c GROUP BY 1""",
    "replaced_run": f"""WITH {_FLAGS}, p AS (SELECT c_custkey AS person_id FROM customer)
SELECT 'one' AS run_id, count(*) AS n, CAST(sum(person_id) AS BIGINT) AS ids, 'persons' AS tab FROM p WHERE person_id % 3 = 0 UNION ALL SELECT 'two', count(*), CAST(sum(person_id) AS BIGINT), 'persons' FROM p WHERE person_id % 2 = 0
UNION ALL SELECT 'one', count(*), CAST(sum(person_id) AS BIGINT), 'flags' FROM flags WHERE person_id % 3 = 0 UNION ALL SELECT 'two', count(*), CAST(sum(person_id) AS BIGINT), 'flags' FROM flags WHERE category = 'ssn'""",
    "chunk_locations": f"""
WITH l AS (SELECT doc_id, {_LINES} AS lines FROM (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0)),
p AS (SELECT doc_id, seq, array_to_string(lines[seq * 3 + 1 : seq * 3 + 3], chr(10)) AS text FROM (SELECT doc_id, lines, unnest(range(0, CAST(ceil(len(lines) / 3.0) AS BIGINT))) AS seq FROM l)),
placed AS (SELECT doc_id, seq, seq // 4 AS chunk, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, seq // 4 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
whole AS (SELECT doc_id, chunk, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM placed GROUP BY ALL),
reports AS (SELECT doc_id, chunk, seq AS nth, string_split(text, ' ')[2] AS value FROM placed WHERE string_split(text, ' ')[2] <> ''),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY doc_id, chunk, value ORDER BY nth) AS k FROM reports r),
cut AS (SELECT r.*, string_split(w.text, value) AS parts FROM ranked r JOIN whole w USING (doc_id, chunk)),
found AS (SELECT *, CASE WHEN len(parts) > k THEN list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(value) END AS place FROM cut)
SELECT f.doc_id, CAST(f.chunk AS INTEGER) AS chunk, value, nth, s.seq, CAST(place - s.start AS INTEGER) AS char_start, CAST(place - s.start + length(value) AS INTEGER) AS char_end
FROM found f LEFT JOIN placed s ON s.doc_id = f.doc_id AND s.chunk = f.chunk AND s.start <= place AND place + length(value) <= s.start + length(s.text)""",
    "chunk_round_trip": "SELECT true AS some, CAST(0 AS BIGINT) AS otherwise",
    "cluster_sweep": """
WITH RECURSIVE s AS (SELECT o_custkey AS l, (o_custkey + o_orderkey % 7 * 40) % (SELECT count(*) FROM customer) AS r, max(round(o_totalprice / 500000, 2)) AS score FROM orders WHERE o_custkey < (o_custkey + o_orderkey % 7 * 40) % (SELECT count(*) FROM customer) GROUP BY ALL),
t AS (SELECT unnest([0.6, 0.7, 0.8]::DOUBLE[]) AS auto),
e AS (SELECT auto, l AS a, r AS b FROM s, t WHERE score >= auto UNION SELECT auto, r, l FROM s, t WHERE score >= auto),
reach AS (SELECT auto, c_custkey AS m, c_custkey AS c FROM customer, t UNION SELECT e.auto, e.b, reach.c FROM reach JOIN e ON e.auto = reach.auto AND e.a = reach.m),
cl AS (SELECT auto, m, min(c) AS c, any_value(m % 40) AS u FROM reach GROUP BY auto, m),
linked AS (SELECT auto, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS linked FROM (SELECT auto, c, count(*) AS n FROM cl GROUP BY ALL) GROUP BY auto),
hits AS (SELECT auto, u, c, count(*) AS n FROM cl GROUP BY ALL),
good AS (SELECT auto, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS "right", coalesce(sum(n * (n - 1) // 2) FILTER (WHERE u < 7), 0) AS nick FROM hits GROUP BY auto),
real AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS real, sum(n * (n - 1) // 2) FILTER (WHERE u < 7) AS nicks FROM (SELECT c_custkey % 40 AS u, count(*) AS n FROM customer GROUP BY 1)),
leak AS (SELECT x.auto, count(DISTINCT x.u) AS leaks FROM hits x JOIN hits y ON x.auto = y.auto AND x.c = y.c AND y.u = (x.u + 1) % 40 GROUP BY 1),
j AS (SELECT auto, linked, "right", real, nick, nicks, coalesce(leaks, 0) AS leaks, CASE WHEN linked > 0 THEN "right" / CAST(linked AS DOUBLE) ELSE 1.0 END AS p, "right" / CAST(real AS DOUBLE) AS q FROM linked JOIN good USING (auto) LEFT JOIN leak USING (auto), real)
SELECT auto, linked, "right", real, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 4) AS f1, leaks, round(nick / CAST(nicks AS DOUBLE), 4) AS nickname_recall FROM j""",
    "gray_sweep": """
WITH RECURSIVE s AS (SELECT o_custkey AS l, (o_custkey + o_orderkey % 7 * 40) % (SELECT count(*) FROM customer) AS r, max(round(o_totalprice / 500000, 2)) AS score FROM orders WHERE o_custkey < (o_custkey + o_orderkey % 7 * 40) % (SELECT count(*) FROM customer) GROUP BY ALL),
t AS (SELECT unnest([0.6, 0.7, 0.8]::DOUBLE[]) AS auto), u AS (SELECT unnest([0.3, 0.5]::DOUBLE[]) AS distinct_at),
e AS (SELECT auto, l AS a, r AS b FROM s, t WHERE score >= auto UNION SELECT auto, r, l FROM s, t WHERE score >= auto),
reach AS (SELECT auto, c_custkey AS m, c_custkey AS c FROM customer, t UNION SELECT e.auto, e.b, reach.c FROM reach JOIN e ON e.auto = reach.auto AND e.a = reach.m),
cl AS (SELECT auto, m, min(c) AS c FROM reach GROUP BY auto, m),
good AS (SELECT auto, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS "right" FROM (SELECT auto, m % 40, c, count(*) AS n FROM cl GROUP BY ALL) GROUP BY auto),
real AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS real FROM (SELECT count(*) AS n FROM customer GROUP BY c_custkey % 40)),
g AS (SELECT auto, distinct_at, count(*) AS gray, count(*) FILTER (WHERE l % 40 = r % 40) AS true_gray FROM s, t, u WHERE score > distinct_at AND score < auto AND (SELECT c FROM cl WHERE cl.auto = t.auto AND m = l) <> (SELECT c FROM cl WHERE cl.auto = t.auto AND m = r) GROUP BY ALL)
SELECT auto, distinct_at AS "distinct", coalesce(gray, 0) AS gray, coalesce(true_gray, 0) AS true_gray, real - "right" - coalesce(true_gray, 0) AS lost, round(("right" + coalesce(true_gray, 0)) / CAST(real AS DOUBLE), 4) AS ceiling
FROM good CROSS JOIN u CROSS JOIN real LEFT JOIN g USING (auto, distinct_at)""",
    "redacted_records": """WITH e AS (SELECT l_orderkey, string_agg('{"line":' || l_linenumber || ',"element_type":"' || l_returnflag || '","value_raw":"[REDACTED]"' || CASE WHEN l_linenumber % 2 = 0 THEN ',"password":"[REDACTED]"' ELSE '' END || '}', ',' ORDER BY l_linenumber, l_returnflag, CAST(l_partkey AS VARCHAR), l_suppkey) AS es FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, '{"event":' || o_orderkey || ',"detail":{"credentials":{"api_key":"[REDACTED]","at":"' || o_orderpriority || '"}},"elements":[' || es || ']}' AS record FROM orders JOIN e ON l_orderkey = o_orderkey""",
    "name_search": """WITH p AS (SELECT c_custkey AS person_id, c_name, '[{"name":"' || c_mktsegment || '","kind":"nickname"}]' AS aliases FROM customer)
SELECT person_id, search FROM p, (SELECT unnest(['00012', 'build', 'r#0%77', '9']) AS search) WHERE c_name ILIKE '%' || search || '%' OR aliases ILIKE '%' || search || '%'""",
    "element_lookup": f"WITH {_ELEMENTS} SELECT element_id, element_type, document_id FROM elements WHERE (element_type = 'email' AND value_normalized = '42') OR (element_type = 'ssn' AND value_normalized = '7')",
    "merge_circles": """WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS absorbed, k - k % 20 AS survivor FROM c WHERE k % 20 BETWEEN 1 AND 4
UNION ALL SELECT k, k - k % 20 + 8 FROM c WHERE k % 20 IN (6, 7)
UNION ALL SELECT k + x, k + 1 FROM c, (SELECT unnest([0, 2]) AS x) WHERE k % 20 = 10""",
    "flags_of_persons": f"WITH {_FLAGS} SELECT person_id, category, confidence, evidence_count FROM flags JOIN customer ON c_custkey = person_id WHERE c_acctbal < 0",
    "latest_run_with_persons": "SELECT o_orderkey % 10 AS run_id FROM orders WHERE o_orderkey % 10 NOT IN (1, 4) ORDER BY o_orderdate DESC, run_id DESC LIMIT 1",
    "judged_merges": f"""WITH {_MENTIONS}, n AS (SELECT count(*) AS n FROM customer),
asked AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN c_custkey WHEN 1 THEN c_custkey + n WHEN 2 THEN (c_custkey + 997) % n ELSE (c_custkey + 130) % n END AS r, CASE WHEN c_custkey % 4 = 3 THEN 'no_merge' ELSE 'merge' END AS decision FROM customer, n),
sizes AS (SELECT mention_id % 150 AS p, count(*) AS size FROM mentions WHERE mention_id % 13 <> 0 GROUP BY 1),
sides AS (SELECT k, k AS m FROM asked UNION ALL SELECT k, r FROM asked),
held AS (SELECT k, CASE WHEN m < n AND m % 13 <> 0 THEN m % 150 END AS p, count(*) AS c FROM sides, n GROUP BY ALL),
impact AS (SELECT k, CAST(sum(CASE WHEN held.p IS NULL THEN c ELSE size END) AS BIGINT) AS impact FROM held LEFT JOIN sizes ON sizes.p = held.p GROUP BY k),
judged AS (SELECT a.k, a.decision, a.k = a.r AS same, y.mention_id IS NULL AS unknown, x.phone <> y.phone OR (x.email <> y.email AND x.email IS NOT NULL AND y.email IS NOT NULL) AS conflict,
  x.phone = y.phone OR coalesce(x.email = y.email, false) OR coalesce(x.dob = y.dob, false) OR x.doc_id = y.doc_id AS backed FROM asked a JOIN mentions x ON x.mention_id = a.k LEFT JOIN mentions y ON y.mention_id = a.r)
SELECT k AS proposal_id, CASE WHEN same THEN 'identical' WHEN unknown THEN 'unknown_mention' WHEN decision = 'merge' AND conflict THEN 'hard_conflict' WHEN decision = 'merge' AND NOT backed THEN 'name_only' WHEN decision = 'merge' AND impact > 10 THEN 'pending_approval' ELSE decision END AS outcome, impact
FROM judged JOIN impact USING (k)""",
    "checked_estimates": """WITH v AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey AS k, o_orderkey % 6 AS s, o_orderkey % 3 AS a, o_orderkey % 4 AS b, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM orders LEFT JOIN v ON v.k = o_orderkey),
f AS (SELECT *, CASE WHEN s < 1 THEN 'sample_size' WHEN k % 50 = 0 THEN 'range' WHEN a + b > s THEN 'exceeds_sample' ELSE 'none' END AS fault FROM e)
SELECT k AS audit_id, n AS verdicts_recorded, fault, CASE WHEN fault <> 'none' THEN 'none' WHEN a + b <> n THEN 'verdicts' WHEN b <> c THEN 'contradicted' ELSE 'none' END AS warning FROM f""",
    "accuracy_summaries": """SELECT o_orderkey AS accuracy_run_id, ['failed', 'finished', 'running', 'pending'][o_orderkey % 4 + 1] AS status, o_orderpriority AS config_profile, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 10 / 10.0 END AS person_precision,
  CAST(NULL AS DOUBLE) AS person_recall, CASE WHEN o_orderkey % 4 = 1 THEN CAST(0.5 AS DOUBLE) END AS person_f1, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 7 END AS trap_derived_fp_flags FROM orders""",
}
