import json
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions.redact import KEYS, redact_json
from sievemark.operators import chunks, extract, resolve
from sievemark.operators.incremental import ResolutionStore
from sievemark.operators.search import ElementIndex, NameIndex, pattern_grams
from sievemark.sources.buckets import BucketTable
from sievemark.sources.store import ContentStore, RunStore

MENTION = "mention_id long, doc_id string, name_raw string, dob string, elements map<string,array<string>>"


# buckets

def test_buckets_are_read_and_replaced_alone(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 90).cast("string").alias("k"), "id")
    table = BucketTable(spark, str(tmp_path / "t"), "k", rows.schema, 16)
    table.create(rows)
    held = {(r.k, r.id) for r in table.read().collect()}
    assert len(held) == 500
    asked = spark.createDataFrame([("3",), ("77",), (None,), ("none",)], "x string")
    assert {r.id for r in table.read(asked).collect()} == {k for k in range(500) if k % 90 in (3, 77)}
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").iterdir()}
    table.replace(spark.createDataFrame([("3",), ("77",), ("new",)], "x string"), spark.createDataFrame([("3", -1), ("new", -2)], rows.schema))
    want = {(k, i) for k, i in held if k not in ("3", "77")} | {("3", -1), ("new", -2)}
    assert {(r.k, r.id) for r in table.read().collect()} == want
    met = {r[0] for r in spark.createDataFrame([("3",), ("77",), ("new",)], "x string").select(table.bucket("x")).collect()}
    changed = {p.name for p in (tmp_path / "t").iterdir() if before.get(p.name) != p.stat().st_mtime_ns and p.name.startswith("_bucket")}
    assert changed == {f"_bucket={b}" for b in met}
    plan = table.read(asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in plan.replace("isnotnull(_bucket#", "_bucket#") or "_bucket" in plan.split("PartitionFilters")[1][:80]
    # a task that fails leaves the table as it was
    with pytest.raises(Exception):
        table.replace(asked, spark.range(3).select(F.when(F.col("id") > 1, F.raise_error(F.lit("lost"))).otherwise("3").cast("string").alias("k"), "id"))
    assert {(r.k, r.id) for r in table.read().collect()} == want
    # a folder that empties stays empty
    table.replace(rows.select("k"), rows.limit(0))
    assert {(r.k, r.id) for r in table.read().collect()} == {("new", -2)}


# originals and runs

def test_contents_are_stored_once(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "s"))
    rows = [(f"p{k:03}", bytes([k % 7]) * (k % 5)) for k in range(60)] + [("none", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    first = {r.path: r for r in store.put(files).collect()}
    contents = {c for _, c in rows if c is not None}
    assert len(first) == 61 and sum(r.stored for r in first.values()) == len(contents) and first["none"].sha256 is None
    assert not any(r.stored for r in store.put(files).collect())
    more = store.put(spark.createDataFrame([("x", b"new"), ("y", rows[3][1])], "path string, content binary")).collect()
    assert {r.path: r.stored for r in more} == {"x": True, "y": False}
    assert store.put(files.limit(0)).isEmpty() and store.damaged().isEmpty()
    got = store.get(spark.createDataFrame([(r.sha256,) for r in first.values()] + [("00" * 32,)], "sha256 string")).collect()
    assert sorted(bytes(r.content) for r in got) == sorted(contents) and all(r.size == len(r.content) for r in got)
    one = store.get(spark.createDataFrame([(first["p003"].sha256,)], "sha256 string"))
    assert f"shard IN ({first['p003'].sha256[:2]})" in one._jdf.queryExecution().toString() or f"= {first['p003'].sha256[:2]}" in one._jdf.queryExecution().toString()


def test_a_run_is_replaced_whole_or_not(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "r"))
    people = lambda n: spark.range(n).withColumnRenamed("id", "person_id")
    with pytest.raises(ValueError):
        store.read("persons", "a")
    store.replace("a", {"persons": people(3), "links": people(5)})
    store.replace("b/2", {"persons": people(2), "links": people(0)})
    bad = spark.range(4).select(F.when(F.col("id") > 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("person_id"))
    with pytest.raises(Exception):
        store.replace("a", {"persons": people(9), "links": bad})
    assert (store.read("persons", "a").count(), store.read("links", "a").count()) == (3, 5)
    store.replace("a", {"persons": people(9), "links": people(1)})
    store.replace("a", {"persons": people(9), "links": people(1)})
    assert sorted((r.run_id, r["count"]) for r in store.read("persons").groupBy("run_id").count().collect()) == [("a", 9), ("b/2", 2)]
    assert store.read("links", "b/2").isEmpty() and store.runs().count() == 2
    assert len(list((tmp_path / "r" / "persons" / "run_id=a").glob("attempt=*"))) <= 2


# incremental resolution

def random_mention(rng, k):
    given, surname = rng.choice(["Robert", "Bob", "Dana", "Ann", "R."]), rng.choice(["Fournier", "Fournyer", "Ellison", "Chen", "Okafor"])
    elements = {}
    for kind, n in (("ssn", 6), ("email", 5), ("phone", 4), ("employee_id", 40)):
        if rng.random() < 0.35:
            elements[kind] = [f"{kind}{rng.randint(1, n)}"]
    return (k, f"d{rng.randint(0, 9)}", rng.choice([f"{given} {surname}", f"{surname}, {given}", None]), rng.choice([None, "1987-03-14", "1990-01-02"]), elements)


def full(spark, rows, most):
    m = resolve.mentions_of(spark.createDataFrame(rows, MENTION))
    scored = resolve.score_pairs(resolve.pair_features(resolve.candidate_pairs(resolve.block_keys(m), most), m))
    clusters, banded = resolve.cluster(m, scored)
    return {r.mention_id: r.cluster_id for r in clusters.collect()}, {(r.left_id, r.right_id): (r.score, r.hard_reason, r.band, tuple(r.blocks)) for r in banded.collect()}


def test_no_pair_is_stored_or_shuffled(spark, tmp_path):
    # a number that all share: pairs are the square of the mentions, what is kept is in proportion to them
    rows = [(k, "d", f"Ann Chen{k}", None, {"phone": ["2125550000"]}) for k in range(120)]
    store = ResolutionStore(spark, str(tmp_path / "er"), spark.createDataFrame(rows, MENTION), phonetic=False, buckets=2)
    kept = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / "er").iterdir())
    assert kept < 30 * len(rows)
    pairs = store.banded()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 120 * 119 // 2 and "Exchange" not in plan[: plan.index("Join")]


def test_changes_equal_a_full_run(spark, tmp_path):
    rng, most = random.Random(6), 6
    held = {k: random_mention(rng, k) for k in range(32)}
    store = ResolutionStore(spark, str(tmp_path / "er"), spark.createDataFrame(list(held.values()), MENTION), most=most, buckets=8)
    state = lambda: ({r.mention_id: r.cluster_id for r in store.clusters().collect()}, {(r.left_id, r.right_id): (r.score, r.hard_reason, r.band, tuple(r.blocks)) for r in store.banded().collect()})
    changed = [random_mention(rng, k) for k in (3, 8, 20, 100, 101)]
    gone = [5, 8, 17, 30]
    fresh = store.apply(spark.createDataFrame(changed, MENTION), spark.createDataFrame([(g,) for g in gone], "mention_id long"))
    held = {k: m for k, m in (held | {m[0]: m for m in changed}).items() if k not in gone}
    want = full(spark, list(held.values()), most)
    assert state() == want
    assert {r.mention_id: r.cluster_id for r in fresh.collect()}.items() <= want[0].items()
    again = ResolutionStore(spark, str(tmp_path / "er"), most=most, buckets=8)  # opened anew, the same change once more
    again.apply(spark.createDataFrame(changed, MENTION), spark.createDataFrame([(g,) for g in gone], "mention_id long"))
    assert state() == want
    asked = spark.createDataFrame([(min(held),), (max(held),)], "mention_id long")
    assert {r.mention_id: r.cluster_id for r in again.clusters(asked).collect()} == {k: want[0][k] for k in (min(held), max(held))}


# chunks

def test_reports_are_led_back_to_passages(spark):
    rng = random.Random(8)
    texts = {(d, s): "".join(rng.choice(["ab", "a", "b", "\n", " ", "é", "\U0001f600"]) for _ in range(rng.randint(0, 40))) for d in range(6) for s in range(rng.randint(1, 9))}
    passages = spark.createDataFrame([(d, "prose", s, t, 1) for (d, s), t in texts.items()] + [(9, "prose", 0, None, 1)], "doc_id long, family string, seq long, text string, chunk int")
    packed = extract.pack_chunks(passages.drop("chunk"), 12)
    spans = chunks.chunk_spans(passages, packed, ["doc_id", "family"])
    whole = {(r.doc_id, r.chunk): (r.text, r.spans) for r in spans.collect()}
    for (text, parts) in whole.values():
        assert all(text[p.start : p.end] == texts.get((d, p.seq), "") for d in [next(k[0] for k, v in whole.items() if v[0] is text)] for p in parts)
    reports = [(d, "prose", c, rng.choice(["ab", "a", "b", "aba", "b\n\na", "", "zz", "é", None]), k, f"r{d}-{c}-{k}") for d, c in whole for k in range(12)] + [(77, "prose", 0, "a", 0, "lost")]
    table = spark.createDataFrame(reports, "doc_id long, family string, chunk int, value string, nth int, seqless string")
    for verbatim in (True, False):
        got = {r.seqless: (r.seq, r.char_start, r.char_end) for r in chunks.locate_in_chunks(spans, table, ["doc_id", "family"], verbatim=verbatim).collect()}
        cursor, want = {}, {}
        for d, _, c, value, k, name in reports:
            want[name] = (None, None, None)
            if not value or (d, c) not in whole:
                continue
            text, parts = whole[d, c]
            if verbatim:
                at = text.find(value, cursor.get((d, c, value), 0))
                cursor[d, c, value] = len(text) + 1 if at < 0 else at + len(value)
                own = [p for p in parts if at >= 0 and p.start <= at and at + len(value) <= p.end]
                if own:
                    want[name] = (own[0].seq, at - own[0].start, at - own[0].start + len(value))
            else:
                part, at = cursor.get((d, c, value), (0, 0))
                while part < len(parts):
                    found = text[parts[part].start : parts[part].end].find(value, at)
                    if found >= 0:
                        want[name] = (parts[part].seq, found, found + len(value))
                        at = found + len(value)
                        break
                    part, at = part + 1, 0
                cursor[d, c, value] = (part, at)
        assert got == want
        assert all(texts[int(n[1:].split("-")[0]), s][a:b] == next(r[3] for r in reports if r[5] == n) for n, (s, a, b) in got.items() if s is not None)
    assert chunks.locate_in_chunks(spans, table.limit(0), ["doc_id", "family"]).isEmpty()


# redaction

def by_hand(x):
    if isinstance(x, dict):
        return {k: "[REDACTED]" if k in KEYS else by_hand(v) for k, v in x.items()}
    return [by_hand(v) for v in x] if isinstance(x, list) else x


def random_json(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {rng.choice([*KEYS, "event", "elements", "val", 'a"value', "value\\", "{", "x:y", "élan"]): random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and kind < 0.6:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, 3, -1.5, "", "value", '"value": "x"', "\\", '\\"', "{[", "a, b: c]", "\n", "é\U0001f600", 'say \\"password\\": "hunter2"'])


def test_redaction_of_any_depth(spark):
    rng = random.Random(11)
    records = [random_json(rng) for _ in range(1_500)] + [{"value": {"value": [1, {"password": {}}]}, "b": [{"api_key": []}]}, {"password": "\\" * 50_000 + '"' * 50_000, "k": "\\" * 50_000}]
    deep = {"value": 1, "x": 2}
    for _ in range(60):
        deep = {"a": [deep], "password": [deep, 1], "z": 0}
        deep["password"] = {"q": [1]}
    records.append(deep)
    texts = [json.dumps(r, ensure_ascii=k % 2 == 0, indent=None if k % 3 else 1, separators=(",", ":") if k % 5 == 0 else None) for k, r in enumerate(records)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, record string").select("id", redact_json(F.col("record")).alias("r")).collect()
    for r in got:
        assert json.loads(r.r) == by_hand(records[r.id]), texts[r.id][:200]
    odd = [None, "", "not json", '{"value": "x"', '{"v\\u0061lue": "secret", "b": 1}', '{"a": 1.50, "value" : 2}']
    got = [r.r for r in spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "id int, record string").select("id", redact_json(F.col("record")).alias("r")).sort("id").collect()]
    assert got[:4] == [None] * 4 and json.loads(got[4]) == {"value": "[REDACTED]", "b": 1} and got[5] == '{"a": 1.50, "value" : "[REDACTED]"}'
    with pytest.raises(ValueError):
        redact_json(F.lit("{}"), ("a.b",))


# search

def test_searches_equal_scans(spark, tmp_path):
    rng = random.Random(12)
    names = ["Robert Fournier", "ANN Ito", "José Núñez", "Straße 5", "O'Neil_Smith", "100% Sure", "aa", "", None, "back\\slash", "İstanbul", "x" * 400]
    rows = [(k, rng.choice(names), [(rng.choice(["Bob", "annie i.", "ROB"]), "nickname")] if rng.random() < 0.5 else []) for k in range(300)] + [(900, None, None)]
    persons = spark.createDataFrame(rows, "person_id long, best_name string, aliases array<struct<name:string,kind:string>>")
    index = NameIndex(spark, str(tmp_path / "n"), persons, buckets=8)
    index = NameIndex(spark, str(tmp_path / "n"), buckets=8)
    for search in ("four", "FOURNIER", "rob%four", "a_n", "ann ito", "ñez", "50", "", "%", "_", "nick", "raß", "back\\\\s", "stan", "zzz", "x" * 50, "oneil", "neil_smi", "0% s"):
        want = {r.person_id for r in persons.where(F.col("best_name").ilike(f"%{search}%") | F.to_json("aliases").ilike(f"%{search}%")).collect()}
        assert {r.person_id for r in index.search(search).collect()} == want, search
    assert pattern_grams(spark, "ab%cd_ef") == [] and pattern_grams(spark, "Abcd%x") == ["abc", "bcd"] and index.candidates("ab") is None
    elements = spark.createDataFrame([(k, f"t{k % 3}", str(k % 20) if k % 7 else None, "x") for k in range(400)], "element_id long, element_type string, value_normalized string, extra string")
    found = ElementIndex(spark, str(tmp_path / "e"), elements, buckets=8)
    found = ElementIndex(spark, str(tmp_path / "e"), buckets=8)
    want = sorted(k for k in range(400) if k % 3 == 1 and k % 20 == 4 and k % 7)
    assert [r.element_id for r in found.find("t1", "4").collect()] == want and found.find("t1", "4", 2).count() == 2
    assert found.find("t1", "none").isEmpty() and found.find_all([("t1", "4"), ("t2", "5")]).columns == elements.columns
