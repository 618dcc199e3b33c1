"""Queries of what is kept between runs: resolution, originals, runs, indexes; and of chunks, sweeps, redaction and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievemark.functions.redact import redact_json
from sievemark.operators import calibrate, casework, chunks, extract, gate, judged, resolve, review
from sievemark.operators.incremental import ResolutionStore
from sievemark.operators.search import ElementIndex, NameIndex
from sievemark.plans import star
from sievemark.session import materialize, shared_dir, table
from sievemark.sources import parsers
from sievemark.sources.store import ContentStore, RunStore

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def updated_pairs(s, d):
    """Candidate pairs after a change: of a full run over other mentions, a fiftieth is added, one corrected, one removed."""
    m = materialize(star.mentions(s, d), "mentions")
    part = F.col("mention_id") % 50
    before = m.where(part != 0).withColumns({"name_raw": F.when(part == 1, F.lit("Weber, Ann")).otherwise(F.col("name_raw")), "dob": F.when(part == 1, F.lit(None)).otherwise(F.col("dob"))})
    store = ResolutionStore(s, _folder(s, "resolution"), before, phonetic=False)
    store.apply(m.where(part < 2), m.where(part == 2).select("mention_id"))
    return store.pairs().select("left_id", "right_id", F.array_join("blocks", ";").alias("blocks"))


@query
def updated_clusters(s, d):
    """How many mentions a change leaves in another cluster than a full run does: none."""
    m = materialize(star.mentions(s, d), "mentions")
    part = F.col("mention_id") % 40
    store = ResolutionStore(s, _folder(s, "resolution"), m.where(part != 3), phonetic=False)
    store.apply(m.where(part == 3))
    made = resolve.written_mentions(m)
    told = materialize(judged.evidence(materialize(resolve.block_keys(made, phonetic=False), "keys"), made), "told")
    anew = judged.clusters(told, made)
    both = anew.join(store.clusters().withColumnRenamed("cluster_id", "kept_id"), "mention_id", "full")
    return both.agg(F.count(F.lit(1)).alias("mentions"), F.count_if(~F.col("cluster_id").eqNullSafe(F.col("kept_id"))).alias("apart"))


@query
def stored_contents(s, d):
    """Texts put twice into a content store: per folder, how many contents and bytes it holds."""
    files = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    store = ContentStore(s, _folder(s, "contents"))
    store.put(files)
    again = store.put(files).where("stored")
    got = store.get(store.put(files))
    shards = got.where(F.sha2("content", 256) == F.col("sha256")).groupBy(store.shard("sha256").alias("shard")).agg(F.count(F.lit(1)).alias("contents"), F.sum("size").alias("bytes"))
    return shards.crossJoin(F.broadcast(again.agg(F.count(F.lit(1)).alias("written_again"))))  # one row


@query
def replaced_run(s, d):
    """Persons and flags of a run that was written, and written again with others: the second is read, and other runs stay."""
    persons, flags = star.persons(s, d).select("person_id", "best_name"), star.flags(s, d).select("person_id", "category")
    store = RunStore(s, _folder(s, "runs"))
    store.replace("one", {"persons": persons, "flags": flags})
    store.replace("two", {"persons": persons.where("person_id % 2 = 0"), "flags": flags.where("category = 'ssn'")})
    store.replace("one", {"persons": persons.where("person_id % 3 = 0"), "flags": flags.where("person_id % 3 = 0")})
    rows = [store.read(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("person_id").alias("ids")).withColumn("tab", F.lit(t)) for t in ("persons", "flags")]
    return rows[0].unionByName(rows[1])


def _line_chunks(s, d):
    passages = parsers.line_passages(table(s, d, "documents").select("doc_id", "text"), lines=3).select("doc_id", F.lit("text").alias("family"), F.col("seq").cast("long").alias("seq"), F.col("passage").alias("text"))
    return materialize(passages, "chunk-passages")


@query
def chunk_locations(s, d):
    """Each passage reports its second word; four passages make a chunk; where do the reports lead?"""
    passages = _line_chunks(s, d)
    made = passages.groupBy("doc_id", (F.floor(F.col("seq") / 4)).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list("seq")).alias("seqs"))
    spans = chunks.chunk_spans(passages, made, ["doc_id"])
    word = F.try_element_at(F.split("text", " "), F.lit(2))
    reports = passages.select("doc_id", (F.floor(F.col("seq") / 4)).cast("int").alias("chunk"), word.alias("value"), F.col("seq").alias("nth")).where("value <> ''")
    found = chunks.locate_in_chunks(spans, reports, ["doc_id"])
    return found.select("doc_id", "chunk", "value", "nth", F.col("seq"), "char_start", "char_end")


@query
def chunk_round_trip(s, d):
    """Values located in packed chunks, read back from their passages: how many have a place, and how many read otherwise (none)."""
    passages = _line_chunks(s, d)
    spans = chunks.chunk_spans(passages, extract.pack_chunks(passages, 400), ["doc_id", "family"])
    words = spans.select("doc_id", "family", "chunk", F.posexplode(F.slice(F.split("text", " "), 1, 40)).alias("nth", "value"))
    found = chunks.locate_in_chunks(spans, words, ["doc_id", "family"])
    back = found.where("seq is not null").join(passages, ["doc_id", "family", "seq"]).select(F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")).alias("read"), "value")
    return back.agg((F.count(F.lit(1)) > 0).alias("some"), F.count_if(F.col("read") != F.col("value")).alias("otherwise"))


def _sweep(s, d):
    n = table(s, d, "customer").count()
    o = table(s, d, "orders")
    pairs = o.select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") + F.col("o_orderkey") % 7 * 40) % n).alias("b"), F.round(F.col("o_totalprice") / 500000, 2).alias("score"))
    scored = pairs.where("a < b").groupBy(F.col("a").alias("left_id"), F.col("b").alias("right_id")).agg(F.max("score").alias("score")).withColumn("hard_reason", F.lit(None).cast("string"))
    truth = table(s, d, "customer").select(F.col("c_custkey").alias("mention_id"), (F.col("c_custkey") % 40).alias("uid"))
    scripted = truth.select(F.col("uid").alias("uid_a"), ((F.col("uid") + 1) % 40).alias("uid_b")).distinct()
    return calibrate.threshold_sweep(scored, truth, scripted, truth.select("uid").where("uid < 7"), autos=(0.6, 0.7, 0.8), distincts=(0.3, 0.5))


@query
def cluster_sweep(s, d):
    return _sweep(s, d)[0]


@query
def gray_sweep(s, d):
    return _sweep(s, d)[1]


@query
def redacted_records(s, d):
    """Orders as log records with their lines nested in them, without values, and without what stands under a named key."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("element_type"), F.col("l_partkey").cast("string").alias("value_raw"),
        F.when(F.col("l_linenumber") % 2 == 0, F.struct(F.array(F.col("l_suppkey")).alias("ids"), F.struct(F.lit("x").alias("value")).alias("more"))).alias("password")))).alias("elements"))
    o = table(s, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    record = F.to_json(F.struct(F.col("o_orderkey").alias("event"), F.struct(F.struct(F.col("o_orderstatus").alias("api_key"), F.col("o_orderpriority").alias("at")).alias("credentials")).alias("detail"), "elements"))
    return o.select("o_orderkey", redact_json(record).alias("record"))


@query
def name_search(s, d):
    """Persons by patterns, with and without grams, through the index."""
    index = NameIndex(s, _folder(s, "names"), star.persons(s, d).select("person_id", "best_name", "aliases"))
    found = [index.search(p).select("person_id", F.lit(p).alias("search")) for p in ("00012", "build", "r#0%77", "9")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query
def element_lookup(s, d):
    index = ElementIndex(s, _folder(s, "elements"), star.elements(s, d).select("element_id", "element_type", "value_normalized", "document_id"))
    return index.find_all([("email", "42"), ("ssn", "7"), ("ssn", "none")]).select("element_id", "element_type", "document_id")


@query
def merge_circles(s, d):
    """Merges that run in circles of five, chains of three, and into two persons at once: whom each person goes into."""
    k = F.col("c_custkey")
    c = table(s, d, "customer")
    circle = c.where(k % 20 < 5).select(k.alias("absorbed"), F.when(k % 20 == 4, k - 4).otherwise(k + 1).alias("survivor"))
    chain = c.where((k % 20).isin(6, 7)).select(k.alias("absorbed"), (k + 1).alias("survivor"))
    double = c.where(k % 20 == 10).select(k.alias("absorbed"), F.explode(F.array(k + 1, k + 2)).alias("survivor"))
    return review.survivors(circle.unionByName(chain).unionByName(double))


@query
def flags_of_persons(s, d):
    return casework.flags_of_persons(star.flags(s, d), star.persons(s, d).where("review_status = 'needs_review'")).select("person_id", "category", "confidence", "evidence_count")


@query
def latest_run_with_persons(s, d):
    docs = star.documents(s, d)
    runs = docs.groupBy("run_id").agg(F.max("created_at").alias("created_at"))
    return casework.latest_run_with_persons(runs, docs.where("run_id not in (1, 4) and person_id is not null").select("run_id"))


@query
def judged_merges(s, d):
    """Proposals to merge each mention with others of its telephone and of its name: what the gate makes of them."""
    m = resolve.mentions_of(star.mentions(s, d))
    k, n = F.col("c_custkey"), table(s, d, "customer").count()
    asked = table(s, d, "customer").select(k.alias("proposal_id"), k.alias("left_id"), F.when(k % 5 == 0, k).when(k % 5 == 1, k + n).when(k % 5 == 2, (k + 997) % n).otherwise((k + 130) % n).alias("right_id"), F.when(k % 4 == 3, "no_merge").otherwise("merge").alias("decision"))
    held = star.mentions(s, d).select("mention_id", (F.col("mention_id") % 150).alias("person_id"), (F.col("mention_id") % 13 != 0).alias("active"))
    return gate.judged_proposals(asked, m, held).select("proposal_id", "outcome", "impact")


@query
def checked_estimates(s, d):
    o, li = table(s, d, "orders"), table(s, d, "lineitem")
    seen = li.select(F.col("l_orderkey").alias("audit_id"), F.col("l_partkey").alias("flag_id"), F.when(F.col("l_returnflag") == "R", "contradicted").otherwise("verified").alias("verdict"))
    k = F.col("o_orderkey")
    made = o.select(k.alias("audit_id"), (k % 6).alias("sample_size"), (k % 3).alias("verified"), (k % 4).alias("contradicted"), F.when(k % 50 == 0, 1.5).otherwise(0.5).alias("estimated_error_rate"))
    return gate.checked_estimates(made, seen).select("audit_id", "verdicts_recorded", F.coalesce("fault", F.lit("none")).alias("fault"), F.coalesce("warning", F.lit("none")).alias("warning"))


@query
def accuracy_summaries(s, d):
    k = F.col("o_orderkey")
    metrics = F.when(k % 4 == 0, F.to_json(F.struct(F.lit("boom").alias("error")))).when(k % 4 == 1, F.to_json(F.struct(F.struct((k % 10 / 10).alias("precision"), F.lit(0.5).alias("f1")).alias("person"), F.struct((k % 7).alias("trap_derived_fp_flags")).alias("trap_scorecard"))))
    runs = table(s, d, "orders").select(k.alias("accuracy_run_id"), F.to_json(F.struct(F.col("o_orderpriority").alias("config_profile"))).alias("config_snapshot"), metrics.alias("metrics"), F.when(k % 4 != 3, F.col("o_orderdate")).alias("started_at"), F.when(k % 4 < 2, F.col("o_orderdate")).alias("finished_at"), F.col("o_orderdate").alias("created_at"))
    return gate.accuracy_summaries(runs).select("accuracy_run_id", "status", "config_profile", "person_precision", "person_recall", "person_f1", "trap_derived_fp_flags")
