"""Pairs judged in tiles against pairs that are made and scored one by one."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import judged, resolve
from sievemark.operators.incremental import ResolutionStore
from test_growth import within

MENTION = "mention_id long, doc_id string, name_raw string, dob string, elements map<string,array<string>>"


def some_mentions(spark, seed, n=70):
    rng = random.Random(seed)
    some = lambda values, most=1: rng.sample(values, rng.randint(1, most))
    rows = []
    for k in range(n):
        given, surname = rng.choice(["Robert", "Bob", "R.", "Roberta", "Ann", "Josef"]), rng.choice(["Chen", "Cheng", "Fournier", "Fournyer", "Ito"])
        held = {}
        for kind, values, most in (
            ("phone", ["2125550001", "2125550002", "2125550003", None], 2), ("email", ["a@x.y", "b@x.y", "c@x.y"], 2), ("ssn", ["123456789", "223456789", "12"], 1),
            ("ssn_last4", ["6789", "1111", None], 2), ("address", ["1 Main St", "1 Main Road", "", "9 High St", None], 2), ("passport", ["P:1", "P:2", "P:3"], 3),
        ):
            if rng.random() < 0.4:
                held[kind] = rng.choice([some(values, most), some(values, most), []])
        rows.append((k * 11 % n, rng.choice(["d1", "d2", "d3", None]), rng.choice([f"{given} {surname}", f"{surname}, {given}", given, "", None]), rng.choice([None, None, "1990-01-02", "1991-01-02"]), held))
    return resolve.mentions_of(spark.createDataFrame(rows, MENTION)).cache()


def text(df):
    return sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())


@pytest.mark.parametrize("seed, most, n, held", [(1, 200, 70, 10**6), (2, 5, 70, 10**6), (4, 200, 26, 0)])
def test_tiles_equal_pairs(spark, seed, most, n, held):
    m = some_mentions(spark, seed, n)
    keys = resolve.block_keys(m).cache()
    want = resolve.score_pairs(resolve.candidate_features(keys, m, most)).cache()
    own = judged.evidence(keys, m, most, tile=9).cache()
    plain = want.select("left_id", "right_id", "score", "hard_reason", "name_similarity", "nickname_hit", "dob_match", F.size("shared").alias("shared"))
    assert len(text(plain)) > 50 and text(judged.scored(own)) == text(plain)

    clusters, banded = resolve.cluster(m, want)
    assert n < 70 or not banded.where("band = 'blocked_by_conflict'").isEmpty()
    # by tasks that hold mentions, or by joins of links
    placed = judged.clusters(own, m, held=held).cache()
    assert text(placed.select("mention_id", "cluster_id")) == text(clusters)
    links = want.where(f"score >= {resolve.AUTO} and hard_reason is null")
    assert placed.join(links, F.col("mention_id") == F.col("left_id")).join(placed.select(F.col("mention_id").alias("right_id"), F.col("component").alias("other")), "right_id").where("component <> other").isEmpty()

    counts = judged.band_counts(own, clusters)
    assert text(counts.where("left").groupBy("score", "band", "apart").agg(F.sum("n").alias("n"))) == text(banded.withColumn("apart", F.expr("left_cluster <> right_cluster")).groupBy("score", "band", "apart").agg(F.count(F.lit(1)).alias("n")))
    of_cluster = counts.withColumns({"left_cluster": F.col("cluster_id"), "right_cluster": F.col("cluster_id")})
    assert text(resolve.persons(m, clusters, of_cluster)) == text(resolve.persons(m, clusters, banded))

    fresh = judged.evidence(keys, m.withColumn("fresh", F.col("mention_id") % 5 == 0), most, tile=9)
    ends = links.where("left_id % 5 = 0 or right_id % 5 = 0").select(F.explode(F.array("left_id", "right_id")).alias("mention_id")).distinct()
    assert text(judged.linked(fresh, resolve.AUTO)) == text(ends)


def test_no_mentions_and_text_ids(spark):
    m = resolve.mentions_of(spark.createDataFrame([("b", 1, "Ann Ito", None, {"phone": ["1"]}), ("a", 1, "Ann Ito", None, {"phone": ["1"]}), ("c", 2, None, None, {})], MENTION.replace("mention_id long, doc_id string", "mention_id string, doc_id long")))
    own = judged.evidence(resolve.block_keys(m), m)
    assert [(r.left_id, r.right_id, r.score) for r in judged.scored(own).collect()] == [("a", "b", 1.0)]
    assert sorted(tuple(r) for r in judged.clusters(own, m).collect()) == [("a", "a", "a"), ("b", "a", "a"), ("c", "c", "c")]
    none = judged.evidence(resolve.block_keys(m.limit(0)), m)
    assert judged.scored(none).isEmpty() and judged.counted(none.withColumn("cluster_id", F.col("mention_id"))).isEmpty()
    assert judged.clusters(none, m).count() == 3


def test_a_block_of_many_mentions_in_conflict(spark):
    # 8 million links of one component: more than a task holds as links, few as mentions
    n = 4_000
    rows = spark.range(n).select(
        F.col("id").alias("mention_id"), (F.col("id") % 7).cast("string").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Ann Ito").otherwise("Bob Chen").alias("name_raw"), F.lit(None).cast("string").alias("dob"),
        F.create_map(F.lit("phone"), F.array(F.lit("2125550000")), F.lit("email"), F.when(F.col("id") % 10 == 0, F.array(F.concat((F.col("id") % 30).cast("string"), F.lit("@x.y")))).otherwise(F.array().cast("array<string>"))).alias("elements"))
    m = resolve.mentions_of(rows).cache()
    with within(60):
        own = judged.evidence(resolve.block_keys(m, phonetic=False), m).cache()
        placed = judged.clusters(own, m)
        got = {r.mention_id: r.cluster_id for r in placed.collect()}
        counts = {(r.band, r.decision): r.n for r in resolve.decisions(judged.band_counts(own, placed).where("left")).groupBy("band", "decision").agg(F.sum("n").alias("n")).collect()}
    # the least mention takes all but the two other addresses, whose holders then meet each other alone
    assert got == {k: k % 30 if k % 10 == 0 else 0 for k in range(n)}
    assert sum(counts.values()) == n * (n - 1) // 2 and counts["hard_conflict", "no_merge"] == 133 * 133 + 2 * 133 * 134


def test_pairs_of_a_store_come_from_keys_alone(spark, tmp_path):
    rows = [(k, "d", "Ann Ito" if k % 2 else "Bob Chen", None, {"phone": [f"212555000{k % 3}"]}) for k in range(24)]
    store = ResolutionStore(spark, str(tmp_path / "er"), spark.createDataFrame(rows, MENTION), phonetic=False, buckets=2)
    store.apply(removed=spark.createDataFrame([(3,)], "mention_id long"))
    pairs = store.pairs()
    assert "Python" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert text(pairs) == text(store.banded().select("left_id", "right_id", "blocks"))
