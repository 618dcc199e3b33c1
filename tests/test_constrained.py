import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators.constrained import constrained_components, merge_forest


def one_pass(links, foes):
    """By definition: sets of members, every member asked for its enemies."""
    part, taken = {}, []
    for s, a, b in sorted((-s, a, b) for a, b, s in links if a != b):
        x, y = part.setdefault(a, {a}), part.setdefault(b, {b})
        if x is y or any((p, q) in foes or (q, p) in foes for p in x for q in y):
            continue
        taken.append((a, b, -s))
        x |= y
        for node in y:
            part[node] = x
    return {n: min(p) for n, p in part.items()}, taken


def graphs(rng, n, most):
    links, foes, base = [], [], 0
    for _ in range(n):
        size = rng.randint(2, most)
        nodes = list(range(base, base + size))
        base += size
        scores = rng.choice([[0.9], [0.85, 0.9, 0.95], [k / 1000 for k in range(850, 1000)]])
        for a in nodes:
            for b in nodes:
                if a < b and rng.random() < 0.55:
                    (foes if rng.random() < 0.25 else links).append((a, b))
        links = [(*p[:2], p[2] if len(p) > 2 else rng.choice(scores)) for p in links]
    return links, foes


@pytest.mark.parametrize("held", [0, 1_000])
def test_a_thousand_graphs_equal_one_pass(spark, held):
    links, foes = graphs(random.Random(held), 1_000, 8 if held else 4)
    want, taken = one_pass(links, set(foes))
    table = spark.createDataFrame(links + links[:50] + [(5, 5, 0.99)], "left_id long, right_id long, score double")
    enemies = spark.createDataFrame(foes + [(f[1], f[0]) for f in foes[:30]], "left_id long, right_id long")
    assert {r.node: r.component for r in constrained_components(table, enemies, held).collect()} == want
    assert sorted(map(tuple, merge_forest(table, enemies, held).collect())) == sorted(taken)


def test_hot_clique_and_chain_by_joins_alone(spark):
    """Persons whose mentions all share one telephone, and a chain of equal scores with foes along it."""
    links = [(a, b, 0.95 if a % 8 == b % 8 else 0.9) for a in range(24) for b in range(a + 1, 24)]
    foes = [(a, b) for a in range(24) for b in range(a + 1, 24) if a % 8 != b % 8 and a % 8 < 6 and b % 8 < 6 and a < 20]
    links += [(1000 + k, 1001 + k, 0.9) for k in range(30)]
    foes += [(1000 + k, 1007 + k) for k in range(0, 20, 5)]
    links = [l for l in links if (l[0], l[1]) not in set(foes)]
    want, _ = one_pass(links, set(foes))
    table = spark.createDataFrame(links, "left_id long, right_id long, score double")
    enemies = spark.createDataFrame(foes, "left_id long, right_id long")
    assert {r.node: r.component for r in constrained_components(table, enemies, 30).collect()} == want


def test_text_ids_and_empty_tables(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), (None, "d", 0.9)], "left_id string, right_id string, score double")
    foes = spark.createDataFrame([("c", "a")], "left_id string, right_id string")
    assert sorted(map(tuple, constrained_components(links, foes).collect())) == [("a", "a"), ("b", "b"), ("c", "b")]
    assert constrained_components(links.limit(0), foes).isEmpty() and merge_forest(links.limit(0), foes).isEmpty()
    assert sorted(map(tuple, constrained_components(links, foes.limit(0)).select(F.col("node"), "component").collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
