import itertools
import random

import pytest

from sievemark.operators import calibrate
from test_constrained import one_pass

SCORED = "left_id long, right_id long, score double, hard_reason string"


def made(rng, n):
    rows = []
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < 0.15:
            foe = rng.random() < 0.2
            rows.append((a, b, 0.0 if foe else rng.choice([0.37, 0.42, 0.48, 0.6, 0.75, 0.78, 0.8, 0.85, 0.88, 0.9, 0.97]), "hard_conflict" if foe else rng.choice([None, None, None, "name_only_cap"])))
    return rows


def test_sweep_equals_clustering_anew(spark):
    rng = random.Random(4)
    for held in (100,):
        n = 40
        rows = made(rng, n)
        truth = {m: rng.choice([None, *range(9)]) for m in range(n)}
        scripted, nicks = [(0, 1), (2, 5), (7, 8), (3, 99)], [1, 4]
        tables = [spark.createDataFrame(rows, SCORED), spark.createDataFrame(list(truth.items()), "mention_id long, uid long")]
        sweep, gray = calibrate.threshold_sweep(*tables, spark.createDataFrame(scripted, "uid_a long, uid_b long"), spark.createDataFrame([(u,) for u in nicks], "uid long"), held=held)
        got, grays = {r.auto: r for r in sweep.collect()}, {(r.auto, r.distinct): r for r in gray.collect()}
        foes = {(a, b) for a, b, _, h in rows if h == "hard_conflict"}
        real = {p for p in itertools.combinations(range(n), 2) if truth[p[0]] is not None and truth[p[0]] == truth[p[1]]}
        clusters = {(r.auto, r.mention_id): r.cluster_id for r in calibrate.clusters_by_threshold(tables[1], tables[0], held=held).collect()}
        for auto in calibrate.AUTOS:
            of, _ = one_pass([(a, b, s) for a, b, s, h in rows if s >= auto and h is None], foes)
            of = {m: of.get(m, m) for m in range(n)}
            assert all(clusters[auto, m] == of[m] for m in range(n))
            linked = {p for p in itertools.combinations(range(n), 2) if of[p[0]] == of[p[1]]}
            r = got[auto]
            assert (r.linked, r.right, r.real) == (len(linked), len(linked & real), len(real))
            p, q = (len(linked & real) / len(linked) if linked else 1.0), len(linked & real) / len(real)
            assert (r.precision, r.recall, r.f1) == pytest.approx((p, q, 2 * p * q / (p + q) if p + q else 0.0), abs=6e-5)
            assert r.leaks == sum(any(truth[x] == a and truth[y] == b and of[x] == of[y] for x in range(n) for y in range(n)) for a, b in scripted)
            own = {p for p in real if truth[p[0]] in nicks}
            assert r.nickname_recall == pytest.approx(len(linked & own) / len(own) if own else 1.0, abs=6e-5)
            for distinct in calibrate.DISTINCTS:
                queue = {(a, b) for a, b, s, _ in rows if distinct < s < auto and of[a] != of[b]}
                g = grays[auto, distinct]
                assert (g.gray, g.true_gray, g.lost) == (len(queue), len(queue & real), len(real - linked - queue))
                assert g.ceiling == pytest.approx((len(linked & real) + len(queue & real)) / len(real), abs=6e-5)
        best = max((a for a in calibrate.AUTOS if not got[a].leaks), key=lambda a: (got[a].f1, a == 0.85, a), default=None)
        found = calibrate.recommended(sweep, gray).collect()
        assert [r.auto for r in found] == ([] if best is None else [best])
        for r in found:
            lossless = [d for d in calibrate.DISTINCTS if grays[best, d].lost == grays[best, 0.35].lost]
            assert r.distinct == max(lossless, key=lambda d: (-grays[best, d].gray, d == 0.40, d))


def test_sweep_of_nothing(spark):
    sweep, gray = calibrate.threshold_sweep(spark.createDataFrame([], SCORED), spark.createDataFrame([], "mention_id long, uid long"))
    assert {(r.linked, r.real, r.precision, r.f1, r.leaks) for r in sweep.collect()} == {(0, 0, 1.0, 1.0, 0)}
    assert gray.count() == 16


def test_links_without_conflict_need_no_forest(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "merge_forest", None)
    scored = spark.createDataFrame([(0, 1, 0.9, None), (1, 2, 0.8, None), (0, 2, 0.9, None)], SCORED)
    got = calibrate.clusters_by_threshold(spark.range(4).withColumnRenamed("id", "mention_id"), scored, (0.85, 0.95)).collect()
    assert {(r.auto, r.mention_id): r.cluster_id for r in got} == {(a, k): 0 if a == 0.85 and k < 3 else k for a in (0.85, 0.95) for k in range(4)}
