"""Hard negatives against all scores, and what the bounds skip."""

import math
import random

import numpy as np
import pytest

from veritab.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score string, q string, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "q", 0) for r in rows], SCHEMA)


def plainly(rows, every=100):
    taken = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        taken.setdefault(i, []).append((label, v))
    taken = {i: of[0] for i, of in taken.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in taken.items():
        if a % every:
            continue
        scores = sorted((-dot(v, w), i, other == label) for i, (other, w) in taken.items() if i != a)
        for p, i, _ in [s for s in scores if s[2]][: H.POSITIVES]:
            fit = [(n, j) for n, j, same in scores if not same and -30 * p <= -100 * n <= -90 * p][: H.NEGATIVES]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def found_of(df, every=100):
    return sorted(tuple(r) for r in H.hard_negatives(df, every).collect())


def random_rows(seed, n, width=8, labels=10, spread=1.0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(6, width)) * spread
    x = centers[draw.integers(0, 6, n)] + draw.normal(size=(n, width)) * 0.3
    return [(k, int(draw.integers(0, labels)), [float(v) for v in x[k]]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_like_all_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(H, "FIRST", 2)
    monkeypatch.setattr(H, "GROWTH", 2)
    monkeypatch.setattr(H, "LIST", 50)
    rows = random_rows(int(spread), 600, spread=spread)
    assert found_of(table(spark, rows), 20) == plainly(rows, 20)


def test_odd_rows(spark):
    rows = random_rows(7, 200)
    rows += [(300, None, [1.0] * 8), (400, 1, None), (500, 2, [1.0, None]), (600, 2, [math.nan] * 8), (700, 3, [math.inf] * 8), (None, 1, [1.0] * 8)]
    rows += [(800, 4, []), (900, 4, [0.5, 0.5]), (1001, 4, [0.5] * 8), rows[100], rows[5]]
    rows += [(2000 + k, k % 3, rows[100][2]) for k in range(40)]  # ties with an anchor
    assert found_of(table(spark, rows)) == plainly(rows)
    assert H.hard_negatives(table(spark, rows).where("false")).collect() == []
    assert H.hard_negatives(table(spark, rows).where("vec_id % 100 <> 0")).collect() == []


def test_large_components_are_exact(spark):
    draw = random.Random(1)
    rows = [(k, k % 2, [draw.choice([-1, 1]) * 65535.99 + draw.random() for _ in range(8)]) for k in range(0, 400, 5)]
    assert found_of(table(spark, rows)) == plainly([r for r in rows if all(abs(math.floor(256 * float(np.float32(c)))) <= H.LARGEST for c in r[2])])
    a = np.array([[H.LARGEST] * 1024])
    assert H.products(a, a)[0, 0] == 1024 * H.LARGEST**2


def test_bounds_hold_and_skip(spark, monkeypatch):
    monkeypatch.setattr(H, "LIST", 40)
    rows = random_rows(3, 900, spread=3.0)
    whole, width = H.whole_vectors(table(spark, rows))
    index = H.indexed(whole, whole.count(), width)
    lists = index.lists.collect()
    assert sum(len(r["ids"]) // 8 for r in lists) == 900 and len(lists) == index.parts.sum()
    x = np.floor(256 * np.array([np.float32(r[2]) for r in rows], np.float64))
    lower, upper = index.bounds(x[:50])
    for r in lists:
        scores = x[:50] @ np.frombuffer(r["vectors"], "<i4").reshape(-1, width).T
        assert (scores <= upper[:, [r["cluster"]]]).all() and (scores >= lower[:, [r["cluster"]]]).all()
    queries = whole.where("vec_id % 100 = 0").selectExpr("vec_id as q", "label", "v", "array(cast(null as bigint)) as goals", "array(cast(null as bigint)) as kth")
    everything = H.visits(index, queries, 0, 99, width).count()
    known = queries.drop("kth").selectExpr("*", f"array({int(np.percentile(x @ x.T, 99.9))}L) as kth")
    assert H.visits(index, known, 0, 99, width).count() < everything
