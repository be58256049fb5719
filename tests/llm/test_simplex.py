"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from mountwait.llm import simplex

DIM = 64


def brute(rows, clusters=8, rounds=10):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == DIM
            and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [simplex.whole(x) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, k) in zip(kept, near) if k == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign()
    sums = [sum(d for d, k in near if k == j) for j in range(len(cents))]
    fit = lambda x: x if x <= simplex.LONG_MAX else None
    return sorted((str(i), k, str(fit(d)), str(fit(sums[k])), str(fit(sum(sums))),
                   hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest())
                  for (i, _), (d, k) in zip(kept, near))


def result(df):
    return sorted((str(r.vec_id), r.cluster, str(r.distance), str(r.cluster_inertia), str(r.inertia), r.centroid_sha256)
                  for r in df.collect())


@pytest.fixture()
def table(llm):
    def make(rows):
        return llm.createDataFrame([(i, v, 1, 2) for i, v in rows],
                                   "vec_id long, embedding array<double>, cluster int, x int").repartition(3)
    return make


def sample(n, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(5, DIM))
    return [(i, [float(x) for x in scale * (mids[i % 5] + 0.3 * rng.normal(size=DIM))]) for i in range(n)]


def test_equals_integer_brute_force(table):
    rows = sample(300)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 63), (1003, [None] + [0.0] * 63), (1004, [float("nan")] * 64),
             (1005, [float("inf")] * 64), (None, rows[0][1]), (7, rows[7][1]), (7, rows[8][1])]
    rows += [(2000 + i, rows[3][1]) for i in range(100)]
    assert result(simplex.cluster(table(rows))) == brute(rows)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_few_and_equal_vectors(table, n):
    rows = [(i, [0.25] * 64) for i in range(n)]
    assert result(simplex.cluster(table(rows))) == brute(rows)
    assert result(simplex.cluster(table(rows + sample(4)))) == brute(rows + sample(4))


def test_empty_table(table):
    assert simplex.cluster(table([(1, None)])).collect() == []


@pytest.mark.parametrize("scale", [1e5, 1e9, 1e18])
def test_large_components(table, scale):
    rows = sample(40) + [(100 + i, v) for i, v in sample(12, 2, scale)]
    assert result(simplex.cluster(table(rows))) == brute(rows)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(4)
    pts = [[int(x) for x in p] for p in rng.integers(-500, 500, (40, DIM))]
    pts += [pts[0], [(a + b) // 2 for a, b in zip(pts[1], pts[2])]]
    base = simplex.Simplex(pts[:10] + [pts[0]])
    assert len(base.pivots) == 10  # a repeated pivot adds nothing
    apex = base.of(pts)
    for i in range(len(pts)):
        flat = ((apex[i, :-1] - apex[:, :-1]) ** 2).sum(axis=1)
        true = np.array([simplex.square(pts[i], q) for q in pts], float)
        eps = 1e-6 * (1 + true)
        assert (flat + (apex[i, -1] - apex[:, -1]) ** 2 <= true + eps).all()
        assert (flat + (apex[i, -1] + apex[:, -1]) ** 2 >= true - eps).all()
    # near two far groups the other group's centroid is filtered out
    a, b = [0] * DIM, [10_000] * DIM
    base = simplex.Simplex([a, b])
    may = simplex.candidates(base.of([[3] * DIM, [9_990] * DIM]), base.of([a, b]), base.reach)
    assert may.tolist() == [[True, False], [False, True]]


def test_real_vectors(llm):
    import pyarrow.parquet as pq
    path = "/root/testdata/sf0.001/embeddings.parquet"
    t = pq.read_table(path, columns=["vec_id", "embedding"])
    rows = list(zip(*(c.to_pylist() for c in t.columns)))
    assert result(simplex.cluster(llm.read.parquet(path))) == brute(rows)
