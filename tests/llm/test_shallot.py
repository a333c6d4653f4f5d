import hashlib

import numpy as np
import pytest
from pyspark.sql import Row

from capsieve.llm import shallot


def brute(rows, k, rounds, size):
    """Plain rounds over Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(256 * float(x))) for x in v]))
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else w for j, w in enumerate(c)]
    last = [(i, *near(v)) for i, v in kept]
    sums = {}
    for _, d, j in last:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(repr((i, j, d, sums[j], sum(sums.values()), digest[j])) for i, d, j in last)


def table(spark, rows):
    return spark.createDataFrame([Row(i, v, "x", 3) for i, v in rows], "vec_id long, vector array<float>, cluster string, distance int")


def made(n, size, seed, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(7, size)) * spread
    return [(i, [float(np.float32(x)) for x in middles[i % 7] + rng.normal(size=size) * 0.3]) for i in range(n)]


@pytest.mark.parametrize(("n", "size", "k", "spread"), [(400, 8, 12, 1.0), (300, 3, 25, 0.1), (150, 2, 40, 0.02), (30, 4, 40, 1.0), (60, 5, 1, 1.0), (60, 5, 2, 1.0)])
def test_brute_force(spark, n, size, k, spread):
    rows = made(n, size, n, spread)
    rows += [(1_000 + i, [0.5] * size) for i in range(n // 2)] + [(2_000, [0.5] * size)] * 20  # ties and repeated rows
    rows += [(3_000, None), (3_001, [0.1] * (size + 1)), (3_002, []), (3_003, [None] * size), (3_004, [float("nan")] * size), (3_005, [float("inf")] + [0.0] * (size - 1)), (None, [0.25] * size)]
    got = shallot.cluster(table(spark, rows), k=k, size=size)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, k, 5, size)


def test_bounds_skip_work():
    """The search gives what comparing all gives, from any state whose bounds hold."""
    rng = np.random.default_rng(3)
    x, c = rng.integers(-500, 500, (2_000, 6)), rng.integers(-500, 500, (30, 6))
    state, before = None, None
    for _ in range(6):
        search = shallot.Search(c, before)
        out = search.assign(x, *(search.fresh(len(x)) if state is None else state))
        d = np.array([shallot.distances(x, w[None]) for w in c])
        assert (out[0] == d.argmin(axis=0)).all() and (out[4] == d.min(axis=0)).all()
        assert (out[2] ** 2 >= out[4]).all()
        others = np.where(np.arange(len(c))[:, None] == out[0], np.inf, d)
        assert (out[3] ** 2 <= others.min(axis=0)).all()
        state, before = out[:4], c
        c = np.array([x[out[0] == j].sum(axis=0) // max(1, (out[0] == j).sum()) if (out[0] == j).any() else c[j] for j in range(len(c))])


def test_empty(spark):
    rows = table(spark, made(5, 4, 0, 1.0))
    assert shallot.cluster(rows.limit(0), size=4).collect() == []
    assert shallot.cluster(rows, size=9).collect() == []
    assert shallot.cluster(rows.selectExpr("CAST(NULL AS LONG) AS vec_id", "vector"), size=4).collect() == []
