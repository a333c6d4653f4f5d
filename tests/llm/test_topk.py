import random

import pytest
from pyspark.sql import functions as F

from capsieve.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, query_id int"


def brute(rows, asked, k):
    out = []
    for qid, q in sorted(set(asked)):
        found = sorted({(-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q)})
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def made(seed, n, dim, spread):
    pick = random.Random(seed)
    rows = [(i, [pick.randint(-spread, spread) / 16 for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [rows[3], (3, rows[5][1])]
    return rows


@pytest.mark.parametrize("dim,spread,k", [(8, 20, 5), (3, 1, 4), (2, 1000, 1), (0, 1, 3)])
def test_brute_force(spark, dim, spread, k):
    rows = made(dim + k, 150, dim, spread)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    got = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), k).collect()
    whole = {(i, tuple(int(256 * x // 1) for x in v)) for i, v in rows}
    assert sorted(map(tuple, got)) == brute(whole, {r for r in whole if r[0] % 10 == 0}, k)


def test_bad_rows_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (50, []), (100, [1.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    vectors = df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    assert [tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()] == [(0, 1, 5, 768 * 128)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pairs_do_not_grow_with_the_blocks(spark):
    pick = random.Random(9)
    rows = [(i, tuple(pick.randint(-4000, 4000) for _ in range(12))) for i in range(1500)]
    vectors = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, vector array<bigint>")
    asked = vectors.where("vec_id % 50 = 0")
    few, many = (topk.bounds(vectors, asked, 5, rows=n).count() for n in (2048, 25))
    assert 30 * 5 <= many <= few < 30 * 25
    pairs = {tuple(r) for r in topk.bounds(vectors, asked, 5, rows=25).select("query_id", "vec_id").collect()}
    assert {(q, i) for q, _, i, _ in brute(rows, [r for r in rows if r[0] % 50 == 0], 5)} <= pairs


def test_held_bounds_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD_BLOCKS", 1)
    test_brute_force(spark, 8, 20, 5)


def test_queries_are_never_broadcast(spark, monkeypatch):
    """Copied for each slot, the queries of a large table are far more than the planner sees."""
    rows = made(4, 150, 8, 20)
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    vectors = topk.materialize(df.select("vec_id", topk.quantised(F.col("embedding")).alias("vector")))
    plan = topk.bounds(vectors, vectors.where("vec_id % 10 = 0"), 5)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Broadcast" in line and "slot" in line]
    test_brute_force(spark, 8, 20, 5)
    monkeypatch.setattr(topk, "TASK_PAIRS", 400)
    monkeypatch.setattr(topk, "HELD_QUERIES", 500)
    test_brute_force(spark, 8, 20, 5)
    test_brute_force(spark, 2, 1000, 1)


def test_copies_follow_the_pairs_not_the_partitions():
    """On 615,384 vectors of 64 components with 12,312 queries."""
    n, m = 615_384, 12_312
    sizes = {topk.grid(n * m, 72 * n, 144 * m, parts) for parts in (100, 600, 3000)}
    ((slots, groups),) = sizes
    assert slots * groups >= n * m / topk.TASK_PAIRS and slots * 144 * m + groups * 72 * n < 256 * n
    assert topk.grid(0, 0, 0, 600) == (32, 1) and topk.grid(1 << 40, 1 << 30, 1 << 30, 8)[1] >= 64
