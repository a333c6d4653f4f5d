"""Segments are folded in blocks of time with one shuffle; the index, and pairs by brute force, give the same."""

import random

import pytest
from pyspark.sql import functions as F

from capsieve.operators import align
from capsieve.operators.intervals import NEAR

SCHEMA = "run_id string, sample_id long, seg_index long, start_ms long, end_ms long, text string"
WIDTH = 3
SPAN = WIDTH * align.BLOCK


def made(seed, n, lengths, samples=3):
    """Starts near the borders of blocks and anywhere, negative ones too; some without times, index, text or sample."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        at = rng.choice((rng.randint(-300, 300), rng.randint(-4, 4) * SPAN + rng.randint(-NEAR * WIDTH - 1, NEAR * WIDTH + 1)))
        row = ["r", rng.randrange(samples), i, at, at + rng.choice(lengths), f"w{i % 7}"]
        if rng.random() < 0.1:
            row[rng.randrange(6)] = None
        rows.append(tuple(row))
    return rows


def brute(primary, secondary):
    meet = lambda a, b: None not in (*a[:2], *b[:2], *a[3:5], *b[3:5]) and a[:2] == b[:2] and max(a[3], b[3]) < min(a[4], b[4])
    key = lambda h: ((h[0] is not None, h[0] or 0), (h[1] is not None, h[1] or ""))
    out = [("s", *s, tuple(sorted(((p[2], p[5]) for p in primary if meet(p, s)), key=key))) for s in set(secondary)]
    out += [("p", *p, ()) for p in set(primary) if not any(meet(p, s) for s in secondary)]
    return sorted(out, key=repr)


def found(folded):
    rows = folded.select("side", *align.KEYS, *align.SEGMENT, "hits").collect()
    return sorted(((*r[:7], tuple(map(tuple, r.hits or ()))) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_brute_force(spark, seed):
    p, s = made(seed, 150, range(-1, (NEAR - 1) * WIDTH)), made(seed + 10, 150, range(-1, (NEAR - 1) * WIDTH))
    p, s = p + p[:5], s + s[:5]  # equal rows of a side: one row; both primary ones are partners
    one, two = (spark.createDataFrame(x, SCHEMA) for x in (p, s))
    assert found(align._folded_in_blocks(one, two, align.KEYS, WIDTH)) == brute(p, s)
    assert found(align._folded(one, two, align.KEYS, WIDTH)) == found(align._folded_by_index(one, two, align.KEYS, WIDTH)) == brute(p, s)


def test_long_and_crowded_samples_go_by_index(spark, monkeypatch):
    monkeypatch.setattr(align, "CROWD", 12)
    p = made(3, 90, range(1, NEAR * WIDTH), 6) + [("r", 1, 900, -500, 10**15, "long")]
    s = made(4, 90, range(1, NEAR * WIDTH), 6) + [("r", 2, 901 + i, 5 + i % 4, 9, "x") for i in range(20)]
    one, two = (spark.createDataFrame(x, SCHEMA) for x in (p, s))
    odd = {r.sample_id for r in align._kinds(one, two, align.KEYS, WIDTH).collect()}
    assert {1, 2} <= odd < set(range(6))
    assert found(align._folded(one, two, align.KEYS, WIDTH)) == brute(p, s)


def test_one_shuffle(spark):
    """A fold of short segments has no join and deals its rows once."""
    one, two = (spark.createDataFrame(made(i, 60, range(1, NEAR * WIDTH)), SCHEMA).where("end_ms < start_ms + 9") for i in (5, 6))
    plan = align.matched_text(one, two, width=WIDTH)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and plan.count("RepartitionByExpression") == 1
    assert align.align(one, two, width=WIDTH, with_ratio=False).filter(F.col("secondary_index").isNotNull()).count() > 0
