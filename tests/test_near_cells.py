"""Short segments are placed by arithmetic alone; longer ones beside them still meet all their partners."""

import random

from pyspark.sql import functions as F

from capsieve.operators import align
from capsieve.operators.intervals import NEAR, overlaps

SCHEMA = "run_id string, sample_id long, seg_index long, start_ms long, end_ms long, text string"
WIDTH = 10


def made(seed, n, lengths):
    rng = random.Random(seed)
    starts = [rng.randint(-300, 300) for _ in range(n)]
    return [("r", rng.randrange(3), i, at, at + rng.choice(lengths), f"w{i % 7}") for i, at in enumerate(starts)]


def found(pairs):
    return sorted(map(tuple, pairs.collect()))


def test_short_segments_need_no_levels(spark):
    p, s = (spark.createDataFrame(made(seed, 60, range(1, 30)), SCHEMA) for seed in (1, 2))
    plan = overlaps(s, p, align.KEYS, width=WIDTH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1  # the pairs; no levels are joined to the segments
    assert found(align.overlap_pairs(p, s, width=WIDTH)) == found(align.overlap_pairs_plain(p, s))


def test_lengths_around_the_border(spark):
    """Beside short ones, lengths of about as many cells as are placed by arithmetic, on one side, the other, or both."""
    edge = [(NEAR + d) * WIDTH + e for d in (-1, 0, 1) for e in (-1, 0, 1)]
    short, mixed = range(1, 15), [0, -3, 1, 7, *edge, 5_000]
    for one, two in ((short, mixed), (mixed, short), (mixed, mixed)):
        p, s = spark.createDataFrame(made(3, 70, one), SCHEMA), spark.createDataFrame(made(4, 70, two), SCHEMA)
        want = found(align.overlap_pairs_plain(p.where("end_ms > start_ms"), s.where("end_ms > start_ms")))
        assert want and found(align.overlap_pairs(p, s, width=WIDTH)) == want


def test_segments_are_dealt_once_by_number(spark):
    """The fold deals rows by one number and builds its lists behind the shuffle only."""
    p, s = (spark.createDataFrame(made(seed, 60, range(1, 30)), SCHEMA) for seed in (1, 2))
    rows = align.matched_text(p, s, width=WIDTH)
    assert "segment_no" in rows._jdf.queryExecution().executedPlan().toString()
    partners = {(k, i): [x for x in ix] for k, i, ix in rows.select("sample_id", "secondary_index", "primary_indexes").collect()}
    want = {(r[1], r[2]): [] for r in made(2, 60, range(1, 30))}
    for _, k, i, j, _ in align.overlap_pairs_plain(p, s).orderBy(F.col("primary_index")).collect():
        want[k, i].append(j)
    assert partners == want
