"""The dyadic interval join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from capsieve.operators import align
from capsieve.operators.intervals import cover, overlaps

FAR = 10**15


def made(seed, n, samples, far):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.randint(-50_000, 100_000), rng.randint(0, 3_000), rng.randint(-FAR, FAR) if far else 0])
        length = rng.choice([0, -5, 1, 2, rng.randint(1, 9_000), rng.randint(1, 10**6), rng.randint(1, FAR) if far else 7])
        rows.append((rng.randrange(samples), i, start, start + length))
    return rows


@pytest.mark.parametrize("width", [1, 3, 4096, 5_000, 10**7])
@pytest.mark.parametrize("far", [False, True])
def test_all_pairs(spark, width, far):
    left, right = made(1, 120, 3, far), made(2, 110, 4, far)
    if width == 1 and not far:
        left += [(0, 500, 0, 1), (0, 501, 2**62, 2**62 + 1)]
    schema = "k long, i long, start_ms long, end_ms long"
    got = overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], width=width)
    found = [(r["l"]["i"], r["r"]["i"]) for r in got.collect()]
    expected = [(a[1], b[1]) for a in left for b in right if a[0] == b[0] and min(a[3], b[3]) > max(a[2], b[2])]
    assert sorted(found) == sorted(expected)


def test_cover_is_small(spark):
    rows = made(3, 400, 1, True)
    df = spark.createDataFrame([(r[2], r[3]) for r in rows], "start long, end long").where("`end` > start")
    for start, end, cells in df.withColumn("cells", cover(100, "start", "`end`")).collect():
        low, high = start // 100, (end - 1) // 100 + 1
        spans = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in cells)
        assert spans[0][0] == low and spans[-1][1] == high
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 2 * max(1, (high - low).bit_length())


def test_nulls_and_keys(spark):
    schema = "a string, b long, start_ms long, end_ms long, note string"
    rows = [("x", 1, 0, 10, "p"), ("x", None, 0, 10, "q"), (None, 1, 0, 10, "r"), ("x", 1, None, 10, "s"), ("x", 1, 0, None, "t"), ("x", 2, 0, 10, None)]
    df = spark.createDataFrame(rows, schema)
    got = overlaps(df, df.withColumnRenamed("note", "level"), ["a", "b"]).collect()
    assert sorted((r["l"]["note"] or "", r["r"]["level"] or "") for r in got) == [("", ""), ("p", "p")]
    assert overlaps(df.limit(0), df, ["a", "b"]).collect() == []


def test_one_segment_of_great_length(spark):
    schema = "run_id string, sample_id string, seg_index long, start_ms long, end_ms long, text string"
    short = [("r", "s", i, i * 1000, i * 1000 + 900, f"w{i}") for i in range(300)]
    long = [("r", "s", 0, -FAR, FAR, "all")]
    p, s = spark.createDataFrame(short, schema), spark.createDataFrame(long, schema)
    row = align.matched_text(p, s).first()
    assert row["primary_indexes"] == list(range(300)) and align.unmatched_primary(p, s).count() == 0
    assert align.align(s, p, with_ratio=False).count() == 300


def test_pairs_are_joined_once(spark):
    schema = "run_id string, sample_id string, seg_index long, start_ms long, end_ms long, text string"
    p, s = (spark.createDataFrame([("r", "s", 1, 0, 5, "x")], schema).select("*") for _ in range(2))
    plan = align.align(p, s, with_ratio=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("r_level") and plan.count("Join Inner") <= 3  # the pairs, and each side's levels


def test_rows_without_index_or_times_stay(spark):
    schema = "run_id string, sample_id string, seg_index long, start_ms long, end_ms long, text string"
    p = spark.createDataFrame([("r", "s", None, 0, 10, "a"), ("r", "s", None, 5, 10, "b"), ("r", "s", 7, None, 10, "c"), ("r", "s", 8, 100, 110, "d")], schema)
    s = spark.createDataFrame([("r", "s", None, 0, 10, "x"), ("r", "s", None, 90, 95, "y"), ("r", "s", 3, None, None, "z")], schema)
    rows = align.align(p, s, with_ratio=False).orderBy(F.col("decision"), "secondary_text", "primary_text").collect()
    assert [(r["primary_text"], r["secondary_text"], r["high_risk"]) for r in rows] == [("c", "", True), ("d", "", True), ("ab", "x", True), ("", "y", True), ("", "z", True)]
