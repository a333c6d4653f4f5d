"""Run tables: joins without a shuffle, merges that touch only the buckets of their rows."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from capsieve.operators import quality, runs
from capsieve.session import shared_dir
from capsieve.sources import run_tables

ROW = "run_id string, sample_id long, passed boolean, warning_count long"


def rows(spark, values):
    return spark.createDataFrame([(f"run{i % 3}", i, w % 2 == 0, w) for i, w in values], ROW)


def held(df):
    return sorted(map(tuple, df.select("run_id", "sample_id", "passed", "warning_count").collect()))


def stored_files(spark, name):
    return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/{name}/*.parquet"))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merge_equals_plain_merge(spark):
    old, new = rows(spark, [(i, i) for i in range(40)]), rows(spark, [(3, 100), (50, 101), (7, 102), (7, 104)])
    name = run_tables.create(old, buckets=8)
    run_tables.merge(new, name)
    want = runs.merge_stage(old, new)
    assert held(run_tables.read(spark, name)) == held(want)
    run_tables.merge(rows(spark, [(3, 200)]), name)
    assert [r for r in held(run_tables.read(spark, name)) if r[1] == 3] == [("run0", 3, True, 200)]
    whole = run_tables.compact(spark, name)
    assert held(run_tables.read(spark, whole)) == held(run_tables.read(spark, name))
    assert spark.table(whole).count() == 42 < spark.table(name).count()
    run_tables.drop(spark, name)
    assert not spark.catalog.tableExists(name) and not stored_files(spark, name)


def test_merge_touches_only_its_bucket(spark):
    name = run_tables.create(rows(spark, [(i, i) for i in range(200)]), buckets=8)
    before = {f: os.path.getmtime(f) for f in stored_files(spark, name)}
    run_tables.merge(rows(spark, [(5, 1000)]), name)
    after = stored_files(spark, name)
    (fresh,) = after - set(before)
    assert set(before) <= after and all(os.path.getmtime(f) == t for f, t in before.items())
    assert spark.read.parquet(f"file://{fresh}").count() == 1


def test_gate_joins_have_no_exchange(spark, no_broadcast):
    base = rows(spark, [(i, i) for i in range(100)])
    keyed = base.select("run_id", "sample_id")
    parts = [
        base.select("run_id", "sample_id", F.lit(60.0).alias("duration_seconds")),
        keyed.withColumns({c: F.col("sample_id") for c in ("primary_segments", "secondary_segments", "primary_chars", "secondary_chars", "caption_count", "median_text_chars")}),
        keyed.withColumn("longest_duplicate_run", F.lit(1)),
        keyed.withColumns({"checked_segments": F.lit(1), "avg_logprob_mean": F.lit(-0.1), "avg_logprob_min": F.lit(-0.1), "no_speech_prob_max": F.lit(0.1)}),
        keyed.withColumn("high_risk_count", F.lit(0)),
    ]
    names = [run_tables.create(p, buckets=8) for p in parts]
    run_tables.merge(parts[3].filter("sample_id < 9"), names[3])
    first, *others = (run_tables.read(spark, n) for n in names)
    staged = quality.judge(first, others)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Exchange" not in plan
    plain = quality.judge(parts[0], parts[1:])
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    pick = lambda df: sorted(map(str, df.select("run_id", "sample_id", "passed", "errors", "warnings").collect()))
    assert pick(staged) == pick(plain)


def test_columns_and_empty_tables(spark):
    name = run_tables.create(rows(spark, []), buckets=4)
    assert run_tables.read(spark, name).isEmpty()
    run_tables.merge(rows(spark, []), name)
    run_tables.merge(rows(spark, [(1, 2)]).drop("passed"), name)
    assert held(run_tables.read(spark, name)) == [("run1", 1, None, 2)]
    for extra in ("other", run_tables.VERSION):
        with pytest.raises(ValueError, match="no such columns"):
            run_tables.merge(rows(spark, [(1, 2)]).withColumn(extra, F.lit(1)), name)
