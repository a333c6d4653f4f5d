"""Results don't hang on the plans that adaptive execution picks."""

import hashlib

from pyspark.sql import functions as F

from capsieve.operators import captions


def test_digests_when_a_join_below_changes_its_plan(spark):
    """A join planned by sorting deals rows by sample; run as a broadcast it leaves them where they were."""
    part = F.concat(F.lit("s"), (F.col("id") % 50).cast("string"), F.lit("p"), F.floor(F.col("id") / 50).cast("string"), F.sha2(F.col("id").cast("string"), 512))
    rows = spark.range(50 * 40).select(
        (F.col("id") % 3).cast("string").alias("run_id"), (F.col("id") % 50).alias("sample_id"), F.floor(F.col("id") / 50).alias("part_no"),
        F.encode(part, "UTF-8").alias("caption"),
    )
    few = spark.range(50).select(F.col("id").alias("sample_id"), F.lit(1).alias("x")).groupBy("sample_id").agg(F.max("x").alias("x"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "20KB")  # the smaller side only
    try:
        spread = rows.repartition(4, "part_no")
        found = captions.caption_digests(spread.join(few, "sample_id").drop("x"), keys=("sample_id",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for k, v in kept.items():
            spark.conf.set(k, v)
    whole = {}
    for r in rows.orderBy("sample_id", "part_no").collect():
        whole.setdefault(r.sample_id, []).append(bytes(r.caption))
    assert sorted((r.sample_id, r.part_count, r.caption_size, r.caption_sha256) for r in found) == sorted(
        (s, len(p), len(b"".join(p)), hashlib.sha256(b"".join(p)).hexdigest()) for s, p in whole.items()
    )


def test_digests_ask_for_order_themselves(spark):
    """No repartition that the planner may take out stands between the parts and the running hash."""
    parts = spark.createDataFrame([("r", 1, 0, b"a")], "run_id string, sample_id long, part_no long, caption binary")
    plan = captions.caption_digests(parts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "REPARTITION_BY_COL" not in plan
