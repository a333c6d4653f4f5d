"""The text of an alignment row is split into tokens once, whatever is asked of the tokens."""

from pyspark.sql import functions as F

from capsieve.operators import align


def test_tokens_are_split_once(spark):
    side = spark.range(40).select(
        F.lit("r").alias("run_id"), (F.col("id") % 4).alias("sample_id"), F.col("id").alias("seg_index"),
        (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 90).alias("end_ms"), F.concat(F.lit("Ab "), (F.col("id") % 3).cast("string")).alias("text"),
    )
    other = side.withColumn("text", F.when(F.col("seg_index") % 5 == 0, F.lit("ab 9 é")).otherwise(F.col("text")))
    rows = align.align(side, other, with_ratio=False).filter("high_risk")
    plan = rows.select("seg_index" if "seg_index" in rows.columns else "secondary_index", F.size("token_mismatch"), "token_mismatch")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
    got = {r.secondary_index: r.token_mismatch for r in rows.collect()}
    assert got == {i: sorted({str(i % 3), "9"}) for i in range(0, 40, 5)}
