from pyspark.sql import functions as F

from capsieve.operators.progress import last_events, progress
from capsieve.plans import fixtures as fx
from capsieve.sources.eventlog import events
from capsieve.streaming import progress as live


def inputs(spark, sf, tmp_path):
    lines = fx.event_lines(spark, sf).select(F.col("run_id").cast("string").alias("run_id"), "line_no", "value")
    folder = str(tmp_path / "log")
    lines.repartition(6).write.parquet(folder)
    return lines, live.route(live.read_lines(spark, folder, max_files=2))


def test_progress_stream_equals_batch(spark, sf, tmp_path):
    lines, stream = inputs(spark, sf, tmp_path)
    totals = fx.progress_totals(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    table = str(tmp_path / "steps")
    writer = live.store_steps(live.progress_steps(stream), table).option("checkpointLocation", str(tmp_path / "state"))
    running = writer.start()
    running.processAllAvailable()
    running.stop()
    steps = spark.read.parquet(table)
    want = sorted(map(tuple, progress(events(lines), totals).collect()))
    assert sorted(map(tuple, live.fold_steps(steps, totals).collect())) == want
    counted = live.newest(live.drain(live.run_progress(stream), str(tmp_path / "counted"), "update"))
    assert {r.run_id: r.steps for r in counted.collect()} == {r[0]: r[2] for r in want if r[2]}


def test_status_and_failures_equal_batch(spark, sf, tmp_path):
    lines, stream = inputs(spark, sf, tmp_path)
    status = live.newest(live.drain(live.latest_status(stream), str(tmp_path / "status"), "update"))
    assert sorted(map(str, status.collect())) == sorted(map(str, last_events(events(lines)).collect()))
    failed = live.drain(live.failed_candidates(stream), str(tmp_path / "failed"))
    batch = events(lines).filter("event = 'candidate_failed'").select("run_id", "sample_id").distinct()
    assert sorted(map(tuple, failed.select("run_id", "sample_id").collect())) == sorted(map(tuple, batch.collect()))
