"""Streaming forms of the event folds. State is one row per (run, video, engine) or per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from capsieve.operators.progress import ENGINES, derive_progress, last_events
from capsieve.sources.eventlog import events

LINES = "run_id STRING, line_no BIGINT, value STRING"


def read_lines(
    spark: SparkSession, path: str, schema: str | StructType = LINES, max_files: int | None = None, kind: str = "parquet"
) -> DataFrame:
    """Event lines that producers drop into a folder, as Parquet or JSON files of ``schema``."""
    reader = spark.readStream.schema(schema).format(kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now; its rows as a table below ``path``.

    In append mode batches are kept side by side; in update mode and complete mode each batch is a folder of its own,
    and ``batch`` tells which.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        run = writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")).start()
    run.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


def newest(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """The last row of each run among the batches of an update stream."""
    every = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy(run).agg(F.max_by(every, "batch").alias("_r")).select("_r.*")


def route(lines: DataFrame) -> DataFrame:
    """Append mode: parsed events."""
    return events(lines)


def progress_steps(parsed: DataFrame, run: str = "run_id") -> DataFrame:
    """Append mode: every (run, video, engine) step once.

    State is keyed by the step, so a busy run is spread over all state partitions.
    """
    return (
        parsed.filter("event = 'progress'")
        .select(run, "video_path", "engine")
        .dropDuplicates([run, "video_path", "engine"])
    )


def run_progress(parsed: DataFrame, run: str = "run_id") -> DataFrame:
    """Update mode: distinct steps per run, a running count over the deduplicated steps."""
    return progress_steps(parsed, run).groupBy(run).agg(F.count("*").alias("steps"))


def latest_status(parsed: DataFrame, run: str = "run_id", seq: str = "line_no") -> DataFrame:
    """Update mode: last error, run folder, progress counts and done flag per run."""
    return last_events(parsed, run, seq)


def failed_candidates(parsed: DataFrame, run: str = "run_id") -> DataFrame:
    """Append mode: the first failure of every (run, sample)."""
    return (
        parsed.filter("event = 'candidate_failed'")
        .select(run, "sample_id", "video_path", "phase", "reason")
        .dropDuplicates([run, "sample_id"])
    )


def store_steps(steps: DataFrame, path: str) -> DataStreamWriter:
    """Writer that keeps the steps as a table, one folder per batch; a repeated batch overwrites its own.

    Folders of finished runs can be compacted or dropped outside the stream, which keeps them small.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return steps.writeStream.outputMode("append").foreachBatch(save)


def fold_steps(steps: DataFrame, totals: DataFrame, run: str = "run_id", engines: Sequence[str] = ENGINES) -> DataFrame:
    """Progress rows from a table that the step stream appends to (batch side of ``foreachBatch``)."""
    per_video = steps.groupBy(run, "video_path").agg(
        F.count("*").alias("steps"),
        (F.count_if(F.col("engine").isin(*engines)) == len(engines)).alias("completed"),
    )
    folded = per_video.groupBy(run).agg(F.count_if("completed").alias("completed"), F.sum("steps").alias("steps"))
    counts = totals.join(folded, run, "left").fillna(0, ["completed", "steps"])
    return derive_progress(counts, len(engines)).select(
        run, "completed", "steps", "total", "percent", "remaining_seconds"
    )
