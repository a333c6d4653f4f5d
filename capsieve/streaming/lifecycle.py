"""Runs that end: progress and failures of streamed events, with state only for runs under way.

A run's state (its distinct steps, how many engines touched each video, the samples that failed) is kept until its
``done`` event comes. Then the run's last row is given and all of that is removed; what is left is one number, the line
of the ``done`` event, which a timer removes too. Steps and failures behind that line are late: they are reported as such
and count nowhere, whether they come in the same batch or later. Within a batch a run's events are taken in the order of
their lines; sources that keep a log's order (:mod:`capsieve.sources.growing`) give what the batch form gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from capsieve.operators.progress import ENGINES

FOLDED = (
    "run_id STRING, kind STRING, line_no BIGINT, completed BIGINT, steps BIGINT, done BOOLEAN, "
    "sample_id STRING, video_path STRING, phase STRING, reason STRING"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class RunFold(StatefulProcessor):
    """State of one run, and the rows that its events give."""

    def __init__(self, engines: Sequence[str], grace_ms: int):
        self.engines, self.grace_ms = tuple(engines), grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "video STRING, engine STRING", "line BIGINT")
        self.videos = handle.getMapState("videos", "video STRING", "engines BIGINT")
        self.failed = handle.getMapState("failed", "sample STRING", "line BIGINT")
        self.counts = handle.getValueState("counts", "completed BIGINT, steps BIGINT")
        self.closed = handle.getValueState("closed", "line BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run = key[0]
        closed = self.closed.get()[0] if self.closed.exists() else None
        completed, steps = self.counts.get() if closed is None and self.counts.exists() else (0, 0)
        last = None
        row = lambda kind, line, done=False, r=None: Row(
            run_id=run, kind=kind, line_no=line, completed=completed, steps=steps, done=done,
            sample_id=r["sample_id"] if r else None, video_path=r["video_path"] if r else None,
            phase=r["phase"] if r else None, reason=r["reason"] if r else None,
        )
        for r in sorted(rows, key=lambda r: r["line_no"]):
            event, line = r["event"], r["line_no"]
            if closed is not None:
                if event in ("progress", "candidate_failed"):
                    yield row("late", line, True, r)
            elif event == "progress":
                step = (r["video_path"], r["engine"])
                if not self.steps.containsKey(step):
                    self.steps.updateValue(step, (line,))
                    steps, last = steps + 1, line
                    if r["engine"] in self.engines:
                        seen = 1 + (self.videos.getValue(step[:1])[0] if self.videos.containsKey(step[:1]) else 0)
                        self.videos.updateValue(step[:1], (seen,))
                        completed += seen == len(self.engines)
            elif event == "candidate_failed":
                if not self.failed.containsKey((r["sample_id"],)):
                    self.failed.updateValue((r["sample_id"],), (line,))
                    yield row("failure", line, False, r)
            elif event == "done":
                closed = line
                yield row("progress", line, True)
                for state in (self.steps, self.videos, self.failed, self.counts):
                    state.clear()
                self.closed.update((line,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
        if closed is None and last is not None:
            self.counts.update((completed, steps))
            yield row("progress", last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.closed.clear()
        yield from ()

    def close(self) -> None:
        pass


def fold_runs(parsed: DataFrame, engines: Sequence[str] = ENGINES, grace_ms: int = DAY_MS) -> DataFrame:
    """Update mode: rows of three kinds from a stream of parsed events.

    ``progress``: a run's counts after a batch that changed them, and once, with ``done``, at its end. ``failure``: the
    first failure of each sample of a run. ``late``: a step or failure behind the run's end. An event that comes more
    than ``grace_ms`` after the end, when nothing of the run is left, starts it anew.
    """
    needed = parsed.where("event IN ('progress', 'candidate_failed', 'done') AND run_id IS NOT NULL").select(
        F.col("run_id").cast("string").alias("run_id"), "line_no", "event", "engine", "video_path", "sample_id", "phase", "reason"
    )
    return needed.groupBy("run_id").transformWithState(RunFold(engines, grace_ms), FOLDED, "update", "processingTime")


def with_states(spark: SparkSession) -> SparkSession:
    """Streams with timers and several states of a key need the store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def fold_batch(parsed: DataFrame, engines: Sequence[str] = ENGINES) -> DataFrame:
    """What the stream's rows come to, from a table of events: the last progress row of each run, first failures, late rows."""
    run = F.col("run_id").cast("string").alias("run_id")
    ends = parsed.where("event = 'done'").groupBy(run).agg(F.min("line_no").alias("_end"))
    rows = parsed.where("event IN ('progress', 'candidate_failed')").select(run, "line_no", "event", "engine", "video_path", "sample_id", "phase", "reason")
    rows = rows.join(ends, "run_id", "left")
    none = {c: F.lit(None).cast("string").alias(c) for c in ("sample_id", "video_path", "phase", "reason")}
    inside, late = rows.where("_end IS NULL OR line_no < _end"), rows.where("line_no > _end")
    seen = inside.where("event = 'progress'").groupBy("run_id", "video_path", "engine").agg(F.min("line_no").alias("first"))
    videos = seen.groupBy("run_id", "video_path").agg(
        F.count("*").alias("steps"), (F.count_if(F.col("engine").isin(*engines)) == len(engines)).alias("completed"), F.max("first").alias("first")
    )
    counts = videos.groupBy("run_id").agg(F.count_if("completed").alias("completed"), F.sum("steps").alias("steps"), F.max("first").alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    progress = counts.join(ends, "run_id", "full").select(
        "run_id", F.lit("progress").alias("kind"), F.coalesce("_end", "first").alias("line_no"), zero("completed"), zero("steps"),
        F.col("_end").isNotNull().alias("done"), *none.values(),
    )
    first = inside.where("event = 'candidate_failed'").groupBy("run_id", "sample_id").agg(F.min_by(F.struct("line_no", "video_path", "phase", "reason"), "line_no").alias("f"))
    no = F.lit(None).cast("bigint")
    failure = first.select("run_id", F.lit("failure").alias("kind"), "f.line_no", no.alias("completed"), no.alias("steps"), F.lit(False).alias("done"), "sample_id", "f.video_path", "f.phase", "f.reason")
    after = late.select("run_id", F.lit("late").alias("kind"), "line_no", no.alias("completed"), no.alias("steps"), F.lit(True).alias("done"), "sample_id", "video_path", "phase", "reason")
    return progress.unionByName(failure).unionByName(after)


def settled(rows: DataFrame) -> DataFrame:
    """The rows of a stream over all its batches in the form of :func:`fold_batch`."""
    counts = lambda c: F.when(F.col("kind") == "progress", F.col(c)).alias(c)
    columns = ["run_id", "kind", "line_no", "completed", "steps", "done", "sample_id", "video_path", "phase", "reason"]
    newest = rows.where("kind = 'progress'").groupBy("run_id").agg(F.max_by(F.struct(*columns), F.struct("done", "line_no")).alias("r")).select("r.*")
    others = rows.where("kind <> 'progress'").select(*columns)
    return newest.unionByName(others).select(*[counts(c) if c in ("completed", "steps") else c for c in columns])
