"""Folds over run events: progress, last states, failure reports, transfer progress."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.functions.labels import PRIMARY_ENGINE, SECONDARY_ENGINE, detect_stage, phase_label
from capsieve.functions.text import is_blank, strip_left, strip_right
from capsieve.session import materialize

ENGINES = (PRIMARY_ENGINE, SECONDARY_ENGINE)
TAIL_CHARS = 1200  # fixed value
HELD_ROWS, HELD_CHARS = 50_000, 16 << 20


def touched(events: DataFrame, run: str = "run_id", engines: Sequence[str] = ENGINES) -> DataFrame:
    """Per (run, video): number of engines that touched it, and whether all required ones did."""
    seen = events.filter("event = 'progress'").select(run, "video_path", "engine").distinct()
    return seen.groupBy(run, "video_path").agg(
        F.count("*").alias("steps"),
        (F.count_if(F.col("engine").isin(*engines)) == len(engines)).alias("completed"),
    )


def derive_progress(counts: DataFrame, engine_count: int = len(ENGINES)) -> DataFrame:
    """Percent and remaining time from ``completed, steps, total, elapsed_seconds``."""
    total = F.greatest(F.lit(0), F.coalesce("total", F.lit(0)))
    all_steps = total * engine_count
    steps, elapsed = F.col("steps"), F.greatest(F.lit(0.0), F.col("elapsed_seconds").cast("double"))
    return counts.withColumns(
        {
            "total": total,
            "percent": F.when(all_steps > 0, F.bround(steps / all_steps * 100, 0)).otherwise(0.0).cast("bigint"),
            "remaining_seconds": F.when(
                (steps > 0) & (all_steps > steps), elapsed / steps * (all_steps - steps)
            ),
        }
    )


def progress(
    events: DataFrame, totals: DataFrame, run: str = "run_id", engines: Sequence[str] = ENGINES
) -> DataFrame:
    """Progress per run of ``totals`` (``run, total, elapsed_seconds``).

    A video is complete when every engine touched it; percent and remaining time count (video, engine)
    steps. Distinct steps are reduced before each shuffle, so a busy run does not gather in one task.
    """
    folded = touched(events, run, engines).groupBy(run).agg(
        F.count_if("completed").alias("completed"), F.sum("steps").alias("steps")
    )
    counts = totals.join(folded, run, "left").fillna(0, ["completed", "steps"])
    return derive_progress(counts, len(engines)).select(
        run, "completed", "steps", "total", "percent", "remaining_seconds"
    )


def last_events(events: DataFrame, run: str = "run_id", seq: str = "line_no") -> DataFrame:
    """Last error, run folder and progress counts per run, and whether a done event was seen."""
    latest = lambda kind, *cols: F.max_by(
        F.when(F.col("event") == kind, F.struct(*cols)), F.when(F.col("event") == kind, F.col(seq))
    )
    return events.groupBy(run).agg(
        latest("error", "phase", "reason", "video_path", "sample_id").alias("last_error"),
        latest("run_dir", "path").alias("last_run_dir"),
        latest("progress", "index", "total").alias("last_progress"),
        F.coalesce(F.bool_or(F.col("event") == "done"), F.lit(False)).alias("done"),
    )


def _newest(run: str, seq: str, chars: int):
    """Per task, the last lines of each run up to ``chars`` characters; a task with too many runs hands on what it holds."""

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([run, seq], ascending=[True, False], kind="stable", ignore_index=True)
        cost = frame["text"].str.len() + 1
        behind = cost.groupby(frame[run], sort=False).cumsum() - cost
        return frame[behind <= chars]

    def suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            if len(frame):
                held = cut(frame if held is None else pd.concat([held, frame]))
                if len(held) > HELD_ROWS or held["text"].str.len().sum() + held["after"].str.len().sum() > HELD_CHARS:
                    yield held
                    held = None
        if held is not None:
            yield held

    return suffixes


def output_tail(lines: DataFrame, run: str = "run_id", seq: str = "line_no", chars: int = TAIL_CHARS) -> DataFrame:
    """The last ``chars`` characters of each run's stripped text.

    White space before the first and after the last solid line is dropped. Lines stay where they are: each task keeps,
    for each run, the last lines that can reach into the tail, and only those are shuffled. Solid lines give the place
    of the last one; blank lines count if they stand between solid ones, so they are cut once that place is known.
    Lines without run, number or text are left out, and runs without solid lines have no row.
    """
    value = F.col("value")
    known = lines.filter(F.col(run).isNotNull() & F.col(seq).isNotNull() & value.isNotNull())
    blank = is_blank(value)
    # A line is cut behind its last solid character; what follows counts unless it is the last line, what leads counts
    # unless it is the first.
    ended = strip_right(value)
    size = F.least(F.char_length(ended), F.lit(chars))
    parts = known.filter(~blank).select(
        run, seq, F.right(ended, F.lit(chars)).alias("text"),
        F.right(F.substring(value, F.char_length(ended) + 1, F.char_length(value)), F.lit(chars)).alias("after"),
        F.greatest(F.lit(0), size - F.char_length(strip_left(ended))).alias("lead"),
    )
    keys = f"{run} {lines.schema[run].dataType.simpleString()}, {seq} {lines.schema[seq].dataType.simpleString()}"
    shape = f"{keys}, text string, after string, lead int"
    solid = materialize(parts.mapInPandas(_newest(run, seq, chars), shape))
    ends = materialize(known.filter(~blank).groupBy(run).agg(F.min(seq).alias("_first"), F.max(seq).alias("_last")))
    between = known.filter(blank).select(run, seq, F.right(value, F.lit(chars)).alias("text")).join(ends, run)
    between = between.filter((F.col(seq) > F.col("_first")) & (F.col(seq) < F.col("_last")))
    blanks = between.select(run, seq, "text", F.lit("").alias("after"), F.lit(0).alias("lead")).mapInPandas(_newest(run, seq, chars), shape)

    # What the tasks kept meets in the order of the lines; a running sum ends it, so no list is longer than the tail.
    cost = F.char_length("text").cast("bigint") + 1
    newest = Window.partitionBy(run).orderBy(F.col(seq).desc())
    near = solid.unionByName(blanks).withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= chars + 1)
    behind = newest.rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_behind", F.coalesce(F.sum(cost).over(behind), F.lit(0)))
    near = near.filter(F.col("_behind") <= chars).join(ends, run)
    text = F.when(F.col(seq) == F.col("_first"), F.substring(F.col("text"), F.col("lead") + 1, F.lit(chars))).otherwise(F.col("text"))
    text = F.when(F.col(seq) == F.col("_last"), text).otherwise(F.concat(text, "after"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq), text.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda p: p["t"]), "\n")
    return near.groupBy(run).agg(F.right(joined, F.lit(chars)).alias("tail"))


def failure_info(
    lines: DataFrame, parsed: DataFrame, fallback: str, run: str = "run_id", seq: str = "line_no"
) -> DataFrame:
    """Stage, reason, file, run folder and counts of each run.

    The last error event wins. Without one, the tail of the whole output is the reason and its words
    decide the stage.
    """
    last = last_events(parsed, run, seq)
    error = F.col("last_error")
    label = F.lit(fallback)
    structured = error.isNotNull()
    of = lambda c: F.when(structured, c)
    return output_tail(lines, run, seq).join(last, run, "full").select(
        run,
        F.when(structured, phase_label(error["phase"], label)).otherwise(detect_stage(F.col("tail"), label)).alias("stage"),
        F.when(structured, error["reason"]).otherwise(F.coalesce("tail", F.lit(""))).alias("reason"),
        of(error["video_path"]).alias("file"),
        of(F.col("last_run_dir.path")).alias("run_dir"),
        of(F.col("last_progress.index")).alias("done_count"),
        of(F.col("last_progress.total")).alias("total_count"),
    )


# Transfer log forms and byte units.
HEADER = r"(?i)Downloading\s+.*?\((\d+(?:\.\d+)?)\s*([KMGT]?B)\)"
FRAME = r"(?i)(\d+(?:\.\d+)?)/(\d+(?:\.\d+)?)\s*([KMGT]?B)"
UNITS = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}


def _bytes(amount: Column, unit: Column) -> Column:
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.upper(unit))
    return F.bround(amount.cast("double") * factor, 0).cast("bigint")


def transfer_amounts(lines: DataFrame) -> DataFrame:
    """Adds announced bytes (summed) and the largest frame of each line, inside the row."""
    heads = F.regexp_extract_all("value", F.lit(HEADER), F.lit(0))
    frames = F.regexp_extract_all("value", F.lit(FRAME), F.lit(0))
    announced = F.transform(
        heads, lambda m: _bytes(F.regexp_extract(m, HEADER + "$", 1), F.regexp_extract(m, HEADER + "$", 2))
    )
    current = F.transform(frames, lambda m: _bytes(F.regexp_extract(m, FRAME, 1), F.regexp_extract(m, FRAME, 3)))
    return lines.withColumns(
        {
            "announced_bytes": F.aggregate(announced, F.lit(0).cast("bigint"), lambda a, b: a + b),
            "frame_bytes": F.coalesce(F.array_max(current), F.lit(0).cast("bigint")),
        }
    )


def transfer_progress(lines: DataFrame, plans: DataFrame, source: str = "source") -> DataFrame:
    """Download progress per log source.

    ``plans`` hold ``source, total_bytes, component_index, component_count, elapsed_seconds``.
    """
    folded = transfer_amounts(lines).groupBy(source).agg(
        F.sum("announced_bytes").alias("_announced"), F.max("frame_bytes").alias("_frame")
    )
    whole = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).cast("bigint")
    joined = plans.join(folded, source, "left").withColumns(
        {c: whole(c) for c in ("total_bytes", "component_index", "component_count")}
    )
    reached = F.least("total_bytes", F.greatest(F.coalesce("_announced", F.lit(0)), F.coalesce("_frame", F.lit(0))))
    joined = joined.withColumn("downloaded_bytes", reached).withColumn(
        "speed_bytes",
        F.when(
            (F.col("elapsed_seconds") >= 2) & (F.col("downloaded_bytes") > 0),
            F.col("downloaded_bytes") / F.col("elapsed_seconds"),
        ),
    )
    done = F.greatest(F.lit(0), F.col("component_index") - 1)
    return joined.select(
        source,
        "component_index",
        "component_count",
        "downloaded_bytes",
        "total_bytes",
        F.when(F.col("component_count") > 0, F.bround(done / F.col("component_count") * 100, 0))
        .otherwise(0.0).cast("bigint").alias("percent"),
        "speed_bytes",
        F.when(
            F.col("total_bytes") > F.col("downloaded_bytes"),
            (F.col("total_bytes") - F.col("downloaded_bytes")) / F.col("speed_bytes"),
        ).alias("remaining_seconds"),
    )
