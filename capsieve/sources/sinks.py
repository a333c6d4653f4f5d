"""Sinks: captions and reports as tables partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, run: str = "run_id", fmt: str = "parquet") -> None:
    """Overwrites only the runs present in ``df``; rows of one run are spread by the frame's partitions."""
    (
        df.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run)
        .save(path)
    )


def write_captions(parts: DataFrame, path: str, run: str = "run_id") -> None:
    """Caption parts; in ``part_no`` order they concatenate to the files."""
    write_table(parts, path, run)


def write_reports(reports: dict[str, DataFrame], root: str, run: str = "run_id", fmt: str = "parquet") -> None:
    """One folder per report name (alignments, quality, stage, commit, verification, summary)."""
    for name, df in reports.items():
        write_table(df, f"{root.rstrip('/')}/{name}", run, fmt)
