"""Snapshot comparison: did a file change between a baseline and now?

Fingerprint columns are ``path, exists, size, mtime, sha256``. Times compare at the precision of the
listing (milliseconds for Spark's file source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("exists", "size", "mtime", "sha256")


def _beside(base: DataFrame, current: DataFrame, path: str = "path") -> DataFrame:
    """Baseline rows with the current fingerprint of the same path; an absent path does not exist now."""
    now = current.select(F.col("path").alias(path), *[F.col(c).alias(f"now_{c}") for c in FIELDS if c in current.columns])
    for c in FIELDS:
        if f"now_{c}" not in now.columns:
            now = now.withColumn(f"now_{c}", F.lit(None).cast(base.schema[c].dataType))
    joined = base.join(now, path, "left")
    return joined.withColumn("now_exists", F.coalesce("now_exists", F.lit(False)))


def quick_match() -> Column:
    same = [F.col(f"now_{c}").eqNullSafe(F.col(c)) for c in FIELDS[:3]]
    return same[0] & same[1] & same[2]


def full_match() -> Column:
    """Quick match, and the hashes agree whenever the baseline has one."""
    return quick_match() & F.when(F.col("sha256").isNull(), True).otherwise(
        F.coalesce(F.col("now_sha256") == F.col("sha256"), F.lit(False))
    )


def diff_quick(base: DataFrame, current: DataFrame) -> DataFrame:
    return _beside(base, current).withColumn("matches", quick_match())


def diff_full(base: DataFrame, current: DataFrame) -> DataFrame:
    return _beside(base, current).withColumn("matches", full_match())


def validate_protected(protected: DataFrame, current: DataFrame) -> DataFrame:
    """Protected texts whose full fingerprint no longer matches."""
    return diff_full(protected, current).filter(~F.col("matches")).select("path")


def validate_candidates(
    candidates: DataFrame,
    current: DataFrame,
    keys: Sequence[str] = ("run_id", "sample_id"),
    require_initial_target: bool = True,
) -> DataFrame:
    """Failures ``keys, kind, path``: the video changed (quick check) or its target did (full check).

    Candidates carry ``video_fp`` and ``target_fp`` structs. Both kinds may fire for one candidate.
    """

    def side(path: str, fp: str, kind: str, match: Column) -> DataFrame:
        base = candidates.select(*keys, F.col(path).alias("path"), f"{fp}.*")
        return _beside(base, current).filter(~match).select(*keys, F.lit(kind).alias("kind"), "path")

    failures = side("video_path", "video_fp", "video_changed", quick_match())
    if require_initial_target:
        failures = failures.unionByName(side("target_path", "target_fp", "target_changed", full_match()))
    return failures
