"""Runs: what is pending, staged, published, verified, and how it is reported."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.functions.labels import status_label
from capsieve.functions.timecode import iso_epoch
from capsieve.functions.text import casefold
from capsieve.operators.ordering import number_in_groups

KEYS = ("run_id", "sample_id")
DURATION_TOLERANCE = 0.05  # fixed value, seconds
LARGE_RUN_STORE = 5 * 1024**3  # fixed value, bytes


def manifest_tables(manifests: DataFrame) -> dict[str, DataFrame]:
    """Run manifests (``schemas.MANIFEST``) as the tables the other operators take."""
    listed = lambda column: manifests.select("run_id", F.explode(column).alias("x"))
    return {
        "runs": manifests.select(
            "run_id", "status", "created_at_utc", "updated_at_utc", "discovery.video_count", "discovery.candidate_count"
        ),
        "candidates": listed("candidates").select("run_id", "x.*"),
        "failures": listed("candidate_failures").select("run_id", "x.*"),
        "excluded": listed("excluded_videos").select("run_id", F.col("x").alias("video_path")).distinct(),
    }


def pending(candidates: DataFrame, valid_outputs: DataFrame, engines: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidates that lack a valid output of any engine."""
    done = (
        valid_outputs.filter(F.col("engine").isin(*engines))
        .select(*keys, "engine")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") == len(set(engines)))
    )
    return candidates.join(done, list(keys), "left_anti")


def eligible(candidates: DataFrame, failures: DataFrame, only: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candidates without a recorded failure, optionally limited to the ids of ``only``."""
    kept = candidates.join(failures.select(*keys), list(keys), "left_anti")
    return kept if only is None else kept.join(only.select(*keys), list(keys), "left_semi")


def split_phases(candidates: DataFrame, pilot_count: int, run: str = "run_id", order: str = "sample_id") -> DataFrame:
    """Adds ``phase``: the first ``pilot_count`` candidates of a run are the pilot."""
    ranked = number_in_groups(candidates, [run], [F.col(order)], "candidate_no")
    return ranked.withColumn(
        "phase", F.when(F.col("candidate_no") <= max(0, pilot_count), "pilot").otherwise("remaining")
    )


def duration_mismatch(outputs: DataFrame, primary: str, secondary: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples whose engines disagree on the audio length."""
    of = lambda e: F.max(F.when(F.col("engine") == e, F.col("duration_seconds")))
    return (
        outputs.groupBy(*keys)
        .agg(of(primary).alias("primary_duration"), of(secondary).alias("secondary_duration"))
        .filter(F.abs(F.col("primary_duration") - F.col("secondary_duration")) > DURATION_TOLERANCE)
    )


def merge_stage(previous: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """New reports replace those of the same sample, others stay."""
    kept = previous.join(new.select(*keys), list(keys), "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def stage_summary(
    reports: DataFrame, candidates: DataFrame, failures: DataFrame, selected: DataFrame | None = None,
    run: str = "run_id", sample: str = "sample_id",
) -> DataFrame:
    """Per run: staged_all, all_passed, selected_passed, warning totals.

    Judged over candidates without a recorded failure; an empty set passes. Warning totals cover every
    merged report. The ids behind them are rows of :func:`warning_samples`.
    """
    keys = [run, sample]
    judged = eligible(candidates, failures, keys=keys).select(*keys, F.lit(True).alias("_eligible"))
    chosen = candidates if selected is None else selected
    picked = eligible(chosen, failures, keys=keys).select(*keys, F.lit(True).alias("_selected"))
    staged = reports.select(*keys, "passed", "warning_count", F.lit(True).alias("_staged"))
    rows = judged.join(picked, keys, "full").join(staged, keys, "full")
    ok = F.coalesce(F.col("passed"), F.lit(False))
    flag = lambda cond, value: F.coalesce(F.bool_and(F.when(cond, value)), F.lit(True))
    staged_flag = F.coalesce("_staged", F.lit(False))
    summary = rows.groupBy(run).agg(
        flag(F.col("_eligible"), staged_flag).alias("staged_all"),
        flag(F.col("_eligible"), staged_flag & ok).alias("all_passed"),
        flag(F.col("_selected"), staged_flag & ok).alias("selected_passed"),
        F.count("_staged").alias("staged_count"),
        F.coalesce(F.sum("warning_count"), F.lit(0)).alias("warning_count"),
        F.count_if(F.col("warning_count") > 0).alias("warning_sample_count"),
    )
    runs = candidates.select(run).distinct()
    return (
        runs.join(summary, run, "left")
        .fillna({"staged_all": True, "all_passed": True, "selected_passed": True})
        .fillna(0, ["staged_count", "warning_count", "warning_sample_count"])
        .withColumn("has_warnings", F.col("warning_sample_count") > 0)
    )


def warning_samples(reports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ids of reports with warnings, in id order."""
    return reports.filter("warning_count > 0").select(*keys).orderBy(*keys)


def check_staged(digests: DataFrame, reports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples whose staged caption no longer hashes to the reported value."""
    said = reports.select(*keys, F.col("caption_sha256").alias("reported_sha256"))
    return digests.join(said, list(keys)).filter(F.col("caption_sha256") != F.col("reported_sha256"))


def commit_plan(
    candidates: DataFrame, failures: DataFrame, digests: DataFrame, summary: DataFrame,
    blockers: Sequence[DataFrame] = (), run: str = "run_id", sample: str = "sample_id",
) -> DataFrame:
    """Entries to publish, only for runs that are fully staged and passed.

    A run named in any of ``blockers`` (changed files, broken hashes) publishes nothing.
    """
    keys = [run, sample]
    open_runs = summary.filter("staged_all AND all_passed").select(run)
    for blocker in blockers:
        open_runs = open_runs.join(blocker.select(run), run, "left_anti")
    return (
        eligible(candidates, failures, keys=keys)
        .join(open_runs, run, "left_semi")
        .join(digests, keys)
        .select(
            *keys, "video_path", "target_path",
            F.col("caption_size").alias("target_size"), F.col("caption_sha256").alias("target_sha256"),
        )
    )


def verify_publish(
    candidates: DataFrame, failures: DataFrame, videos_now: DataFrame, targets_now: DataFrame, digests: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Per eligible candidate the first failure code, or null when verified.

    ``videos_now`` holds quick fingerprints; ``targets_now`` ``path, size, sha256, format_code`` of the
    published files. Content is compared by size and hash.
    """
    videos = videos_now.select(
        F.col("path").alias("video_path"),
        F.struct(F.col("exists"), F.col("size"), F.col("mtime")).alias("_now"),
    )
    targets = targets_now.select(
        F.col("path").alias("target_path"),
        F.struct("size", "sha256", "format_code").alias("_target"),
    )
    gone = F.struct(F.lit(False).alias("exists"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    now = F.coalesce(F.col("_now"), gone)
    same = reduce(lambda a, b: a & b, [now[c].eqNullSafe(F.col(f"video_fp.{c}")) for c in ("exists", "size", "mtime")])
    return (
        eligible(candidates, failures, keys=keys)
        .join(videos, "video_path", "left")
        .join(targets, "target_path", "left")
        .join(digests.select(*keys, "caption_size", "caption_sha256"), list(keys), "left")
        .select(
            *keys,
            "video_path",
            "target_path",
            F.when(~same, "video_changed")
            .when(F.coalesce(F.col("_target.size"), F.lit(0)) == 0, "target_empty")
            .when(
                ~(
                    F.col("_target.size").eqNullSafe(F.col("caption_size"))
                    & F.col("_target.sha256").eqNullSafe(F.col("caption_sha256"))
                ),
                "target_differs",
            )
            .when(F.col("_target.format_code").isNotNull(), "format_invalid")
            .alias("failure_code"),
            F.col("_target.size").alias("size"),
            F.col("_target.sha256").alias("sha256"),
        )
    )


def verification_summary(verified: DataFrame, run: str = "run_id") -> DataFrame:
    return verified.groupBy(run).agg(
        F.count_if(F.col("failure_code").isNull()).alias("verified_count"),
        F.count_if(F.col("failure_code").isNotNull()).alias("failure_count"),
    ).withColumn("passed", F.col("failure_count") == 0)


def _tally(parts: dict[str, DataFrame], run: str) -> DataFrame:
    """Counts (and sums of ``n``) of several row kinds per run, in one shuffle."""
    frames = [
        df.select(F.col(run), F.lit(kind).alias("kind"), (F.col("n") if "n" in df.columns else F.lit(0)).cast("bigint").alias("n"))
        for kind, df in parts.items()
    ]
    kinds = list(parts)
    return reduce(DataFrame.unionByName, frames).groupBy(run).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_rows") for k in kinds],
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"{k}_sum") for k in kinds],
    )


def run_summary(
    runs: DataFrame, candidates: DataFrame, excluded: DataFrame, failures: DataFrame, reports: DataFrame,
    entries: DataFrame, commits: DataFrame, verification: DataFrame, verify_failures: DataFrame, run: str = "run_id",
) -> DataFrame:
    """One row per run with states, times and counts; absent artefacts count as nothing.

    ``runs`` carry the discovery counts ``video_count`` and ``candidate_count`` (may be null).
    """
    rows = _tally(
        {
            "candidate": candidates,
            "excluded": excluded,
            "skipped": failures,
            "passed": reports.filter("passed"),
            "failed": reports.filter("NOT passed"),
            "warned": reports.filter("warning_count > 0").withColumn("n", F.col("warning_count")),
            "entry": entries,
            "verify_failure": verify_failures,
        },
        run,
    )
    checks = verification.select(run, F.col("passed").alias("_verified"), "verified_count")
    joined = (
        runs.withColumnsRenamed({"video_count": "_videos", "candidate_count": "_found"})
        .join(rows, run, "left")
        .join(commits.select(run, "committed_at_utc"), run, "left")
        .join(checks, run, "left")
    )
    of = lambda c: F.coalesce(c, F.lit(0))
    both = (of("_videos") > 0) & (of("_found") > 0)
    status = F.coalesce("status", F.lit("unknown"))
    failed = F.when(F.col("_verified"), 0).otherwise(of("verify_failure_rows"))
    return joined.select(
        run,
        status.alias("status"),
        status_label(status).alias("status_label"),
        F.col("created_at_utc").alias("started_at"),
        F.coalesce("committed_at_utc", "updated_at_utc", "created_at_utc").alias("ended_at"),
        of("candidate_rows").alias("candidate_count"),
        F.when(both, F.greatest(F.lit(0), F.col("_videos") - F.col("_found"))).otherwise(of("excluded_rows")).alias("excluded_count"),
        of("skipped_rows").alias("skipped_count"),
        of("passed_rows").alias("passed_count"),
        of("failed_rows").alias("failed_count"),
        of("entry_rows").alias("committed_count"),
        of("warned_rows").alias("warning_sample_count"),
        of("warned_sum").alias("warning_count"),
        F.when(F.col("_verified").isNull(), "none").when(failed > 0, "failed").otherwise("passed").alias("verification"),
        F.when(F.col("_verified").isNotNull(), of("verified_count")).alias("verified_count"),
        F.when(F.col("_verified").isNotNull(), failed).alias("verify_failure_count"),
    )


def completion_stats(
    runs: DataFrame, commits: DataFrame, entries: DataFrame, stages: DataFrame, failures: DataFrame, run: str = "run_id"
) -> DataFrame:
    """Elapsed seconds, written captions, warnings and failures per run.

    ``commits`` may state an ``entry_count``; where it is absent or 0 the entries are counted.
    """
    rows = _tally({"entry": entries, "failure": failures}, run)
    joined = (
        runs.join(commits.select(run, "committed_at_utc", "entry_count"), run, "left")
        .join(stages.select(run, "warning_count"), run, "left")
        .join(rows, run, "left")
    )
    ended = F.coalesce("committed_at_utc", "updated_at_utc")
    said = F.coalesce("entry_count", F.lit(0))
    return joined.select(
        run,
        (iso_epoch(ended) - iso_epoch(F.col("created_at_utc"))).alias("elapsed_seconds"),
        F.when(said > 0, said).otherwise(F.coalesce("entry_rows", F.lit(0))).alias("written_count"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
        F.coalesce("failure_rows", F.lit(0)).alias("failed_count"),
    )


SECTIONS = ("warning", "skipped", "failure", "verify", "written")


def run_issues(
    reports: DataFrame, failures: DataFrame, verify_failures: DataFrame, entries: DataFrame, run: str = "run_id", sample: str = "sample_id"
) -> DataFrame:
    """The detail sections of a run report as rows: ``run, section, section_no, sample, item_no, message``."""

    def rows(df: DataFrame, section: str, message: Column, item: Column = F.lit(0)) -> DataFrame:
        return df.select(
            F.col(run),
            F.lit(section).alias("section"),
            F.lit(SECTIONS.index(section)).alias("section_no"),
            F.col(sample),
            item.cast("bigint").alias("item_no"),
            message.alias("message"),
        )

    def coded(column: str, df: DataFrame, section: str) -> DataFrame:
        exploded = df.select(run, sample, F.posexplode_outer(column).alias("i", "m"))
        return rows(exploded, section, F.coalesce("m", F.lit("")), F.coalesce("i", F.lit(0)))

    parts = [
        coded("warnings", reports.filter(F.size("warnings") > 0), "warning"),
        rows(failures, "skipped", F.col("reason")),
        coded("errors", reports.filter("NOT passed"), "failure"),
        rows(verify_failures, "verify", F.col("failure_code")),
        rows(entries, "written", F.concat_ws(" ", F.col("target_path"), F.col("target_size").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def all_failures(parts: dict[str, DataFrame]) -> DataFrame:
    """Failure tables of any kind as one, each tagged with its ``kind``; absent columns are null."""
    tagged = [df.withColumn("kind", F.lit(kind)) for kind, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def run_inventory(files: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Bytes, state and creation time of every run folder, with the order of the folded names."""
    sizes = files.groupBy(run).agg(F.sum("length").alias("size_bytes"), F.count("*").alias("file_count"))
    return (
        sizes.join(runs.select(run, "status", "created_at_utc"), run, "full")
        .select(
            run,
            casefold(F.col(run).cast("string")).alias("run_key"),
            F.coalesce("status", F.lit("unknown")).alias("status"),
            "created_at_utc",
            F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
        )
    )


def inventory_total(inventory: DataFrame) -> DataFrame:
    """Grand total over all runs, and whether it passes the large-store mark."""
    return inventory.agg(
        F.count("*").alias("run_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    ).withColumn("over_limit", F.col("total_bytes") > LARGE_RUN_STORE)


def usage_by_area(files: DataFrame, area: str = "area") -> DataFrame:
    """Bytes per area, and in total under ``(total)``."""
    return (
        files.rollup(area)
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"), F.grouping(area).alias("_total"))
        .select(F.when(F.col("_total") == 1, "(total)").otherwise(F.col(area)).alias(area), "size_bytes")
    )


def is_resumable(runs: DataFrame) -> DataFrame:
    """Runs with a readable manifest that are not committed."""
    return runs.filter(~F.col("status").eqNullSafe("committed"))


def first_failed(reports: DataFrame, run: str = "run_id", order: str = "sample_id") -> DataFrame:
    """The first report in order that did not pass, with its errors joined."""
    reason = F.when(F.size("errors") > 0, F.array_join("errors", "；")).otherwise("质量门禁未通过")
    return (
        reports.filter("NOT passed")
        .groupBy(run)
        .agg(F.min_by(F.struct(F.col(order), "video_path", reason.alias("reason")), F.col(order)).alias("f"))
        .select(run, "f.*")
    )
