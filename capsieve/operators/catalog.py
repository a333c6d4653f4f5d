"""Media catalog: which videos need captions, which collide on a target, which texts are protected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.functions import paths as P
from capsieve.functions.text import initial_state
from capsieve.functions.timecode import estimate_seconds
from capsieve.operators.ordering import number_in_groups, number_rows

SAMPLE_PREFIX = "CC-CANDIDATE-"  # fixed value


def dedupe_paths(files: DataFrame) -> DataFrame:
    """One row per path; the first root that reaches it wins, in it the first name of a linked file. Aggregated before the shuffle."""
    others = [c for c in files.columns if c not in ("path", "root_ord")]
    first = F.col("root_ord")
    if "named_path" in others:
        first = F.struct(first, P.fold_key(F.col("named_path")), "named_path")
    return (
        files.groupBy("path")
        .agg(F.min_by(F.struct("root_ord", *others), first).alias("_first"))
        .select("path", "_first.*")
    )


def with_targets(videos: DataFrame) -> DataFrame:
    """Adds the target path, if there is none, the case-folded target that collisions are judged by, and the sort key."""
    target = F.col("target_path") if "target_path" in videos.columns else P.target_path(F.col("path"))
    return videos.withColumn("target_path", target).withColumns(
        {"target_key": P.fold_key(F.col("target_path")), "path_key": P.fold_key(F.col("path"))}
    )


def pair_targets(targeted: DataFrame, texts: DataFrame) -> DataFrame:
    """Videos with ``target_exists`` (and the target's columns, prefixed, when present)."""
    cols = [c for c in ("length", "modification_time", "content", "sha256", "state") if c in texts.columns]
    right = texts.select(
        F.col("path").alias("target_path"),
        F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"target_{c}") for c in cols],
    )
    return targeted.join(right, "target_path", "left").withColumn(
        "target_exists", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def _member_counts(targeted: DataFrame) -> DataFrame:
    return targeted.groupBy("target_key").agg(F.count("*").alias("video_count")).filter("video_count > 1")


def conflicts(targeted: DataFrame) -> DataFrame:
    """Videos that share a folded target, in long form.

    One row per video: ``target_path`` of the first member, ``position`` in scan order, group size.
    The long form has no array that grows with a popular target.
    """
    members = targeted.join(_member_counts(targeted), "target_key")
    scan = (F.col("root_ord"), F.col("path_key"), F.col("path"))
    placed = number_in_groups(members, ["target_key"], scan)
    heads = placed.filter("position = 1").select("target_key", F.col("target_path").alias("first_target"))
    return placed.join(heads, "target_key").select(
        F.col("first_target").alias("target_path"), "video_count", "position", F.col("path").alias("video_path")
    )


def without_conflicts(targeted: DataFrame) -> DataFrame:
    return targeted.join(_member_counts(targeted), "target_key", "left_anti")


def number_candidates(videos: DataFrame) -> DataFrame:
    """Stable sample ids in folded-path order."""
    ranked = number_rows(videos, (F.col("path_key"), F.col("path")), "rank")
    # Ids grow wider beyond 99,999; they are never cut.
    text = F.col("rank").cast("string")
    padded = F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)
    return ranked.withColumn("sample_id", F.concat(F.lit(SAMPLE_PREFIX), padded))


def candidates(targeted: DataFrame, texts: DataFrame) -> DataFrame:
    """Numbered videos without a target collision, with the initial state of their target.

    The state is computed on the text side, so target bytes are not shuffled.
    """
    slim = texts
    if "content" in texts.columns:
        slim = texts.withColumn("state", initial_state(F.col("content"))).drop("content")
    numbered = number_candidates(without_conflicts(targeted))
    return (
        pair_targets(numbered, slim)
        .withColumn("initial_state", F.coalesce("target_state", F.lit("missing")))
        .withColumnRenamed("path", "video_path")
        .drop("target_state", "target_key", "path_key", "rank")
    )


def protected_texts(targeted: DataFrame, texts: DataFrame) -> DataFrame:
    """Non-empty texts that are no video's target; targets of colliding videos count as targets."""
    targets = targeted.select(F.col("target_path").alias("path"))
    return texts.filter("length > 0").join(targets, "path", "left_anti")


def discovery_summary(targeted: DataFrame, texts: DataFrame) -> DataFrame:
    """One row of counts; colliding videos count as videos and as matched or missing, not as candidates."""
    names = texts.select("path", "length")
    per_target = (
        pair_targets(targeted, names.select("path"))
        .groupBy("target_key")
        .agg(F.count("*").alias("n"), F.count_if("target_exists").alias("matched"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    counts = per_target.agg(
        zero(F.sum("n")).alias("video_count"),
        zero(F.sum("matched")).alias("matched_text_count"),
        zero(F.sum(F.col("n") - F.col("matched"))).alias("missing_text_count"),
        F.count_if(F.col("n") == 1).alias("candidate_count"),
        F.count_if(F.col("n") > 1).alias("conflict_count"),
    )
    guarded = protected_texts(targeted, names).agg(F.count("*").alias("protected_count"))
    # Both sides are global aggregates of one row each.
    return counts.join(F.broadcast(guarded), F.lit(True))


def apply_exclusions(candidates_: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates whose video is not listed; exact path match."""
    return candidates_.join(excluded.select("video_path"), "video_path", "left_anti")


def matched_exclusions(candidates_: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates whose video is listed."""
    return candidates_.join(excluded.select("video_path"), "video_path", "left_semi")


def selection_summary(
    candidates_: DataFrame,
    selected: DataFrame,
    conflict_rows: DataFrame,
    protected: DataFrame,
    stated_excluded: int | None = None,
) -> DataFrame:
    """Candidate, selected, excluded, conflict and protected counts in one row.

    The excluded count of the confirmation is the stated one, else the number of colliding videos.
    """
    parts = [
        candidates_.select(F.lit("candidate").alias("kind")),
        selected.select(F.lit("selected").alias("kind")),
        conflict_rows.filter("position = 1").select(F.lit("conflict").alias("kind")),
        conflict_rows.select(F.lit("conflict_video").alias("kind")),
        protected.select(F.lit("protected").alias("kind")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return every.agg(
        of("candidate").alias("candidate_count"),
        of("selected").alias("selected_count"),
        F.greatest(F.lit(0), of("candidate") - of("selected")).alias("excluded_count"),
        of("conflict").alias("conflict_count"),
        of("conflict_video").alias("conflict_video_count"),
        (of("conflict_video") if stated_excluded is None else F.lit(stated_excluded).cast("bigint")).alias(
            "confirmed_excluded_count"
        ),
        of("protected").alias("protected_count"),
    )


def cost_profile(candidates_: DataFrame, duration: Column, size: Column) -> DataFrame:
    """Adds the expected processing time of each candidate."""
    return candidates_.withColumn("estimate_seconds", estimate_seconds(duration, size))


def terms(
    candidates_: DataFrame, file_terms: DataFrame | None = None, limit: int = 200, run: str = "run_id"
) -> DataFrame:
    """First spelling of each term of each run: file terms first, then file-stem terms in candidate order.

    ``limit`` is the feature: an engine takes that many terms for a run. File terms hold for every run.
    """
    stems = candidates_.select(
        run,
        F.lit(1).alias("source"),
        F.col("sample_id").cast("string").alias("owner"),
        F.posexplode(P.stem_terms(F.col("video_path"))).alias("position", "term"),
    ).withColumn("position", F.col("position").cast("bigint"))
    every = stems
    if file_terms is not None:
        listed = file_terms.select(F.lit(0).alias("source"), F.lit("").alias("owner"), "position", "term")
        # A term list is short; it meets each run once.
        shared = listed.groupBy().agg(F.collect_list(F.struct("source", "owner", "position", "term")).alias("_t"))
        every = candidates_.select(run).distinct().join(shared).select(run, F.inline("_t")).unionByName(stems)
    place = F.struct("source", F.length("owner").alias("width"), "owner", "position")
    return (
        every.withColumn("term_key", P.fold_key(F.col("term")))
        .groupBy(run, "term_key")
        .agg(F.min(F.struct(place.alias("place"), "term")).alias("first"))
        .withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy("first.place")))
        .where(F.col("_n") <= limit)
        .select(run, "term_key", "first.term", "first.place")
    )
