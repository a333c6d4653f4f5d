"""The two batch flows from end to end: scanning folders, and staging a run for publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.functions.paths import is_video
from capsieve.operators import align, captions, catalog, quality, runs
from capsieve.session import materialize
from capsieve.sources import files

KEYS = ("run_id", "sample_id")


def scan(spark: SparkSession, roots: Sequence[str]) -> dict[str, DataFrame]:
    """Candidates, conflicts, protected texts and counts of the folders. The listing is walked once.

    Roots are the real folders behind the names given, and linked files count as the files they lead to.
    """
    listed = files.resolve_links(files.list_files(spark, files.normalize_roots(roots)))
    media = listed.filter(is_video(F.col("named_path")))
    texts, names = files.scan_listed_texts(listed), files.scan_listed_texts(listed, content=False)
    targeted = catalog.with_targets(catalog.dedupe_paths(media))
    return {
        "candidates": catalog.candidates(targeted, texts),
        "conflicts": catalog.conflicts(targeted),
        "protected": catalog.protected_texts(targeted, names),
        "summary": catalog.discovery_summary(targeted, names),
    }


def stage(
    candidates: DataFrame,
    primary: DataFrame,
    secondary: DataFrame,
    failures: DataFrame,
    previous: dict[str, DataFrame] | None = None,
    blockers: Sequence[DataFrame] = (),
) -> dict[str, DataFrame]:
    """Gate the eligible candidates and plan the publication.

    ``candidates`` carry paths and ``duration_seconds``. Alignments and reports are written out, as both
    are results and inputs of what follows. ``previous`` holds the ``reports`` and ``digests`` of an earlier
    call: candidates that have a report there and no segments here keep both, and the plan covers them too.
    """
    judged = runs.eligible(candidates, failures)
    if previous is not None:
        fresh = primary.select(*KEYS).union(secondary.select(*KEYS)).distinct()
        unseen = judged.select(*KEYS).join(previous["reports"].select(*KEYS), list(KEYS), "left_anti")
        judged = judged.join(materialize(fresh.union(unseen).distinct()), list(KEYS), "left_semi")
    ids = judged.select(*KEYS)
    prim, sec = (side.join(ids, list(KEYS), "left_semi") for side in (primary, secondary))
    parts = materialize(captions.caption_parts(prim))
    digests = materialize(captions.caption_digests(parts))
    alignments = materialize(align.align(prim, sec))
    staged = digests.join(captions.block_metrics(prim), list(KEYS))
    risk = align.alignment_summary(alignments)
    reports = materialize(quality.quality(judged, prim, sec, risk, staged))
    if previous is not None:
        kept = previous["digests"].join(ids, list(KEYS), "left_anti")
        reports, digests = runs.merge_stage(previous["reports"], reports), kept.unionByName(digests)
    summary = runs.stage_summary(reports, candidates, failures)
    broken = runs.check_staged(digests, reports)
    return {
        "captions": parts,
        "digests": digests,
        "alignments": alignments,
        "reports": reports,
        "summary": summary,
        "entries": runs.commit_plan(candidates, failures, digests, summary, [broken, *blockers]),
    }
