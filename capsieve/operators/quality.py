"""Quality gate: density, length ratio, repetition, confidence, format and agreement per candidate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.functions.text import by_need, comparison_text, normalize_text
from capsieve.operators.ordering import running_sum_in_blocks
from capsieve.session import materialize

KEYS = ("run_id", "sample_id")
RUN_BLOCK = 4096


@dataclass(frozen=True)
class Bounds:
    """Gate bounds; all comparisons are strict."""

    min_segments: int = 3
    segments_per_minute: int = 5
    density_error: tuple[float, float] = (30.0, 1200.0)
    density_warn: tuple[float, float] = (100.0, 600.0)
    duplicate_error: int = 4
    duplicate_warn: int = 3
    ratio_error: tuple[float, float] = (0.45, 2.20)
    ratio_warn: tuple[float, float] = (0.80, 1.40)
    median_chars_warn: tuple[float, float] = (3.0, 40.0)
    logprob_warn: float = -1.0
    no_speech_warn: float = 0.6


def confidence(secondary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and lowest log probability, highest no-speech probability, segments (nulls included)."""
    return secondary.groupBy(*keys).agg(
        F.avg("avg_logprob").alias("avg_logprob_mean"),
        F.min("avg_logprob").alias("avg_logprob_min"),
        F.max("no_speech_prob").alias("no_speech_prob_max"),
        F.count("*").alias("checked_segments"),
    )


#: Letters that may join what stands before them under NFKC: marks, Hangul vowels and finals in all their forms, half-width
#: sound marks. More than needed does no harm.
JOINING = r"\p{M}\u1160-\u11FF\u3131-\u318E\uA960-\uA97F\uD7B0-\uD7FF\uFF9E-\uFFDC"
#: Signs that become a space and a joining letter; the space goes at the start of a caption.
SPACING = r"\u00A8\u00AF\u00B4\u00B8\u02D8-\u02DD\u037A\u0384\u0385\u1FBD\u1FBF-\u1FC1\u1FCD-\u1FCF\u1FDD-\u1FDF\u1FED\u1FEE\u1FFD\u1FFE\u2017\u203E\u309B\u309C\uFC5E-\uFC63\uFE49-\uFE4C\uFE70-\uFE7F\uFFE3"
NEAR = 512


def joined_lengths(segments: DataFrame, keys: Sequence[str], text: str = "t") -> DataFrame:
    """``keys, joined``: by how much the comparison text of all segments in a row differs from the single ones' lengths.

    A segment that starts with a joining letter goes with the one before it, empty ones apart, and only such chains are
    put together. ``segments`` hold ``seg_index`` and the text.
    """
    solid = segments.filter(F.col(text) != "").select(*keys, "seg_index", text)
    opens = (~F.col(text).rlike(f"^[{JOINING}]")).cast("bigint")
    chained = running_sum_in_blocks(
        solid.withColumn("_opens", opens), keys, F.floor(F.col("seg_index") / NEAR), ["seg_index"], {"_before": F.col("_opens")}
    ).withColumn("_chain", F.col("_before") + F.col("_opens"))
    listed = F.array_sort(F.collect_list(F.struct("seg_index", F.col(text).alias("t"))))
    chains = chained.groupBy(*keys, "_chain").agg(listed.alias("_parts")).filter(F.size("_parts") > 1)
    whole = F.array_join(F.transform("_parts", lambda p: p["t"]), "")
    length = lambda c: F.char_length(comparison_text(c))
    apart = chains.select(*keys, "_chain", F.explode("_parts").alias("p")).groupBy(*keys).agg(F.sum(length(F.col("p.t"))).alias("_apart"))
    together = chains.groupBy(*keys).agg(F.sum(length(whole)).alias("_together"))
    return together.join(apart, list(keys)).select(*keys, (F.col("_together") - F.col("_apart")).alias("joined"))


def _joining(text: Column) -> Column:
    # None of the letters is ASCII; such texts are told by their lengths, without a search.
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{JOINING}{SPACING}]")


def _suspects(segments: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The segments of the samples in whose texts joining letters occur; None, after a look at the texts, without any."""
    found = segments.filter(_joining(F.col("text"))).select(*keys)
    return None if found.isEmpty() else segments.join(found.distinct(), list(keys), "left_semi").select(*keys, "seg_index", "text")


def transcript_metrics(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Segment counts, comparison-text lengths and caption lengths of both transcripts, in one aggregation.

    Lengths add up over segments, so no transcript is concatenated; what letters on both sides of a border become
    together is added for the samples that have such letters. Caption lengths are whole numbers, so the median's value
    table stays small.
    """

    # No letter that joins is stable, so only the other texts are searched.
    joins = lambda stable: F.lit(False) if stable else F.coalesce(_joining(F.col("text")), F.lit(False))

    def shown_sizes(rows: DataFrame, stable: bool) -> DataFrame:
        # One generated element: without it the rules would be repeated above and below the UDF. What is stable stays so.
        shown = rows.select(*keys, joins(stable).alias("j"), F.explode(F.array(normalize_text(F.col("text"), stable))).alias("caption"))
        size = F.char_length(comparison_text(F.col("caption"), stable))
        return shown.select(*keys, "j", F.char_length("caption").alias("c"), size.alias("n"), F.lit(1).alias("p"))

    def plain_sizes(rows: DataFrame, stable: bool) -> DataFrame:
        size = F.char_length(comparison_text(F.col("text"), stable))
        return rows.select(*keys, joins(stable).alias("j"), F.lit(None).cast("int").alias("c"), size.alias("n"), F.lit(0).alias("p"))

    first, second = by_need(primary, shown_sizes), by_need(secondary, plain_sizes)
    side = lambda p, c: F.coalesce(F.sum(F.when(F.col("p") == p, c)), F.lit(0)).cast("bigint")
    shown = F.when(F.col("c") > 0, F.col("c"))
    counted = (
        first.unionByName(second)
        .groupBy(*keys)
        .agg(
            side(1, F.lit(1)).alias("primary_segments"),
            side(0, F.lit(1)).alias("secondary_segments"),
            side(1, F.col("n")).alias("primary_chars"),
            side(0, F.col("n")).alias("secondary_chars"),
            F.count(shown).alias("caption_count"),
            F.percentile(shown, 0.5).alias("median_text_chars"),
            F.max(shown).cast("bigint").alias("max_text_chars"),
            *[F.coalesce(F.bool_or(F.when(F.col("p") == p, F.col("j"))), F.lit(False)).alias(f"_{name}") for name, p in (("primary_chars", 1), ("secondary_chars", 0))],
        )
    )
    # One row a sample, written out so that the look at it and its readers don't count twice.
    counted = materialize(counted)
    shapes = {"primary_chars": (primary, normalize_text(F.col("text"))), "secondary_chars": (secondary, F.col("text"))}
    for name, (side, shown_as) in shapes.items():
        some = None if counted.filter(f"_{name}").isEmpty() else _suspects(side, keys)
        if some is not None:
            more = joined_lengths(some.select(*keys, "seg_index", F.explode(F.array(shown_as)).alias("t")), keys)
            counted = counted.join(more, list(keys), "left").withColumn(name, F.col(name) + F.coalesce("joined", F.lit(0))).drop("joined")
    return counted.drop(*[f"_{name}" for name in shapes])


def longest_duplicate_run(segments: DataFrame, keys: Sequence[str] = KEYS, block: int = RUN_BLOCK) -> DataFrame:
    """Longest run of consecutive segments with equal, non-empty comparison text; at least 1.

    Runs are found inside blocks of the segment order. Only a block's first and last run can go on in
    a neighbour, so the second pass sees at most two rows per block.
    """
    at = F.floor(F.col("seg_index") / block).alias("block")
    texts = by_need(
        segments, lambda rows, stable: rows.select(*keys, "seg_index", at, comparison_text(F.col("text"), stable).alias("t"))
    )
    inside = Window.partitionBy(*keys, "block").orderBy("seg_index")
    breaks = F.when((F.col("t") == "") | ~F.lag("t").over(inside).eqNullSafe(F.col("t")), 1).otherwise(0)
    runs = (
        texts.withColumn("brk", breaks)
        .withColumn("run", F.sum("brk").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "block", "run")
        .agg(F.any_value("t").alias("t"), F.count("*").alias("n"))
    )
    cell = F.struct("t", "n")
    summary = runs.groupBy(*keys, "block").agg(
        F.max("n").alias("longest"),
        F.max("run").alias("runs"),
        F.min_by(cell, "run").alias("head"),
        F.max_by(cell, "run").alias("tail"),
    )
    ends = summary.select(
        *keys,
        "block",
        "longest",
        F.posexplode(
            F.when(F.col("runs") == 1, F.array("head")).otherwise(F.array("head", "tail"))
        ).alias("part", "end"),
    )
    over = Window.partitionBy(*keys).orderBy("block", "part")
    cut = (F.col("part") == 1) | (F.col("end.t") == "") | ~F.lag("end.t").over(over).eqNullSafe(F.col("end.t"))
    chained = ends.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn(
        "chain", F.sum("cut").over(over.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = chained.groupBy(*keys, "chain").agg(F.sum("end.n").alias("n"), F.max("longest").alias("longest"))
    return joined.groupBy(*keys).agg(F.greatest(F.max("n"), F.max("longest")).alias("longest_duplicate_run"))


def quality(
    candidates: DataFrame,
    primary: DataFrame,
    secondary: DataFrame,
    risk: DataFrame,
    captions: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """One row per candidate: metrics, ``errors``, ``warnings``, ``passed``.

    ``candidates`` carry ``duration_seconds``; ``risk`` is the alignment summary. ``captions`` adds
    columns of staged captions (size, hash, gaps) and, for checked files, their ``format_code``; rendered
    captions keep the format by construction, and a candidate without any block fails with
    ``format_empty_caption``. Every joined table has one row per candidate.
    """
    return judge(candidates, (*sample_metrics(primary, secondary, keys), risk), captions, keys, bounds)


def sample_metrics(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, ...]:
    """The tables of transcript metrics the gate judges by, one row per sample each."""
    return transcript_metrics(primary, secondary, keys), longest_duplicate_run(primary, keys), confidence(secondary, keys)


def judge(
    candidates: DataFrame,
    parts: Sequence[DataFrame],
    captions: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """:func:`quality` from tables of metrics made before: those of :func:`sample_metrics` and the alignment summary."""
    joined = candidates
    for part in parts:
        joined = joined.join(part, list(keys), "left")
    if captions is not None:
        extra = [c for c in captions.columns if c not in joined.columns or c in keys]
        joined = joined.join(captions.select(extra), list(keys), "left")
    zero = {
        name: F.coalesce(name, F.lit(0))
        for name in (
            "primary_segments", "secondary_segments", "primary_chars", "secondary_chars",
            "checked_segments", "high_risk_count", "caption_count", "median_text_chars",
        )
    }
    minutes = F.col("duration_seconds") / F.lit(60.0)
    format_code = F.when(F.coalesce("caption_count", F.lit(0)) == 0, "empty_caption")
    if "format_code" in joined.columns:
        format_code = format_code.otherwise(F.col("format_code"))
    joined = joined.withColumn("format_code", format_code).withColumns(zero)
    joined = joined.withColumns(
        {
            "longest_duplicate_run": F.coalesce("longest_duplicate_run", F.lit(1)),
            "_timed": F.coalesce(F.col("duration_seconds") > 0, F.lit(False)),
        }
    )
    joined = joined.withColumns(
        {
            "density": F.when(F.col("_timed"), F.col("primary_chars") / minutes),
            "length_ratio": F.when(
                F.col("secondary_chars") > 0, F.col("primary_chars") / F.col("secondary_chars")
            ).otherwise(F.lit(float("inf"))),
            "minimum_segments": F.greatest(
                F.lit(bounds.min_segments), F.floor(F.coalesce(minutes, F.lit(0.0)) * bounds.segments_per_minute)
            ),
        }
    )
    d, r = F.col("density"), F.col("length_ratio")
    out = lambda c, lim: F.coalesce((c < lim[0]) | (c > lim[1]), F.lit(False))
    d_err, r_err = out(d, bounds.density_error), (r == float("inf")) | out(r, bounds.ratio_error)
    dup = F.col("longest_duplicate_run")
    errors = (
        (F.concat(F.lit("format_"), F.col("format_code")), F.col("format_code").isNotNull()),
        (F.lit("zero_duration"), ~F.col("_timed")),
        (F.lit("few_segments"), F.col("primary_segments") < F.col("minimum_segments")),
        (F.lit("density_error"), d_err),
        (F.lit("duplicate_error"), dup > bounds.duplicate_error),
        (F.lit("ratio_error"), r_err),
    )
    warnings = (
        (F.lit("density_warn"), ~d_err & out(d, bounds.density_warn)),
        (F.lit("duplicate_warn"), (dup <= bounds.duplicate_error) & (dup > bounds.duplicate_warn)),
        (F.lit("ratio_warn"), ~r_err & out(r, bounds.ratio_warn)),
        (
            F.lit("median_chars_warn"),
            F.col("format_code").isNull() & out(F.col("median_text_chars"), bounds.median_chars_warn),
        ),
        (F.lit("logprob_warn"), F.col("avg_logprob_min") < bounds.logprob_warn),
        (F.lit("no_speech_warn"), F.col("no_speech_prob_max") > bounds.no_speech_warn),
        (F.lit("high_risk_warn"), F.col("high_risk_count") > 0),
    )
    codes = lambda rules: F.array_compact(F.array(*[F.when(hit, code) for code, hit in rules]))
    return (
        joined.withColumn("errors", codes(errors))
        .withColumn("warnings", codes(warnings))
        .withColumns(
            {
                "passed": F.size("errors") == 0,
                "warning_count": F.size("warnings").cast("bigint"),
                "text_density_chars_per_minute": F.bround("density", 3),
                "text_length_ratio": F.when(r == float("inf"), r).otherwise(F.bround("length_ratio", 6)),
            }
        )
        .drop("_timed")
    )
