"""Corpus profile: exact quantiles and rank correlation of quality metrics, overall and by length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.operators.ordering import running_totals

PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
NAMES = ("min", "p10", "p25", "p50", "p75", "p90", "max")

# Upper bounds of the length buckets in seconds.
BUCKETS = ((60, "under_1m"), (300, "1m_to_5m"), (1200, "5m_to_20m"), (10_800, "20m_to_3h"))
LONGEST = "over_3h"


def length_bucket(seconds: Column) -> Column:
    """The bucket of a duration; bounds belong to the bucket below, except the shortest."""
    label = F.when(seconds < BUCKETS[0][0], BUCKETS[0][1])
    for bound, name in BUCKETS[1:]:
        label = label.when(seconds <= bound, name)
    return label.otherwise(LONGEST)


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").filter(
        "value IS NOT NULL"
    )


def quantiles(rows: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation per group, from the distinct values and their counts.

    Equal values are counted before they are sorted, so a value that most rows share weighs as one row. The
    aggregation at the end keeps the values at the wanted ranks; no group is gathered.
    """
    counted = rows.groupBy(*groups, value).agg(F.count("*").alias("_count"))
    summed = running_totals(counted, [*[F.col(g) for g in groups], F.col(value)], "_count", "_before")
    sizes = summed.groupBy(*groups).agg(F.sum("_count").alias("n"), F.min("_before").alias("_first"))
    placed = summed.join(sizes, list(groups)).withColumn("_rank", F.col("_before") - F.col("_first"))
    at = lambda q: (F.col("n") - 1) * q
    held = lambda rank: (F.col("_rank") <= rank) & (rank < F.col("_rank") + F.col("_count"))
    take = lambda rank: F.max(F.when(held(rank), F.col(value)))
    spot = lambda q: (
        take(F.floor(at(q))) + (take(F.ceil(at(q))) - take(F.floor(at(q)))) * (F.max(at(q)) - F.max(F.floor(at(q))))
    )
    return placed.groupBy(*groups).agg(F.max("n").alias("n"), *[spot(q).alias(name) for q, name in zip(PROBABILITIES, NAMES)])


def quantiles_approx(rows: DataFrame, groups: Sequence[str], value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """Sketch-based quantiles in one aggregation, for when exact ranks are not needed."""
    spots = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.percentile_approx(value, list(PROBABILITIES), accuracy).alias("_q")
    )
    return spots.select(*groups, "n", *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(NAMES)])


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of ``value``; equal values share the mean of their ranks.

    Ranks come from the distinct values; the join back has one row for each on its side.
    """
    counted = rows.groupBy(value).agg(F.count("*").alias("_count"))
    summed = running_totals(counted, [F.col(value)], "_count", "_before")
    shared = summed.select(value, (F.col("_before") + (F.col("_count") + 1) / 2).alias(name))
    return rows.join(shared, value)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns, one row."""
    pairs = rows.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    ranked = average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry")
    return ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def corpus_profile(reports: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count and seven quantiles per metric."""
    return quantiles(melt(reports, [], metrics), ["metric"])


def profile_by_bucket(reports: DataFrame, metrics: Sequence[str], duration: str = "duration_seconds") -> DataFrame:
    """The same per length bucket."""
    bucketed = reports.withColumn("bucket", length_bucket(F.col(duration)))
    return quantiles(melt(bucketed, ["bucket"], metrics), ["bucket", "metric"])
