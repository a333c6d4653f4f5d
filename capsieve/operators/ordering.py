"""Ordered work without one task per group: global numbering, and lag / running sums in blocks.

A plain window over a key puts the whole key into one task. Here each key is cut into blocks of its
own order; a window runs per block, and what crosses a block border is carried by a table with one
row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.session import materialize

LOW_BITS = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """1-based rank in a total order.

    Range partitioning and a sort per partition give the order. The rows are written out with their
    partition and place, so that the counts and the numbers see the same ones. The offsets hold one
    row per shuffle partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_BITS)))
    )
    fixed = materialize(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def running_totals(df: DataFrame, order: Sequence[Column], weight: str, name: str = "total_before") -> DataFrame:
    """Sum of ``weight`` over all rows before each row of a total order; laid out as in :func:`number_rows`."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    fixed = materialize(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.sum(weight).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        fixed.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_own"))
        .drop("_part", "_own", "_offset")
    )


def number_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """1-based rank inside each group, taken from the global rank, so that a large group is split."""
    ranked = number_rows(df, [*[F.col(k) for k in keys], *order], "_rank")
    first = ranked.groupBy(*keys).agg(F.min("_rank").alias("_first"))
    return (
        ranked.join(first, list(keys))
        .withColumn(name, F.col("_rank") - F.col("_first") + 1)
        .drop("_rank", "_first")
    )


def lag_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    values: Sequence[str],
    name: str = "previous",
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Adds the struct of ``values`` of the preceding row; ``block`` must not decrease along ``order``.

    The columns of ``per_key`` (one row per key) come along by way of the block table, so that a large
    key is never joined in one piece; rows without a partner there are dropped.
    """
    cells = F.struct(*values)
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    tails = blocked.groupBy(*keys, "_block").agg(F.max_by(cells, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *keys, "_block", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    if per_key is not None:
        carried = carried.join(per_key, list(keys))
    return (
        blocked.withColumn("_lag", F.lag(cells).over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_lag", "_carry"))
        .drop("_block", "_lag", "_carry")
    )


def running_sum_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Adds, for each name, the sum of its value over all *earlier* rows of the key (0 for the first)."""
    blocked = df.withColumns({"_block": block, **{f"_v_{n}": c for n, c in sums.items()}})
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    carried = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    summed = blocked.withColumns(
        {f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}
    ).join(carried, [*keys, "_block"])
    return summed.withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in sums}).drop(
        "_block", *[f"_{p}_{n}" for p in "vic" for n in sums]
    )
