"""Exact top-k by inner product with vector-approximation files.

Candidates are stored twice: whole, and as small cells, a few bits for each component, in blocks with a grid of their
own. A scan of the cells gives an upper and a lower bound of each score; each task keeps the k largest lower bounds of a
query over all its blocks. The k-th largest of all rules out most candidates in a second scan of the cells, which alone
hands on pairs. The whole vectors of those are read in the order of their bounds, the k best first, then those that the
k-th score so far can't rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.llm.tables import shuffle_partitions
from capsieve.session import materialize

#: Bits of a cell, rows of a block of candidates and of a block of queries.
BITS, ROWS, QUERY_ROWS = 6, 2048, 512
#: Query blocks whose lower bounds a task holds before it hands them on (20 kB each for k = 5).
HELD_BLOCKS = 2000
#: Pairs of a query and a candidate for one task, and tasks of a small job; bytes of queries that a task keeps at hand.
TASK_PAIRS, LEAST_TASKS, HELD_QUERIES = 1 << 27, 32, 16 << 20


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if a component is null or not finite, or the vector is null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.when(~F.coalesce(bad, F.lit(True)), whole)


def cells(rows: int = ROWS):
    """Blocks of candidates of one dimension: ids, cells (a byte each), and the grid's origin and step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["vector"].map(len)
            for dim, group in batch.groupby(size, sort=True):
                for at in range(0, len(group), rows):
                    part = group.iloc[at : at + rows]
                    x = np.array(part["vector"].tolist(), np.int64).reshape(len(part), dim)
                    low = x.min(0) if dim else np.zeros(0, np.int64)
                    step = (x.max(0) - low) // (1 << BITS) + 1 if dim else low
                    ids = part["vec_id"].to_numpy(np.int64)
                    yield pd.DataFrame(
                        [(dim, int(ids[0]), ids.tobytes(), ((x - low) // step).astype(np.uint8).tobytes(), low.tobytes(), step.tobytes())],
                        columns=["dim", "first", "ids", "cells", "low", "step"],
                    )

    return run


def estimates(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a block of candidates and of queries, the middle of each pair's bounds (-inf for the query's own id), and half their width by query."""
    ids, asked = np.frombuffer(r.ids, np.int64), np.frombuffer(r.query_ids, np.int64)
    q = np.frombuffer(r.queries, r.kind).reshape(len(asked), r.dim).astype(float)
    low, step = np.frombuffer(r.low, np.int64), np.frombuffer(r.step, np.int64)
    half = (step - 1) / 2
    centre = np.frombuffer(r.cells, np.uint8).reshape(len(ids), r.dim) * step + (low + half)
    middle = q @ centre.T
    # The last two terms cover rounding of large products.
    slack = (np.abs(q) @ half)[:, None] + 1e-12 * (np.abs(q) @ np.abs(centre).max(0))[:, None] + 1e-6
    middle[asked[:, None] == ids[None, :]] = -np.inf
    return ids, asked, middle, slack


def largest(k: int):
    """The ``k`` largest lower bounds of each query over all blocks of candidates that a task meets."""

    def rows(held: dict) -> Iterator[pd.DataFrame]:
        for asked, best in held.values():
            i, j = np.nonzero(best > -np.inf)
            yield pd.DataFrame({"query_id": asked[i], "lower": best[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                _, asked, middle, slack = estimates(r)
                lower = middle - slack
                if r.block in held:
                    lower = np.hstack([held[r.block][1], lower])
                if lower.shape[1] > k:
                    lower = np.partition(lower, -k, 1)[:, -k:].copy()
                held[r.block] = asked, lower
                if len(held) >= HELD_BLOCKS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return run


def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose upper bound reaches the query's k-th largest lower bound."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids, asked, middle, slack = estimates(r)
            upper = middle + slack
            i, j = np.nonzero((upper >= np.frombuffer(r.least, float)[:, None]) & (middle > -np.inf))
            if len(i):
                yield pd.DataFrame({"query_id": asked[i], "vec_id": ids[j], "upper": upper[i, j]})


def query_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of queries of one dimension: ids, vectors in the narrowest integers that hold them and the kind of those, the score that counts, and a
    hash that names the block."""
    for batch in batches:
        for dim, group in batch.groupby(batch["vector"].map(len), sort=True):
            for at in range(0, len(group), QUERY_ROWS):
                part = group.iloc[at : at + QUERY_ROWS]
                x = np.array(part["vector"].tolist(), np.int64).reshape(len(part), dim)
                ids, least = part["vec_id"].to_numpy(np.int64).tobytes(), part["least"].to_numpy(float).tobytes()
                name = hashlib.blake2b(ids + x.tobytes(), digest_size=16).digest()
                low, high = (x.min(), x.max()) if x.size else (0, 0)
                kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                yield pd.DataFrame([(dim, name, ids, kind, x.astype(kind).tobytes(), least)], columns=["dim", "block", "query_ids", "kind", "queries", "least"])


def grid(pairs: int, candidate_bytes: int, query_bytes: int, slots: int) -> tuple[int, int]:
    """Over how many slots candidates are dealt, and over how many groups queries.

    Each slot meets each group in a task of its own, so candidates are copied for each group and queries for each slot.
    The number of tasks follows the pairs, not the partitions, and they are cut so that the least bytes are copied;
    a group of queries stays small enough to be kept at hand.
    """
    tasks = max(min(slots, LEAST_TASKS), -(-pairs // TASK_PAIRS))
    groups = max(1, round((tasks * query_bytes / max(1, candidate_bytes)) ** 0.5), -(-query_bytes // HELD_QUERIES))
    return -(-tasks // groups), groups


def bounds(candidates: DataFrame, asked: DataFrame, k: int, rows: int = ROWS) -> DataFrame:
    """``query_id, vec_id, upper``: the pairs that can be among the ``k`` best, all ties included.

    Their number depends on the vectors, not on how candidates are cut into blocks or dealt over tasks.
    """
    parts = shuffle_partitions(candidates.sparkSession)
    (n, size), (m, wide) = (df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first() for df in (candidates, asked))
    slots, groups = grid(n * m, 8 * n + size, 16 * m + 2 * wide, parts)
    blocks = candidates.mapInPandas(cells(rows), "dim int, first long, ids binary, cells binary, low binary, step binary")
    blocks = materialize(blocks.withColumn("slot", F.pmod(F.xxhash64("first", "dim"), F.lit(slots))))

    def each(count: int) -> Column:
        return F.explode(F.sequence(*(F.lit(i).cast("long") for i in (0, count - 1))))

    def met(queries: DataFrame) -> DataFrame:
        """Each block of queries beside each block of candidates.

        The planner sees the queries before they are copied for the slots, so it would take them for small: they are
        kept from being broadcast.
        """
        wanted = queries.coalesce(parts).mapInPandas(query_blocks, "dim int, block binary, query_ids binary, kind string, queries binary, least binary")
        wanted = wanted.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn("slot", each(slots))
        return blocks.withColumn("group", each(groups)).join(wanted.hint("merge"), ["slot", "group", "dim"])

    lowest = met(asked.withColumn("least", F.lit(0.0))).mapInPandas(largest(k), "query_id long, lower double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    lowest = lowest.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k)
    reach = lowest.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("least"))
    reach = materialize(reach.select("vec_id", F.when(F.col("n") == k, F.col("least")).otherwise(float("-inf")).alias("least")))
    # A query without any bound has no candidates.
    return met(asked.join(reach, "vec_id")).mapInPandas(within, "query_id long, vec_id long, upper double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` candidates of the largest inner product with each query.

    Both tables have ``vec_id`` (long) and ``vector`` (array of long). Ties go to the smaller vec_id. A candidate with
    the query's own id takes no part; nor do rows without id or vector. Only vectors of one dimension are compared;
    a query without candidates has no rows, one with fewer than ``k`` has all. Rows that repeat id and vector count
    once. Scores must fit a long. Other columns are left out; empty tables give no rows.

    Of equal vectors only the k + 1 smallest ids can be among the results of any query, so large groups of copies
    shrink to those before anything is compared. Each block of queries meets each block of candidates twice, for the
    k-th largest lower bound and for the pairs that reach it.
    """
    usable = "vec_id IS NOT NULL AND vector IS NOT NULL"
    same = Window.partitionBy("vector").orderBy("vec_id")
    distinct = vectors.where(usable).select("vec_id", "vector").withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    candidates = materialize(distinct.select("vec_id", "vector").distinct())
    asked = materialize(queries.where(usable).select("vec_id", "vector").distinct())

    by_query = Window.partitionBy("query_id")
    near = bounds(candidates, asked, k)
    near = materialize(near.select("query_id", "vec_id", "upper", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id")).alias("turn")))

    def read(pairs: DataFrame) -> DataFrame:
        both = pairs.join(candidates, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
        products = F.zip_with("query", "vector", lambda a, b: a * b)
        both = both.where(F.size("query") == F.size("vector"))
        return both.select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))

    first = materialize(read(near.where(F.col("turn") <= k)))
    certain = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    certain = certain.select("query_id", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(float("-inf")).alias("least"))
    later = read(near.where(F.col("turn") > k).join(certain, "query_id").where("upper >= least"))
    ranked = first.union(later).withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
