"""Snapshots compared by a tree of folder digests, read only where the digests differ.

A snapshot is stored as two tables: fingerprints of files, partitioned by a hash of their folder, and folders by depth.
A folder has a digest of its own files and one of everything below it. Both are sums over the files' hashes, so they
come from aggregates that reduce before the shuffle, however many files a folder holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.operators.snapshot import FIELDS, diff_full
from capsieve.session import materialize

BUCKETS = 64
#: Lanes of six hexadecimal digits: sums of 2^39 files fit a long.
LANES, DIGITS = 10, 6


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def _lanes() -> list[Column]:
    """Numbers cut from the hash of a file's path and fingerprint; fields that are null are told from all values."""
    parts = [F.col("path"), F.col("exists"), F.col("size"), F.unix_micros("mtime").alias("mtime"), F.col("sha256")]
    print_ = F.sha2(F.to_json(F.struct(*parts)), 256)
    return [F.conv(F.substring(print_, 1 + i * DIGITS, DIGITS), 16, 10).cast("bigint").alias(f"l{i}") for i in range(LANES)]


def _digest() -> Column:
    return F.sha2(F.concat_ws(",", "files", *[f"l{i}" for i in range(LANES)]), 256)


def folders(prints: DataFrame) -> DataFrame:
    """``folder, parent, depth, files, own, below``: digests of each folder's own files and of all files below it.

    Every folder on the way to the root (the empty path, depth 0, without parent) has a row.
    """
    sums = [F.sum(f"l{i}").alias(f"l{i}") for i in range(LANES)]
    placed = prints.filter("path IS NOT NULL").select(folder_of(F.col("path")).alias("folder"), *_lanes())
    own = materialize(placed.groupBy("folder").agg(F.count("*").alias("files"), *sums))
    names = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    spread = own.withColumn("above", F.explode(up))
    below = spread.groupBy(F.col("above").alias("folder")).agg(F.sum("files").alias("files"), *sums)
    parent = F.when(F.col("folder") != "", folder_of(F.col("folder")))
    return below.select("folder", parent.alias("parent"), (F.size(names) - 1).alias("depth"), "files", _digest().alias("below")).join(
        own.select("folder", _digest().alias("own")), "folder", "left"
    )


def store(prints: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Write a snapshot (``path, exists, size, mtime, sha256``) and its tree below ``root``.

    Paths are unique, as those of a listing; rows without path and further columns are left out. Range partitions spread
    a folder that holds most files over many tasks.
    """
    kept = prints.filter("path IS NOT NULL").select("path", *FIELDS).withColumn("folder", folder_of(F.col("path")))
    kept = kept.withColumn("bucket", F.pmod(F.xxhash64("folder"), F.lit(buckets)).cast("int"))
    kept.repartitionByRange("bucket", "path").write.partitionBy("bucket").parquet(f"{root}/files")
    tree = folders(prints)
    tree.repartitionByRange("depth", "folder").write.partitionBy("depth").parquet(f"{root}/folders")


def _tree(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("folder string, parent string, files bigint, below string, own string, depth int").parquet(f"{root}/folders")


def _files(spark: SparkSession, root: str) -> DataFrame:
    schema = "path string, exists boolean, size bigint, mtime timestamp, sha256 string, folder string, bucket int"
    return spark.read.schema(schema).parquet(f"{root}/files")


def changed_folders(spark: SparkSession, base: str, now: str) -> DataFrame:
    """``folder``: those whose own files differ. A level is read only below folders that differ on the level above."""
    trees = [_tree(spark, root) for root in (base, now)]
    found, frontier, depth = None, None, 0
    while True:
        sides = []
        for name, tree in zip(("base", "now"), trees):
            level = tree.filter(F.col("depth") == depth)
            if frontier is not None:
                level = level.join(frontier.select(F.col("folder").alias("parent")), "parent", "left_semi")
            sides.append(level.select("folder", F.col("own").alias(f"{name}_own"), F.col("below").alias(f"{name}_below")))
        both = sides[0].join(sides[1], "folder", "full").filter(~F.col("base_below").eqNullSafe(F.col("now_below")))
        frontier = materialize(both.select("folder", (~F.col("base_own").eqNullSafe(F.col("now_own"))).alias("own_differs")))
        if frontier.isEmpty() and found is not None:
            return found
        here = frontier.filter("own_differs").select("folder")
        found = here if found is None else found.unionByName(here)
        depth += 1


def diff(spark: SparkSession, base: str, now: str, buckets: int = BUCKETS) -> DataFrame:
    """``path, change``: files of the base that no longer match (``missing``, ``changed``) and new ones (``added``).

    ``missing`` and ``changed`` are the rows that :func:`snapshot.diff_full` doesn't match. Equal digests mean that all
    files of a folder match; where they differ the files are compared, so a base without hashes costs reading, not
    results. Only the partitions of folders that differ are read; their numbers, at most ``buckets``, are collected.
    """
    suspects = changed_folders(spark, base, now)
    bucket = F.pmod(F.xxhash64("folder"), F.lit(buckets)).cast("int")
    wanted = [r[0] for r in suspects.select(bucket.alias("bucket")).distinct().collect()]
    old, new = (
        _files(spark, root).filter(F.col("bucket").isin(wanted)).join(suspects, "folder", "left_semi").select("path", *FIELDS)
        for root in (base, now)
    )
    gone = F.when(F.col("exists") & ~F.col("now_exists"), "missing").otherwise("changed")
    lost = diff_full(old, new).filter("NOT matches").select("path", gone.alias("change"))
    return lost.unionByName(new.join(old, "path", "left_anti").select("path", F.lit("added").alias("change")))
