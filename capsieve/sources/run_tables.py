"""Per-sample tables of runs, stored so that joins and merges on the sample need no shuffle.

A table is bucketed and sorted by (run, sample). Tables of the same number of buckets join bucket by bucket. A merge
appends the new rows under the next version, to the buckets they fall in; readers take the latest version of each
sample inside its bucket; :func:`compact` writes what they see as a new table. One writer at a time merges a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capsieve.session import shared_dir
from capsieve.sources.store import Folder

KEYS = ("run_id", "sample_id")
BUCKETS = 64
VERSION = "_version"


def _write(rows: DataFrame, name: str, keys: Sequence[str], buckets: int, mode: str, path: str | None = None) -> None:
    # One file for each bucket that has rows: tasks and buckets are dealt by the same hash.
    dealt = rows.repartition(buckets, *keys).write.format("parquet").mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (dealt.option("path", path) if path else dealt).saveAsTable(name)


def create(rows: DataFrame, keys: Sequence[str] = KEYS, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Store ``rows`` as version 0 of a new table in the shared folder; its name."""
    name = name or f"capsieve_{uuid.uuid4().hex}"
    path = f"{shared_dir(rows.sparkSession)}/{name}"
    _write(rows.withColumn(VERSION, F.lit(0).cast("bigint")), name, keys, buckets, "errorifexists", path)
    return name


def _bucketing(spark: SparkSession, name: str) -> tuple[list[str], int]:
    """The columns a table is bucketed by and the number of buckets, from the catalog."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    return [c.strip(" `") for c in about["Bucket Columns"].strip("[]").split(",")], int(about["Num Buckets"])


def merge(rows: DataFrame, name: str) -> None:
    """``rows`` replace all rows of the same samples, others stay; only the new rows are written.

    A column the table lacks is an error; one that ``rows`` lack is null. Rows of one sample within ``rows`` all stay.
    No rows change nothing.
    """
    spark = rows.sparkSession
    stored = spark.table(name)
    keys, buckets = _bucketing(spark, name)
    unknown = set(rows.columns) - (set(stored.columns) - {VERSION})
    if unknown:
        raise ValueError(f"no such columns in {name}: {sorted(unknown)}")
    latest = stored.agg(F.max(VERSION)).first()[0]
    columns = [
        F.lit((-1 if latest is None else latest) + 1).cast("bigint").alias(VERSION) if f.name == VERSION
        else (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in stored.schema.fields
    ]
    _write(rows.select(columns), name, keys, buckets, "append")


def read(spark: SparkSession, name: str) -> DataFrame:
    """The rows of each sample's latest version. The window finds its samples inside their buckets."""
    keys, _ = _bucketing(spark, name)
    newest = Window.partitionBy(*keys).orderBy(F.desc(VERSION))
    stored = spark.table(name)
    return stored.withColumn("_age", F.rank().over(newest)).filter("_age = 1").drop("_age", VERSION)


def compact(spark: SparkSession, name: str) -> str:
    """A new table of the latest rows alone; the old one stays for those who read it."""
    keys, buckets = _bucketing(spark, name)
    return create(read(spark, name), keys, buckets)


def drop(spark: SparkSession, name: str) -> None:
    """Remove a table and its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    Folder(spark, shared_dir(spark)).remove(name)
