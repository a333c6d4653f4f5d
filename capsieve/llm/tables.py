"""Small helpers that the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.operators.ordering import number_in_groups
from capsieve.session import materialize

#: Rows of one Arrow batch; texts are long, so the default of 10,000 would make large batches.
BATCH_ROWS = "2000"
BATCH_BYTES = "16m"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Keep the batches that go to Python small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else; null stays null."""
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def training_row(doc_id: Column) -> Column:
    """Rows that a classifier may learn from: crc32 of the id as text, modulo 5, is not 0. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def packed(docs: DataFrame, *made: str) -> Column:
    """All columns but those an operator makes itself, in one struct: names inside can't clash with the operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in {m.lower() for m in made}])


def kept_in_worker(name: str, key: str, make: Callable):
    """An object kept while a Python worker lives, one for each name: made anew when the key is another.

    Functions travel by value, so the globals of a module start anew with each task. Modules stay, so it is held in one.
    """
    holder = sys.modules.setdefault(name, ModuleType(name))
    if getattr(holder, "key", None) != key:
        holder.held = None
        holder.held, holder.key = make(), key
    return holder.held


def text_numbers(rows: DataFrame) -> DataFrame | None:
    """doc_id, digest and text_no (1, 2, ...) of the texts of all ids that name more than one text; None without any.

    ``rows`` have doc_id and text. An id may name any number of them: they are numbered without gathering an id's rows.
    """
    digests = rows.where("doc_id IS NOT NULL").select("doc_id", text_digest(F.col("text")).alias("digest"))
    several = digests.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most")
    several = materialize(several.select("doc_id"))
    if not several.limit(1).count():
        return None
    return materialize(number_in_groups(digests.join(several, "doc_id", "left_semi").distinct(), ["doc_id"], [F.col("digest")], "text_no"))


def with_text_number(rows: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """``rows`` with ``text_no``: 0 where the id has one text."""
    if numbers is None:
        return rows.withColumn("text_no", F.lit(0))
    found = rows.withColumn("digest", text_digest(F.col("text"))).join(numbers, ["doc_id", "digest"], "left")
    return found.withColumn("text_no", F.coalesce(F.col("text_no").cast("int"), F.lit(0))).select(*rows.columns, "text_no")


def text_digest(text: Column) -> Column:
    """Null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)
