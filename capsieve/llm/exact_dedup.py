"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised bytes, each partition is sorted externally, equal texts then
stand next to each other, and full comparisons of neighbours (the window's group test) find the groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsieve.llm.tables import ascii_lower, packed, shuffle_partitions
from capsieve.session import materialize

#: Characters of the text that the splitters see. Ties go on by hash, so a shared head doesn't fill a partition, and
#: the sample that reaches the driver is small however long the texts are. The sort compares whole texts.
HEAD = 32
MADE = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_largest: bool = True, normalise=ascii_lower
) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text).

    Texts are equal when their normalised bytes are; null counts as empty. Of equal texts one row is kept, that with
    the largest id (the smallest, if ``keep_largest`` is false); of repeated rows with that id, one. A null id loses
    to any other. An empty table gives no rows. Columns with the names made here are replaced, others carried.

    A group that exceeds half a partition's share of the bytes is dealt over slots by id, and its winner comes from a
    pre-aggregated full comparison, so no task holds a whole large group. There are at most two such groups a
    partition; that bounds the two tables that are broadcast.
    """
    n = shuffle_partitions(docs.sparkSession)
    best = F.max if keep_largest else F.min
    rows = docs.select(packed(docs, *MADE).alias("row"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = rows.withColumn("hash", F.xxhash64(normalise(F.col("text"))))

    weight = (F.octet_length("text") + 64).cast("long")
    half = max(1, (rows.agg(F.sum(weight)).first()[0] or 0) // (2 * n))
    groups = hashed.groupBy("hash").agg(F.sum(weight).alias("bytes"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(groups.where("n > 1"))
    large = repeated.where(F.col("bytes") > half).select("hash", F.ceil(F.col("bytes") / half).alias("slots"))

    slot = F.when(F.col("slots").isNotNull(), F.pmod(F.xxhash64("id"), F.col("slots"))).otherwise(F.lit(0))
    dealt = (
        hashed.join(F.broadcast(large), "hash", "left")
        .withColumn("slot", slot)
        .withColumn("head", F.substring(normalise(F.col("text")), 1, HEAD))
        .repartitionByRange("head", "hash", "slot")
        .withColumn("norm", normalise(F.col("text")))
        .drop("text")
    )
    group = Window.partitionBy("head", "hash", "slot", "norm")
    order = F.col("id").desc_nulls_last() if keep_largest else F.col("id").asc_nulls_last()
    found = dealt.select(
        "row",
        "id",
        F.col("slots").isNotNull().alias("large"),
        F.row_number().over(group.orderBy(order)).alias("place"),
        best("id").over(group).alias("best"),
        F.count(F.lit(1)).over(group).alias("size"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    whole = (
        hashed.join(F.broadcast(large), "hash")
        .groupBy(normalise(F.col("text")).alias("norm"))
        .agg(best("id").alias("whole_best"), F.count(F.lit(1)).alias("whole_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "whole_best", "whole_size", F.lit(True).alias("large"))
    )
    joined = found.join(F.broadcast(whole), ["text_sha256", "large"], "left")
    keep = F.when(F.col("whole_size").isNull(), F.col("best")).otherwise(F.col("whole_best"))
    return joined.select(
        "row.*",
        keep.alias("keep_id"),
        F.coalesce("whole_size", "size").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )
