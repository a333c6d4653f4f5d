"""Packing into optimal length buckets.

Documents are cut into sequences of at most ``max_length`` tokens, so the global histogram of lengths has at most that
many rows. Dynamic programming over it chooses the bucket boundaries with the least padding. Inside a bucket,
sequences form batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.session import materialize

#: Full batches that a shard of a bucket has on average; at most one batch of a shard isn't full.
BATCHES = 64
SCHEMA = "doc_id long, n_tokens long, part int, start long, length int, bucket int, bucket_length int, shard int, batch int"


def words(text: Column) -> Column:
    """Number of words, runs without space, tab, line feed, vertical tab, form feed or return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Largest lengths of at most ``buckets`` buckets whose total padding is the least; ``lengths`` ascend.

    A bucket pads each sequence to its largest length. best[j] is the least padding of the first j lengths.
    """
    m = len(lengths)
    if not m:
        return []
    number = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    # padding[i, j]: of one bucket with lengths i up to j - 1
    padding = lengths[None, :].astype(np.int64) * (number[None, 1:] - number[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    far = np.int64(2) ** 62
    padding[np.tril_indices(m, -1)] = far
    best = np.concatenate([[0], np.full(m, far)])
    cuts = []
    for _ in range(min(buckets, m)):
        total = np.minimum(best[:-1, None], far - padding) + padding
        cut = total.argmin(0)
        best = np.concatenate([[0], total[cut, np.arange(m)]])
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j - 1])
    return out[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    doc_id: str = "doc_id",
    max_length: int = 2048,
    buckets: int = 8,
    budget: int = 16_384,
) -> DataFrame:
    """One row for each sequence: doc_id, n_tokens (of the document), part, start, length, bucket, bucket_length, shard, batch.

    ``length`` counts a document's tokens (default: words of ``text``). Sequence ``part`` has ``length`` tokens from
    token ``start`` on. A batch is (bucket, shard, batch); it holds at most ``budget`` tokens padding included, one
    sequence at least. A document without tokens (null or empty text) has one row with length 0 and no bucket.
    Repeated rows are packed as often as they occur; an empty table gives no rows. Other columns aren't carried.

    A bucket may hold nearly all sequences: it is dealt over shards of about ``BATCHES`` batches by hash, and only
    inside a shard are sequences numbered.
    """
    if max_length < 1 or buckets < 1 or budget < 1:
        raise ValueError("max_length, buckets and budget must be positive")
    counted = materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (words(F.col("text")) if length is None else length).cast("long").alias("n_tokens")))
    last = F.greatest(F.ceil(F.col("n_tokens") / max_length) - 1, F.lit(0)).cast("int")
    start = F.col("part").cast("long") * max_length
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    parts = parts.select("*", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(max_length)).cast("int").alias("length"))
    seen = sorted(parts.where("length > 0").groupBy("length").count().collect())  # at most max_length rows
    lengths, counts = (np.array([r[i] for r in seen], np.int64) for i in (0, 1))
    tops = boundaries(lengths, counts, buckets)
    if not tops:
        empty = [F.lit(None).cast("int").alias(c) for c in ("bucket", "bucket_length", "shard", "batch")]
        return parts.select("*", *empty)
    held = np.bincount(np.searchsorted(tops, lengths), weights=counts, minlength=len(tops))
    room = [max(1, budget // top) for top in tops]
    shards = [max(1, round(float(h) / (r * BATCHES))) for h, r in zip(held, room)]

    def of(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("bucket"))

    bucket = F.when(F.col("length") == 0, None)
    for place, top in enumerate(tops):
        bucket = bucket.when(F.col("length") <= top, place)
    dealt = parts.withColumn("bucket", bucket).withColumn("bucket_length", of(tops))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), of(shards)).cast("int"))
    # Documents without tokens have no shard; they are spread by their id and not numbered.
    spread = F.when(F.col("bucket").isNull(), F.pmod(F.xxhash64("doc_id"), F.lit(1024))).otherwise(F.col("shard"))
    place = F.row_number().over(Window.partitionBy("bucket", spread).orderBy("doc_id", "part")) - 1
    return dealt.withColumn("batch", F.when(F.col("bucket").isNotNull(), F.floor(place / of(room)).cast("int")))
