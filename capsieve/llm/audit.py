"""Filter interaction audit over a sparse document-term matrix.

Documents are tokenised in shards. A shard is a matrix in compressed sparse row form whose columns are the shard's own
words; the words of all shards are numbered together, the global dictionary, and the numbers of a shard's words turn its
columns into global ones. Row sums and nonzero counts of the matrix decide the filters on the number of words and on their
repetition. The other filters look at characters and at equal texts. What the filters do to each other in any order
follows from the number of documents by the set of filters they fail.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.llm.tables import shuffle_partitions
from capsieve.session import materialize

#: Bytes of text from which a shard is closed; its words and numbers stay in one task.
SHARD_BYTES = 12_000_000
#: The filters in their order; filter i has bit i.
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"

SHARD = pa.schema(
    [
        ("shard", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        ("part", pa.list_(pa.string())),
        ("digest", pa.list_(pa.binary())),
        ("shouting", pa.list_(pa.bool_())),
        ("signs", pa.list_(pa.bool_())),
        ("indptr", pa.binary()),
        ("indices", pa.binary()),
        ("counts", pa.binary()),
        ("words", pa.list_(pa.binary())),
    ]
)
SHARD_DDL = (
    "shard long, doc_id array<long>, part array<string>, digest array<binary>, shouting array<boolean>, "
    "signs array<boolean>, indptr binary, indices binary, counts binary, words array<binary>"
)
MATRIX = pa.schema([f for f in SHARD if f.name != "words"])
MATRIX_DDL = SHARD_DDL.removesuffix(", words array<binary>")


def squeeze(values: np.ndarray) -> bytes:
    """Numbers with the equal-weight bytes of all of them side by side, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Shard:
    """Rows of a matrix that is being built, with the shard's own dictionary."""

    def __init__(self) -> None:
        self.size = 0
        self.meta: dict[str, list] = {k: [] for k in ("doc_id", "part", "digest", "shouting", "signs")}
        self.index: dict[bytes, int] = {}
        self.lengths: list[int] = []
        self.indices: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, part: str | None, digest: bytes, text: bytes) -> None:
        found = Counter(text.split())  # of bytes: the white space of ASCII, just what separates words
        index, place = self.index, self.index.setdefault
        self.indices += [place(w, len(index)) for w in found]
        self.counts += found.values()
        self.lengths.append(len(found))
        raw = np.frombuffer(text, np.uint8)
        capitals = np.count_nonzero(raw - np.uint8(65) < 26)
        points = np.count_nonzero((raw & 0xC0) != 0x80)
        for k, v in zip(self.meta, (doc_id, part, digest, 100 * capitals > 2 * points, any(s in text for s in SIGNS))):
            self.meta[k].append(v)
        self.size += len(text) + 64

    def row(self, number: int) -> pa.RecordBatch:
        indptr = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        arrays = (indptr, np.array(self.indices, np.int32), np.array(self.counts, np.int32))
        blobs = dict(zip(("indptr", "indices", "counts"), map(squeeze, arrays)))
        values = {"shard": number, **self.meta, **blobs, "words": list(self.index)}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in values.items()}, SHARD)


def tokenised(docs: DataFrame, part: str, text: str, doc_id: str) -> DataFrame:
    """Shards of documents with columns of their own; written out, as their numbers depend on the reading."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(part).cast("string").alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        body.cast("binary").alias("text"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 33, Shard()
        for batch in batches:
            for values in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                shard.add(*values)
                if shard.size >= SHARD_BYTES:
                    yield shard.row(number)
                    number, shard = number + 1, Shard()
        if shard.size:
            yield shard.row(number)

    return materialize(rows.mapInArrow(build, SHARD_DDL))


def numbered(shards: DataFrame) -> DataFrame:
    """Each word of each shard (``of_shard``, ``place``) with ``block`` and ``word_no``, its number among the block's words.

    Words are dealt over blocks and sorted there, so equal ones stand together; a word has a row for each shard it is in,
    however often it occurs. ``word`` is given at its first row only.
    """
    words = shards.select(F.col("shard").alias("of_shard"), F.posexplode("words").alias("place", "word"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(2).dictionary_encode()  # in the order of appearance
            goes_on = last is not None and known.dictionary[0].as_py() == last
            number = known.indices.to_numpy().astype(np.int64) + seen - goes_on
            first = np.diff(number, prepend=seen - 1) > 0
            last, seen = known.dictionary[-1].as_py(), int(number[-1]) + 1
            word = pc.if_else(pa.array(first), batch.column(2), pa.scalar(None, pa.binary()))
            blocks = pa.array(np.full(len(number), block, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), blocks, pa.array(number), word], names=["of_shard", "place", "block", "word_no", "word"]
            )

    dealt = words.repartition(shuffle_partitions(shards.sparkSession), "word").sortWithinPartitions("word")
    return materialize(dealt.mapInArrow(number, "of_shard long, place int, block int, word_no long, word binary"))


def columns(numbers: DataFrame) -> DataFrame:
    """``numbers`` with ``word_id``, 0, 1, ... without gaps over all words; where ``word`` isn't null, the dictionary.

    The broadcast offsets hold one row per shuffle partition.
    """
    offsets, total = [], 0
    for block, n in numbers.groupBy("block").agg(F.max("word_no") + 1).orderBy("block").collect():
        offsets.append((block, total))
        total += n
    table = numbers.sparkSession.createDataFrame(offsets, "block int, offset long")
    return numbers.join(F.broadcast(table), "block").withColumn("word_id", F.col("offset") + F.col("word_no"))


def matrix(docs: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The document-term matrix of ``docs``, one row per shard.

    ``indptr``, ``indices`` and ``counts`` are the shard's rows in compressed sparse row form (see :func:`unsqueeze`;
    int64, ``counts`` int32), ``indices`` those of the global dictionary. ``doc_id``, ``part``, ``digest`` (SHA-256 of the text),
    ``shouting`` and ``signs`` have one value for each row of the matrix. A shard has some 12 MB of text, or one
    document.
    """
    shards = tokenised(docs, part, text, doc_id)
    known = columns(numbered(shards)).select("of_shard", "place", "word_id")

    def encode(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:
            return MATRIX.empty_table()
        column = np.empty(known.num_rows, np.int64)
        column[known["place"].to_numpy()] = known["word_id"].to_numpy()
        local = unsqueeze(own["indices"][0].as_py(), np.int32)
        blob = pa.array([squeeze(column[local])], pa.binary())
        return own.set_column(own.column_names.index("indices"), MATRIX.field("indices"), blob)

    rows = shards.drop("words").groupBy("shard").cogroup(known.groupBy("of_shard"))
    return rows.applyInArrow(encode, MATRIX_DDL)


def failures(terms: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` and ``failed`` (bits of A to D) of each row of the matrix."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                indptr, counts = unsqueeze(row["indptr"], np.int64), unsqueeze(row["counts"], np.int32)
                before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                words, distinct = np.diff(before[indptr]), np.diff(indptr)
                failed = (words < 200) + 2 * (100 * distinct < 50 * words)
                failed = failed + 4 * np.array(row["shouting"], bool) + 8 * np.array(row["signs"], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(row["part"], pa.string()),
                        pa.array(row["digest"], pa.binary()),
                        pa.array(failed.astype(np.int32)),
                    ],
                    names=["doc_id", "part", "digest", "failed"],
                )

    return terms.mapInArrow(look, "doc_id long, part string, digest binary, failed int")


def histogram(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents (``n``), those labelled good and toxic, by ``part`` and the set ``failed`` of filters they fail.

    Null text counts as empty, a null or empty part as ''. A row without id is not a copy of any other and has no
    label. Of several label rows of an id, one that says 1 is enough.
    """
    rows = materialize(failures(matrix(docs, part, text, doc_id)))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(c)
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    judged = rows.join(said, "doc_id", "left").join(firsts.drop("n"), "digest", "left")
    return (
        judged.withColumn("failed", F.col("failed") + copy)
        .groupBy(F.coalesce("part", F.lit("")).alias("part"), "failed")
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter, set of the filters before it) for all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(FILTERS[j] for j in order), step, i, before))
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What each filter does at each step of each order, for each part.

    Columns: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost``, ``shapley``. An empty table gives no rows, a part always all 600. Very long texts
    are whole rows of a shard; repeated rows count each; columns besides the named ones are not read.
    """
    by_part = (
        histogram(docs, labels, part, text, doc_id)
        .groupBy("part")
        .agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))  # at most 32
    )
    every = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))

    def passing(kind: str) -> Column:
        """Documents that pass all filters of a set, for each set."""
        return F.transform(
            every,
            lambda s: F.aggregate(
                "sets", F.lit(0).cast("long"), lambda total, x: total + F.when(x["failed"].bitwiseAND(s) == 0, x[kind]).otherwise(0)
            ),
        )

    def only(i: int) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda total, x: total + F.when(x["failed"] == 1 << i, x["n"]).otherwise(0))

    def shapley(i: int) -> Column:
        """Removed at any place: a set comes before the filter in as many orders as it and the rest can be ordered."""
        rest = [s for s in range(1 << len(FILTERS)) if not s >> i & 1]
        weight = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum((F.lit(weight(s)) * (F.col("n")[s] - F.col("n")[s | 1 << i]) for s in rest), F.lit(0).cast("long"))

    counted = by_part.select("part", *[passing(k).alias(k) for k in ("n", "good", "toxic")], F.array(*map(only, range(len(FILTERS)))).alias("only"))
    with_all = counted.withColumn("shapley", F.array(*map(shapley, range(len(FILTERS)))))
    table = " ".join("/".join(map(str, x)) for x in steps())  # one literal: quick to analyse
    cell = F.split(F.col("at"), "/")
    row = with_all.withColumn("at", F.explode(F.split(F.lit(table), " "))).select(
        *with_all.columns, cell[0].alias("filter_order"), *[cell[k].cast("int").alias(c) for k, c in enumerate(("step", "i", "before"), 1)]
    )
    bit = F.expr("shiftleft(1, i)")
    after = F.col("before") + bit
    lost = lambda kind: F.col(kind)[F.col("before")] - F.col(kind)[after]
    return row.select(
        "part",
        "filter_order",
        "step",
        F.col("n")[after].alias("kept"),
        lost("n").alias("removed"),
        (F.col("n")[0] - F.col("n")[bit] - lost("n")).alias("redundant"),
        F.col("only")[F.col("i")].alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("shapley")[F.col("i")].alias("shapley"),
    )
