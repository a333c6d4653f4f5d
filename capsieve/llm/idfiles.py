"""Token ids in binary files with fixed-width bit packing.

A file holds whole documents in ascending order of their ids. All numbers are little-endian:

    magic      8 bytes, ``IDPACK01``
    blocks     ``block`` ids each (the last one fewer); id k of a block has the bits from k * width on, the least
               significant one first; a block ends at a multiple of 8 bytes
    documents  int64 ids, then uint64 positions of their ends among the file's ids, then a byte each: 1 for a null id
    offsets    uint64 for each block, and one more for the end: bytes from the start of the file
    trailer    see ``TRAILER``; then a line feed

``width`` is the least number of bits that holds every id of the vocabulary. As it is fixed, the block and the bits of
any id follow from its position; numpy unpacks any stretch at once. Files are written and read by Spark, so they may be
in any store that Spark reaches, and are put in place by Spark's commit.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.llm.tables import kept_in_worker, shuffle_partitions
from capsieve.session import materialize, shared_dir

MAGIC = b"IDPACK01"
#: width, vocabulary, ids of a full block, shard, documents, ids, blocks, ids of the shard before the file, offset of
#: the documents, offset of the offsets, magic.
TRAILER = "<IIIIQQQQQQ8s"
#: Ids of a block; ids from which a file is closed after the current document.
BLOCK, FILE_IDS = 65_536, 16_000_000
#: Words whose ids a worker remembers.
REMEMBERED = 800_000

FOUND = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Bits of the ids one after the other, filled up to 8 bytes."""
    words = -(-len(ids) * width // 64)
    if width in (8, 16, 32):  # the same bits
        return ids.astype(f"<u{width // 8}").tobytes().ljust(8 * words, b"\0")
    at = np.arange(len(ids), dtype=np.int64) * width
    word, shift, ids = at >> 6, (at & 63).astype(np.uint64), ids.astype(np.uint64)
    out = np.zeros(words + 1, np.uint64)
    np.bitwise_or.at(out, word, ids << shift)
    over = shift + np.uint64(width) > 64
    np.bitwise_or.at(out, word[over] + 1, ids[over] >> (np.uint64(64) - shift[over]))
    return out[:words].astype("<u8").tobytes()


def unpack(block: bytes | memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(block, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    words = np.append(np.frombuffer(block, "<u8"), np.uint64(0))
    at = np.arange(start, stop, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return ((words[word] >> shift | high) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Builds one file; ids are packed block by block as they come."""

    def __init__(self, vocabulary: int, shard: int, before: int):
        self.vocabulary, self.width = vocabulary, width_of(vocabulary)
        self.shard, self.before = shard, before
        self.parts, self.offsets = [MAGIC], [len(MAGIC)]
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_ids += len(ids)
        self.docs.append(doc_id)
        self.ends.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            self.flush(self.n_waiting // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for i in range(0, upto, BLOCK):
            self.parts.append(pack(ids[i : min(i + BLOCK, upto)], self.width))
            self.offsets.append(self.offsets[-1] + len(self.parts[-1]))
        self.waiting = [ids[upto:]]
        self.n_waiting = len(ids) - upto

    def close(self) -> bytes:
        """The file but for its line feed, which the writer of lines adds."""
        self.flush(self.n_waiting)
        docs = np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.ends, "<u8").tobytes()
        docs += bytes(d is None for d in self.docs)
        at = self.offsets[-1]
        sizes = (len(self.docs), self.n_ids, len(self.offsets) - 1, self.before, at, at + len(docs))
        trailer = struct.pack(TRAILER, self.width, self.vocabulary, BLOCK, self.shard, *sizes, MAGIC)
        return b"".join([*self.parts, docs, np.array(self.offsets, "<u8").tobytes(), trailer])


class Reader:
    """One file's bytes; ids are unpacked only where they are asked for."""

    def __init__(self, content: bytes):
        self.content = memoryview(content)
        end = len(content) - 1
        head = struct.unpack(TRAILER, self.content[end - struct.calcsize(TRAILER) : end])
        self.width, self.vocabulary, self.block, self.shard, docs, self.n_ids, blocks, self.before, at, table, magic = head
        if magic != MAGIC or self.content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self.doc_ids = np.frombuffer(content, "<i8", docs, at)
        self.ends = np.frombuffer(content, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.no_id = np.frombuffer(content, np.uint8, docs, at + 16 * docs)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, table).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at the positions ``start`` to ``stop`` of the file; only the blocks that hold them are touched."""
        out = []
        for k in range(start // self.block, -(-stop // self.block)):
            first = k * self.block
            block = self.content[self.offsets[k] : self.offsets[k + 1]]
            out.append(unpack(block, self.width, max(start - first, 0), min(stop - first, self.block, self.n_ids - first)))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


#: How a tokenizer must prepare text for its words to be encoded one by one: white space separates words and is dropped,
#: and no other rule looks across it. Fixed values of the library's format.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that NFC leaves alone where no mark follows, then signs of ASCII: the library cuts such a word between the two.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")
SIMPLE = re.compile(rf"({LETTERS.pattern})([!-/:-@\[-`{{-~]*)")


class Encoder:
    """The library's tokenizer; where its rules allow, each distinct word is encoded once and remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(spec)
        cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_words = (
            said.get("normalizer") == NORMALIZER
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PATTERN}, "Removed", True)
            and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
            and not any(re.search(r"\s", t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"])
            and not any(SIMPLE.fullmatch(t["content"]) for t in said["added_tokens"])
        )
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of letters in lower case, or of signs: one word to the model."""
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            spelt = text if text.isascii() else self.spell(text)[0][0]
            ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
            found = self.pieces[text] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def word(self, text: str) -> bytes:
        found = SIMPLE.fullmatch(text)
        letters = found[1].lower() if found else ""
        if not found or not (letters.isascii() or LETTERS.fullmatch(letters)):
            out = self.whole(text)
        else:
            out = self.piece(letters) + self.piece(found[2]) if found[2] else self.piece(letters)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[text] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if not self.by_words:
            return np.frombuffer(self.whole(text), "<u4")
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            known, word = self.known, self.word
            found = [f if f is not None else known.get(w) or word(w) for f, w in zip(found, words)]
        return np.frombuffer(b"".join(found), "<u4")


def encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer, kept while a worker lives."""
    return kept_in_worker("capsieve_encoder", spec, lambda: Encoder(spec))


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, text: str = "text", doc_id: str = "doc_id") -> str:
    """Encode whole texts and write them to files in a new folder, in ascending order of the documents' ids.

    ``tokenizer`` is the path of a file of the tokenizers library on the driver; it goes to the workers. The ids of a
    document end with ``end``. Null text counts as empty. Null ids come first; rows of one id keep the order in which
    they are read, and are dealt over partitions like others. Other columns are not read. An empty table gives an empty
    folder. The ranges of ids are the shards; a shard has as many files as its size asks for, each of at most some
    16 million ids or one document. Names sort by shard and file.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        vocabulary = max(own.tokenizer.get_vocab_size(), end + 1)
        shard, before, last = TaskContext.get().partitionId(), 0, np.array([end], np.uint32)
        writer = Writer(vocabulary, shard, before)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([writer.close()], pa.binary())], names=["file"])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                writer.add(i, np.concatenate([own.encode(t), last]))
                if writer.n_ids >= FILE_IDS:
                    before += writer.n_ids
                    yield row()
                    writer = Writer(vocabulary, shard, before)
        if writer.docs:
            yield row()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = (
        rows.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("id").asc_nulls_first(), "place")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "place")
        .select("id", "text")
    )
    files = dealt.mapInArrow(build, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``shard``, ``doc_id``, ``start_in_shard``, ``n_tokens`` and ``ids_crc32`` of the documents in the files.

    The checksum is that of the ids as unsigned 32-bit numbers. Ids are unpacked in stretches of some million.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = Reader(content.as_py())
                starts = np.concatenate([[0], file.ends[:-1]])
                sums, i = [], 0
                while i < len(starts):
                    j = max(i + 1, int(np.searchsorted(file.ends, starts[i] + 1_000_000, "right")))
                    ids = memoryview(file.ids(int(starts[i]), int(file.ends[j - 1])).astype("<u4").tobytes())
                    cuts = 4 * (np.append(starts[i:j], file.ends[j - 1]) - starts[i])
                    sums += [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    i = j
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), file.shard, np.int32)),
                        pa.array(file.doc_ids, mask=file.no_id.astype(bool)),
                        pa.array(starts + file.before),
                        pa.array(file.ends - starts),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(look, FOUND)


def with_starts(found: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32``.

    The broadcast offsets hold one row per shard, so one per shuffle partition of the writer.
    """
    fixed = materialize(found)
    sizes = fixed.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    offsets, total = [], 0
    for shard, n in sizes:
        offsets.append((shard, total))
        total += n
    table = found.sparkSession.createDataFrame(offsets, "shard int, offset long")
    start = (F.col("offset") + F.col("start_in_shard")).alias("start")
    return fixed.join(F.broadcast(table), "shard").select("doc_id", start, "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write ``docs`` to a folder of the shared one and read the files back; see :func:`write` and :func:`with_starts`."""
    spark = docs.sparkSession
    folder = write(docs, tokenizer, f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}", end)
    return with_starts(read(spark, folder))
