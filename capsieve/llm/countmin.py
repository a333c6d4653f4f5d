"""Which hashes of a corpus may occur more than once: count-min sketches of all tasks, merged.

A cell counts at least as often as any hash in it, so a hash whose cell stayed at one occurs once. Counts above two
aren't told apart. The estimate errs on one side only: it calls no repeated hash single.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsieve.llm.wordhash import pack_sorted, unpack_sorted
from capsieve.session import materialize

#: Bits of a cell's number: a bit for each cell is sent to the executors, 128 MB at most, whatever the input. Beyond
#: some hundred million hashes the estimate lets more and more through.
LEAST_BITS, MOST_BITS = 20, 30
#: Bytes of text whose hashes make one part of their range, and the least number of parts. A task holds a part unpacked: some
#: 2.5 million hashes with what belongs to them, should all of them be repeated.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 24
#: Hashes that are looked up at a time, as what a look-up needs is larger than they are.
LOOKED_UP = 1 << 18
#: Cells of a part of the sketch, as a power of two: the driver fetches and sends one part (16 MB) after the other.
PART_BITS = 27
#: Cells of a piece of the sketch, as a power of two.
PIECE_BITS = 20


def cells(hashes: Callable[[list[str | None]], Iterable[np.ndarray]], bits: int):
    """Sketch of each group of hashes, by piece: cells seen, and cells seen twice or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h in hashes(batch["text"].tolist()):
                cell = np.sort((h >> np.uint64(64 - bits)).astype(np.uint32))
                if not len(cell):
                    continue
                new = np.concatenate([[True], cell[1:] != cell[:-1]])
                seen = cell[new]
                twice = np.unique(cell[~new])
                edges = np.arange((1 << (bits - PIECE_BITS)) + 1, dtype=np.uint64) << np.uint64(PIECE_BITS)
                cut, again = np.searchsorted(seen, edges), np.searchsorted(twice, edges)
                low = np.uint32((1 << PIECE_BITS) - 1)
                yield pd.DataFrame(
                    [(p, pack_sorted(seen[i:j] & low), pack_sorted(twice[k:m] & low)) for p, (i, j, k, m) in enumerate(zip(cut, cut[1:], again, again[1:])) if j > i],
                    columns=["piece", "seen", "twice"],
                )

    return run


def merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One piece of the merged sketch: a bit for each cell that was seen twice or more."""
    seen, twice = np.zeros(1 << PIECE_BITS, bool), np.zeros(1 << PIECE_BITS, bool)
    for s, t in zip(rows["seen"], rows["twice"]):
        cell = unpack_sorted(s, "<u4")
        twice[cell[seen[cell]]] = True
        seen[cell] = True
        twice[unpack_sorted(t, "<u4")] = True
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [np.packbits(twice).tobytes()]})


def length(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def shards(length: int) -> int:
    """Into how many parts to cut a hash range for texts of so many bytes: their number follows the input, not the
    partitions, as a document's hashes come back once from each part."""
    return max(LEAST_SHARDS, length // SHARD_BYTES)


def repeated(
    docs: DataFrame, length: int, hashes: Callable[[list[str | None]], Iterable[np.ndarray]]
) -> tuple[int, list[Broadcast]]:
    """Bits of a cell's number, and the merged sketch of the hashes of all rows' ``text``: a bit for each cell, in parts
    that are broadcast one by one, so the driver never holds the whole."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(length // 2).bit_length()))
    pieces = docs.select("text").mapInPandas(cells(hashes, bits), "piece int, seen binary, twice binary")
    # Merged by all tasks before the first part is fetched, which else would compute it alone.
    merged = materialize(pieces.groupBy("piece").applyInPandas(merge, "piece int, bits binary"))
    part_bits = max(PIECE_BITS, min(bits, PART_BITS))
    count, each = 1 << (part_bits - PIECE_BITS), (1 << PIECE_BITS) // 8
    parts = []
    for first in range(0, 1 << (bits - PIECE_BITS), count):
        out = np.zeros(count * each, np.uint8)
        for r in merged.where((F.col("piece") >= first) & (F.col("piece") < first + count)).coalesce(1).toLocalIterator():
            at = (r["piece"] - first) * each
            out[at : at + each] = np.frombuffer(r["bits"], np.uint8)
        parts.append(docs.sparkSession.sparkContext.broadcast(out))
    return bits, parts


def forget(sketch: list[Broadcast]) -> None:
    """Free the memory of a sketch that nothing reads any more."""
    for part in sketch:
        part.destroy()


def estimated(h: np.ndarray, bits: int, sketch: list[Broadcast]) -> np.ndarray:
    """Which hashes may be repeated."""
    out, each = np.zeros(len(h), bool), len(sketch[0].value)
    for start in range(0, len(h), LOOKED_UP):
        cell = h[start : start + LOOKED_UP] >> np.uint64(64 - bits)
        byte, bit = (cell >> np.uint64(3)).astype(np.int64), 7 - (cell & np.uint64(7)).astype(np.uint8)
        of = byte // each
        for i, part in enumerate(sketch):
            at = np.flatnonzero(of == i)
            out[start + at] = part.value[byte[at] - i * each] >> bit[at] & 1
    return out
