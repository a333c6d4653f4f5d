"""Substring dedup with a count-min prefilter.

First pass: each task counts the anchors of all its word windows in a count-min sketch; the sketches are merged. A window's
anchor is the least hash of the runs of half its words inside it. Equal windows have equal anchors, and neighbours mostly
share theirs, so there are some 13 times fewer of them than windows. A cell counts at least as often as any anchor in it,
so a window whose anchor's cell stayed at one occurs once. Second pass: only the windows estimated as repeated are
grouped exactly, by 128-bit digests of their words, and none that is repeated is lost. What a document shares with a
document of a smaller id is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsieve.llm import countmin
from capsieve.llm.tables import text_numbers, with_text_number
from capsieve.llm.wordhash import A, mix, pack, pack_sorted, runs, starts_of_runs, together, unpack, unpack_sorted, word_hashes
from capsieve.session import materialize

#: Size up to which the places to remove are broadcast; beyond, texts are joined with them by shuffle.
BROADCAST_BYTES = 64 << 20
#: Anchors that a task counts at a time.
COUNTED = 1_000_000


def lowest(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return h[:0]
    width, count = 1, len(h) - n + 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:count], h[n - width : n - width + count])


def spanned(size: int) -> int:
    """How many runs of half its words a window holds."""
    return size - (size + 1) // 2 + 1


def window_hashes(texts: list[str | None], size: int, lanes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For groups of texts: number of the first text, and for each window its text, its place among the text's words,
    its anchor, and its hashes."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in together(data):
        borders, words = word_hashes(data[a:b], max(1, lanes))
        at, text = starts_of_runs(borders, size)
        # The least of many hashes are small numbers: they are spread anew.
        anchor = mix(lowest(runs(words[0], (size + 1) // 2), spanned(size))[at] + A)
        yield a, text, at - borders[:-1][text], anchor, [runs(h, size)[at] for h in words[:lanes]]


def anchors(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Anchors of the windows, once for neighbours of one text that share theirs, some COUNTED at a time."""
    held, count = [], 0
    for _, text, _, anchor, _ in window_hashes(texts, size, 0):
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(anchor)]
        held.append(anchor[new])
        count += len(held[-1])
        if count > COUNTED:
            yield np.concatenate(held)
            held, count = [], 0
    if held:
        yield np.concatenate(held)


def ask(size: int, bits: int, sketch, shards: int):
    """Windows estimated as repeated, packed by shard of their digest. Of equal ones in a group of texts only that of
    the least id is asked about; the others have a smaller document in sight and are reported at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, numbers = batch["doc_id"].to_numpy(np.int64), batch["text_no"].to_numpy(np.int32)
            for first, text, place, anchor, (h, g) in window_hashes(batch["text"].tolist(), size, 2):
                near = np.flatnonzero(countmin.estimated(anchor, bits, sketch))
                if not len(near):
                    continue
                h, g, place, row = h[near], g[near], place[near].astype(np.int32), first + text[near]
                order = np.lexsort((place, ids[row], g, h))
                h, g, place, row = h[order], g[order], place[order], row[order]
                doc, no = ids[row], numbers[row]
                start = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                least = doc[np.flatnonzero(start)][np.cumsum(start) - 1]
                told = doc > least
                out = []
                if told.any():
                    out.append((int(doc[0]) % shards, True, b"", b"", pack(doc[told]), pack(no[told]), pack(place[told])))
                h, g, place, doc, no = h[~told], g[~told], place[~told], doc[~told], no[~told]
                cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
                out += [(s, False, pack_sorted(h[i:j]), pack(g[i:j]), pack(doc[i:j]), pack(no[i:j]), pack(place[i:j])) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                yield pd.DataFrame(out, columns=["shard", "told", "high", "low", "ids", "numbers", "places"])

    return run


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Places of the windows of a shard that also start in a document of a smaller id, by document and text."""
    told = rows["told"].to_numpy(bool)
    asked = rows[~told]
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    h, g = join((unpack_sorted(x, "<u8") for x in asked["high"]), "<u8"), join((unpack(x, "<u8") for x in asked["low"]), "<u8")
    doc = join((unpack(x, "<i8") for x in asked["ids"]), "<i8")
    no, place = (join((unpack(x, "<i4") for x in asked[c]), "<i4") for c in ("numbers", "places"))
    order = np.lexsort((doc, g, h))
    h, g, doc, no, place = h[order], g[order], doc[order], no[order], place[order]
    start = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])[: len(h)]
    least = doc[np.flatnonzero(start)][np.cumsum(start) - 1] if len(h) else doc
    far = doc > least
    more = {c: [unpack(x, kind) for x in rows.loc[told, c]] for c, kind in (("ids", "<i8"), ("numbers", "<i4"), ("places", "<i4"))}
    doc, no, place = (np.concatenate([x[far], *y]) for x, y in zip((doc, no, place), more.values()))
    order = np.lexsort((place, no, doc))
    doc, no, place = doc[order], no[order], place[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (no[1:] != no[:-1])])[: len(doc)])
    return pd.DataFrame({"doc_id": doc[at], "text_no": no[at], "places": pd.Series(np.split(place, at[1:]) if len(at) else [], dtype=object)})


def ranges(size: int):
    """Ranges of words that the windows of a document cover."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            starts, ends = [], []
            for p in batch["places"]:
                p = np.unique(p)
                gap = np.flatnonzero(np.diff(p) > size)
                starts.append(p[np.concatenate([[0], gap + 1])])
                ends.append(p[np.concatenate([gap, [len(p) - 1]])] + size)
            yield pd.DataFrame({"doc_id": batch["doc_id"].tolist(), "text_no": batch["text_no"].tolist(), "starts": pd.Series(starts, dtype=object), "ends": pd.Series(ends, dtype=object)})

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by one space) of every row.

    Words are runs without space, tab, line feed, vertical tab, form feed and return, unchanged. A window is ``size``
    words of one document. Each word goes that a window covers whose words also start in a document of a smaller id;
    windows are judged on the input. Null and empty texts have no words. Rows that repeat an id don't count against
    each other; rows without id keep all words. An empty table gives no rows; other columns aren't carried. Texts that
    share an id lose their own words only.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = with_text_number(rows, text_numbers(rows))
    named = rows.where("doc_id IS NOT NULL")
    length = countmin.length(named)
    # Of n runs in a window, about two of n + 1 windows begin a new anchor; the sketch has ten cells for each, or as many as it may.
    bits, sketch = countmin.repeated(named, 6 * length // (spanned(size) + 1), lambda texts: anchors(texts, size))
    packed = "shard int, told boolean, high binary, low binary, ids binary, numbers binary, places binary"
    asked = named.mapInPandas(ask(size, bits, sketch, countmin.shards(length)), packed)
    found = asked.groupBy("shard").applyInPandas(answer, "doc_id long, text_no int, places array<int>")
    # A list for each text and shard; all lists of a text together are no longer than it.
    whole = found.groupBy("doc_id", "text_no").agg(F.flatten(F.collect_list("places")).alias("places"))
    gone = materialize(whole.mapInPandas(ranges(size), "doc_id long, text_no int, starts array<int>, ends array<int>"))
    countmin.forget(sketch)
    weight = gone.agg(F.sum(F.lit(64).cast("long") + 8 * F.size("starts"))).first()[0] or 0
    held = rows.join(F.broadcast(gone) if weight <= BROADCAST_BYTES else gone, ["doc_id", "text_no"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, t, starts, ends in zip(batch["doc_id"], batch["text"], batch["starts"], batch["ends"]):
                words = (t or "").encode("utf-8", "replace").split()
                n = len(words)
                if starts is not None:
                    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), n]
                    words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                out.append((d, n, n - len(words), b" ".join(words).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"], dtype=object)

    return held.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string")
