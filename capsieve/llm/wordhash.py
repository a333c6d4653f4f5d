"""Words of many texts at once: their places, 64-bit hashes, hashes of runs of words, and packed lists of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard

#: Texts are handled together up to so many bytes; a longer text is handled alone.
TOGETHER = 4_000_000
#: Words longer than this are hashed by blake2b.
LONG_WORD = 64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= B
    h ^= h >> np.uint64(27)
    h *= C
    h ^= h >> np.uint64(31)
    return h


def together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list[bytes], lanes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Borders of the texts in the sequence of all words, and the words' hashes, an array for each lane.

    A word is a run without space, tab, line feed, vertical tab, form feed and return.
    """
    data = b" ".join(texts) + b" " * 9
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    blank = SPACES[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    borders = np.concatenate([np.searchsorted(start, begin), [len(start)]])
    length = end - start
    chunks = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
    keep = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
    out = [np.full(len(start), s, np.uint64) ^ (length.astype(np.uint64) * A) for s in SEEDS[:lanes]]
    done, rest = 0, np.arange(len(start))
    rest = rest[length <= LONG_WORD]
    while len(rest):
        part = chunks[start[rest] + done] & keep[np.minimum(length[rest] - done, 8)]
        for h in out:
            h[rest] = mix((h[rest] + A) ^ part * C)
        done += 8
        rest = rest[length[rest] > done]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), "<u8")
        for h, d in zip(out, digest):
            h[i] = d
    return borders, out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes, by doubling; len(h) - k + 1 of them."""
    whole, width, offset = None, 1, 0
    power = h
    while True:
        if k & width:
            part = power[offset : len(h) - k + 1 + offset] if len(h) >= k else power[:0]
            whole = part.copy() if whole is None else mix(whole * A + part)
            offset += width
        width *= 2
        if width > k:
            return mix(whole + np.uint64(k))
        power = mix(power[: len(power) - width // 2] * C + power[width // 2 :]) if len(power) > width // 2 else power[:0]


def starts_of_runs(borders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where k words of one text start, and the text's number."""
    count = np.maximum(np.diff(borders) - k + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
    return np.arange(count.sum()) - before[text] + borders[:-1][text], text


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of integers, plane by plane; ascending 64-bit values as differences."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the least node that each is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new
