"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Each window of a text is compressed
with both; where the toxic dictionary saves bytes, the window resembles toxic text. A document's largest and summed
savings go through calibrated weights to a score.

Toxic documents are mostly ordinary text, so the toxic dictionary is trained on the fragments that set them apart:
beginnings and ends of words, and whole words, that occur beside many different words in toxic rows, and hardly in
others. (Counting different neighbours keeps copied passages from passing for evidence.) A word is a run of letters;
what stands between spaces with digits or signs inside, as in ``1d10t``, is taken whole as well. Phrases, and words
inside scripts without spaces, are no fragments of their own. The ordinary dictionary is common to both
sides of the comparison, which cancels what has nothing to do with the labels.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.llm.tables import packed, training_row

#: Training rows of each label, by least hash of the id.
TOXIC_ROWS, ORDINARY_ROWS = 1000, 2000
#: Bytes after which a window ends with its word; a word that is longer fills windows of its own.
WINDOW = 96
#: Windows of the ordinary rows, at random, that the ordinary dictionary is trained on.
ORDINARY_WINDOWS = 40_000
#: Size of the ordinary dictionary, and a search that reaches all of both: tables larger than they, lazy matching.
ORDINARY_BYTES = 16_384
SEARCH = {"window_log": 16, "hash_log": 16, "chain_log": 16, "search_log": 5, "min_match": 4, "target_length": 32, "strategy": 5}
#: Fragments are beginnings of at least so many characters, and at most so many.
SHORT, LONG = 4, 12
#: Different predecessors that a fragment needs, and how much more frequent it must be in toxic rows.
SUPPORT, LIFT = 4, 3
WORD = re.compile(r"[^\W\d_]+")
#: Letters and digits with digits or signs between them, without signs around.
MIXED = re.compile(r"[^\W_](?:\S*[^\W_])?")
FEATURES = ("largest", "second", "several", "rate", "excess")


def windows(text: str) -> list[bytes]:
    """The whole lower-cased text in pieces of about WINDOW bytes, cut before spaces where there are any."""
    data = text.lower().encode("utf-8", "replace")
    n = len(data)
    if not n:
        return []
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    cuts = np.arange(WINDOW, n, WINDOW)
    if len(spaces) and len(cuts):
        after = np.searchsorted(spaces, cuts)
        near = spaces[np.minimum(after, len(spaces) - 1)]
        cuts = np.unique(np.where((after < len(spaces)) & (near - cuts < WINDOW), near, cuts))
    edges = [0, *cuts.tolist(), n]
    return [data[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def contexts(texts: Iterable[str]) -> tuple[dict[str, int], int]:
    """After how many different words each fragment occurs, and the number of words of letters."""
    seen: dict[str, set[int]] = defaultdict(set)
    total = 0
    for t in texts:
        words = WORD.findall(t.lower())
        total += len(words)
        for before, word in zip(["", *words], words):
            key = zlib.crc32(before.encode())
            for k in range(SHORT, min(len(word), LONG) + 1):
                seen[word[:k]].add(key)
            seen[word + " "].add(key)
        before = ""
        for word in MIXED.findall(t.lower()):
            if len(word) >= SHORT and not word.isalpha():
                key = zlib.crc32(before.encode())
                for k in range(SHORT, min(len(word), LONG) + 1):
                    if not word[:k].isalpha():
                        seen[word[:k]].add(key)
                seen[word + " "].add(key)
            before = word
    return {w: len(s) for w, s in seen.items()}, total


def fragments(toxic: tuple[dict[str, int], int], ordinary: tuple[dict[str, int], int]) -> dict[str, int]:
    """Fragments that set toxic rows apart, each as long as most of its occurrences allow, with their support."""
    (own, n), (other, m) = toxic, ordinary
    if not n:
        return {}

    def apart(w: str, c: int) -> bool:
        z = other.get(w, 0)
        sure = c - 2.5 * c**0.5  # what is left of c after good luck
        return c >= SUPPORT and sure * (m or n) > LIFT * n * (z + 2 * z**0.5 + 1)

    kept = {w: c for w, c in own.items() if apart(w, c)}
    stems = {w: c for w, c in kept.items() if not any(w[:k] in kept for k in range(SHORT, len(w)))}
    longer = defaultdict(list)
    for w in own:
        if len(w) > SHORT:
            longer[w[:-1]].append(w)
    out = {}
    for w, c in stems.items():
        while True:
            more = max(longer.get(w, []), key=lambda x: (own[x], x), default=None)
            if more is None or own[more] < 0.7 * c:
                break
            w = more
        out[w] = c
    return out


def ends(toxic: list[str], ordinary: list[str], begun: dict[str, int]) -> dict[str, int]:
    """Fragments as the text read backwards gives them, without what the fragments ``begun`` cover."""
    found = fragments(contexts(t[::-1] for t in toxic), contexts(t[::-1] for t in ordinary))
    turned = {w[::-1].strip(): c for w, c in found.items()}
    known = [w.strip() for w in begun]
    return {w: c for w, c in turned.items() if not any(w in k or k in w for k in known)}


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary; samples that are too few to train on are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Model:
    """Both dictionaries and the calibrated weights."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        found = fragments(contexts(toxic), contexts(ordinary))
        # An end is written with the space after it, a beginning with that before it.
        found = {" " + w: c for w, c in found.items()} | {w + " ": c for w, c in ends(toxic, ordinary, found).items()}
        written = sorted(found, key=lambda w: (found[w], w))
        self.words = [w.removeprefix(" ") for w in written]
        rng = np.random.default_rng(3)
        pool = [w for t in ordinary or toxic for w in windows(t)]
        pool = [pool[i] for i in rng.permutation(len(pool))[:ORDINARY_WINDOWS]]
        self.ordinary = trained(pool, ORDINARY_BYTES) if pool else b""
        each = [w.encode() for w in written for _ in range(4 + min(96, found[w] // 8))]
        each = [each[i] for i in rng.permutation(len(each))]
        groups = [b"".join(each[i : i + 8]) for i in range(0, len(each), 8)]
        whole = b"".join(w.encode() for w in written)
        # Training must have room for every fragment; what it leaves out, rare fragments, stands before it.
        self.toxic = whole + trained(groups * 4, max(512, 2 * len(whole))) if self.words else b""
        self.weights = np.zeros(len(FEATURES) + 1)
        self.middle, self.scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
        self.pair = None
        self.usual = 0.0
        if toxic and ordinary:
            flat = [w for t in ordinary for w in windows(t)]
            self.usual = float(sum(s for s in self.savings(flat) if s >= 2)) / len(flat) if flat else 0.0
            x = self.features(toxic + ordinary)
            y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
            self.calibrate(x, y)
        else:
            self.weights[-1] = 2.0 if toxic else -2.0

    def __getstate__(self):
        return {**self.__dict__, "pair": None}

    def compressors(self):
        import zstandard as z

        if self.pair is None:
            made = []
            # A filler instead of the toxic content keeps all other distances, and so their cost, the same.
            for content in (self.ordinary + b"\0" * len(self.toxic), self.ordinary + self.toxic):
                rules = z.ZstdCompressionParameters(
                    format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH
                )
                own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
                made.append(z.ZstdCompressor(compression_params=rules, dict_data=own))
            self.pair = made
        return self.pair

    def savings(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        import zstandard as z

        size = np.array([len(p) for p in pieces], np.uint64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.uint64)
        held = z.BufferWithSegments(b"".join(pieces), np.stack([start, size], 1).tobytes())
        one, two = (c.multi_compress_to_buffer(held) for c in self.compressors())
        return np.array([len(a) - len(b) for a, b in zip(one, two)], float)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES of each text, from all of its windows: the largest and second largest saving, the sum of savings
        of two bytes or more, that per window, and its excess over the usual sum against the root of the windows."""
        cut = [windows(t) if t else [] for t in texts]
        flat = [w for c in cut for w in c]
        all_ = self.savings(flat) if flat else np.zeros(0)
        out, at = np.zeros((len(texts), len(FEATURES))), 0
        for i, c in enumerate(cut):
            if c:
                s = all_[at : at + len(c)]
                at += len(c)
                top = np.sort(np.append(s, 0.0))[-2:]
                several = s[s >= 2].sum()
                out[i] = top[1], top[0], np.log1p(several), several / len(c), (several - self.usual * len(c)) / len(c) ** 0.5
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic weights, both labels weighing the same; Newton steps with a ridge."""
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - self.middle) / self.scale, np.ones((len(x), 1))])
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(hess, z.T @ (weight * (p - y)) + 1e-3 * w)
        self.weights = w

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.middle) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from a bounded sample: the TOXIC_ROWS toxic and ORDINARY_ROWS other training rows with the least hash of
    their ids. Rows without id, label or text aren't used; of repeated rows all are."""
    rows = labels.where(training_row(F.col(doc_id))).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64("id"), F.col("id")
    few = [rows.where(F.col("label") == k).distinct().orderBy(*order).limit(n) for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    chosen = F.broadcast(few[0].union(few[1]))  # ids and labels, as many rows as the two constants say
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    found = sorted((r["id"], r["label"], r["text"]) for r in texts.join(chosen, "id").toLocalIterator())
    return Model([t for _, k, t in found if k == 1], [t for _, k, t in found if k == 0])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from the whole text alone.

    Null and empty texts have no window and get the score of a text without savings. Repeated rows give repeated
    results, an empty table none; columns with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    rows = docs.select(packed(docs, "score", "predicted").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = shared.value.scores(batch["text"].tolist())
            yield pd.DataFrame({"row": batch["row"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInPandas(run, schema).select("row.*", "score", "predicted")
