"""Language identification by a small convolutional network over bytes, trained in numpy.

Texts are lower-cased, encoded as UTF-8 and cut into windows of fixed length. Filters of several widths slide over a
window, the maximum of each is taken, and a softmax layer gives the languages' probabilities; a text's are the mean
over all its windows. As the input is bytes, a filter is a table of weights for each place and byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.llm.tables import packed, training_row

#: Bytes of a window, widths of the filters, filters of each width.
LENGTH, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The network learns from at most so many rows of each language, so many windows of each.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 400, 4
STEPS, BATCH, RATE = 400, 96, 0.01
UNKNOWN = "und"
#: Letters, and a few numbers that aren't decimal digits.
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def windows(data: bytes) -> np.ndarray:
    """All bytes, LENGTH a row, the last row filled up with zeros."""
    rows = -(-len(data) // LENGTH)
    return np.frombuffer(data.ljust(rows * LENGTH, b"\0"), np.uint8).reshape(rows, LENGTH)


class Network:
    """tables: for each width the weights (place, byte, filter); their sum at a position, its maximum over positions,
    a rectifier, and the output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.weights = {f"w{w}": rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.weights["b"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.weights["c"] = np.zeros(len(languages), np.float32)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross entropy over a batch."""
        n, p = len(x), self.weights
        tops, places = [], []
        for w in WIDTHS:
            z = sum(p[f"w{w}"][j][x[:, j : LENGTH - w + 1 + j]] for j in range(w))
            places.append(z.argmax(1))
            tops.append(np.take_along_axis(z, places[-1][:, None, :], 1)[:, 0])
        pooled = np.concatenate(tops, 1) + p["b"]
        hidden = np.maximum(pooled, 0)
        logits = hidden @ p["out"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        back = (prob @ p["out"].T) * (pooled > 0)
        grads = {"out": hidden.T @ prob, "c": prob.sum(0), "b": back.sum(0)}
        for i, w in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(p[f"w{w}"])
            for j in range(w):
                seen = np.take_along_axis(x, places[i] + j, 1)
                np.add.at(grad[j], (seen, np.arange(FILTERS)[None, :]), own)
            grads[f"w{w}"] = grad
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam over batches in which each language has the same share."""
        rng = np.random.default_rng(seed)
        own = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        each = max(1, BATCH // len(own))
        for t in range(1, STEPS + 1):
            pick = np.concatenate([rng.choice(rows, each) for rows in own])
            for k, g in self.step(x[pick], y[pick]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                rate = RATE * (1 - t / (STEPS + 1))
                self.weights[k] -= (rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def prepared(self) -> Network:
        """With tables over byte pairs: one look-up instead of two."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        t2, t3, t4 = (self.weights[f"w{w}"] for w in WIDTHS)
        self.pairs = pair(t2[0], t2[1]), pair(t3[0], t3[1]), pair(t4[0], t4[1]), pair(t4[2], t4[3])
        self.single = t3[2]
        return self

    def predict(self, x: np.ndarray, rows: int = 128) -> np.ndarray:
        """Probabilities of each window's languages."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), rows):
            part = np.ascontiguousarray(x[at : at + rows].T)
            pair = part[:-1].astype(np.int32) * 256 + part[1:]
            z2 = self.pairs[0][pair].max(0)
            z3 = self.pairs[1][pair[:-1]]
            z3 += self.single[part[2:]]
            z4 = self.pairs[2][pair[:-2]]
            z4 += self.pairs[3][pair[2:]]
            hidden = np.maximum(np.concatenate([z2, z3.max(0), z4.max(0)], 1) + self.weights["b"], 0)
            logits = hidden @ self.weights["out"] + self.weights["c"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + rows] = prob / prob.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability of each text; ``und`` and 0 for null and for texts without a letter."""
        out, held, owner = [(UNKNOWN, 0.0)] * len(texts), [], []
        for i, t in enumerate(texts):
            if t and has_letter(t):
                held.append(windows(t.lower().encode("utf-8", "replace")))
                owner.append(i)
        if held and self.languages:
            prob = self.predict(np.concatenate(held))
            ends = np.cumsum([len(h) for h in held])
            starts = np.concatenate([[0], ends[:-1]])
            mean = np.add.reduceat(prob.astype(np.float64), starts, 0) / np.diff(ends, prepend=0)[:, None]
            for i, m in zip(owner, mean):
                k = int(m.argmax())
                out[i] = self.languages[k], min(1.0, float(m[k]))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Network:
    """A network from a bounded sample: of each language the ROWS_PER_LANGUAGE training rows with the least hash of the
    id, and of each row WINDOWS_PER_ROW windows at even distances. Rows with null text, language or id aren't used."""
    usable = training_row(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()
    rows = docs.where(usable).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Only the ids whose hash is small enough are ranked: about four times the rows wanted of each language.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each label
    if not counts:
        return Network([]).prepared()
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4 * ROWS_PER_LANGUAGE / n)))])
    small = (F.xxhash64("id") / 2.0**64 + 0.5) <= F.element_at(share, F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.where(small).select("id", "lang").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= ROWS_PER_LANGUAGE)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, language, t in zip(batch["id"], batch["lang"], batch["text"]):
                if has_letter(t):
                    x = windows(t.lower().encode("utf-8", "replace"))
                    picks = np.unique(np.linspace(0, len(x) - 1, WINDOWS_PER_ROW).astype(int))
                    out.append((language, i, x[picks].tobytes()))
            yield pd.DataFrame(out, columns=["lang", "id", "x"])

    # Ids and languages only: at most ROWS_PER_LANGUAGE rows for each language.
    small = F.broadcast(chosen.select("id", "lang"))
    found = sorted(map(tuple, rows.join(small, ["id", "lang"], "left_semi").mapInPandas(cut, "lang string, id long, x binary").collect()))
    languages = sorted({r[0] for r in found})
    net = Network(languages)
    if languages:
        x = [np.frombuffer(r[2], np.uint8).reshape(-1, LENGTH) for r in found]
        y = np.repeat([languages.index(r[0]) for r in found], [len(p) for p in x])
        net.fit(np.concatenate(x), y)
    return net.prepared()


def identify(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with ``lang_pred`` and ``score``, from the whole text and nothing else.

    Null texts and texts without a letter (any script) give ``und`` and 0; so does everything if nothing was learned.
    Repeated rows give repeated results, an empty table none; columns with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few megabytes, fixed by the constants above
    rows = docs.select(packed(docs, "lang_pred", "score").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame(shared.value.texts(batch["text"].tolist()), columns=["lang_pred", "score"])
            yield pd.concat([batch[["row"]], found], axis=1)

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInPandas(run, schema).select("row.*", "lang_pred", "score")
