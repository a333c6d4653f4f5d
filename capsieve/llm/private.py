"""Personal data by weak supervision.

Candidate spans come from the base patterns and from looser ones. Labelers of three sorts (shape by regular
expression, word lists, context) vote on each candidate: for, against, or nothing. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is, without labels, and with that the probability of each
pattern; a logistic classifier trained on those probabilities decides over the span's features. Spans that match a
base pattern always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.llm.tables import packed

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive runs and look-behinds give the same matches in linear time.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Looser forms that only candidates take: spelt-out addresses, split numbers without a plus sign.
LOOSE = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?[A-Za-z0-9-]{1,63}"
        r"(?:(?:[\x20]?[\[({][\x20]?dot[\x20]?[\])}][\x20]?|\.)[A-Za-z0-9-]{1,63}){1,8}",
        re.IGNORECASE,
    ),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?[\[(]\.[\])][\x20]?[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9+.-])(?:\([0-9]{2,4}\)[\x20-]?|00[1-9][0-9]?[\x20-])[0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9.-])"
    ),
}
#: What a text must hold for a pattern to be worth a search.
DIGIT = re.compile(r"[0-9]")

# Word lists of the labelers.
CUES = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact", "kontakt", "contacto"),
    "ip": ("ip", "host", "server", "address", "addr", "ping", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "whatsapp", "cell"),
}
AGAINST = ("version", "isbn", "page", "section", "chapter", "figure", "table", "order", "serial", "sku", "build", "doi")
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us biz ch at ca au in nl it example".split())
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "2221", "34", "37", "6011", "65", "35", "30", "36", "38")
WINDOW = 40
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

LABELERS = ("shape", "checked", "listed", "cue", "counter_cue", "edges")
FEATURES = (*LABELERS, "split")
SPLIT = re.compile(r"[\s.()-]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def passes(kind: str, found: str) -> bool:
    """The checks that a match of a base pattern must pass."""
    if kind == "ip":
        return all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in found.split(".")))
    digits = digits_of(found)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern, from each @ outwards: linear where a plain search is not."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        floor = found.end() if found else at + 1
        if found:
            yield start, floor
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted."""
    spans = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for place, kind in enumerate(KINDS):
            if kind in BASE and (kind != "phone" or "+" in text):
                spans += [(m.start(), place, m.end()) for m in BASE[kind].finditer(text) if passes(kind, m[0])]
    return sorted(spans)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches of the looser patterns that touch no base span and no earlier one."""
    found = []
    numbers = bool(DIGIT.search(text))
    for place, kind in enumerate(KINDS):
        if numbers if kind != "email" else any(c in text for c in "[({"):
            found += [(m.start(), place, m.end()) for m in LOOSE[kind].finditer(text)]
    if not found:
        return []
    taken = sorted([(a, b) for a, _, b in base])
    out, end, i = [], 0, 0
    for a, k, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= end and not (i < len(taken) and taken[i][0] < b):
            out.append((a, k, b))
            end = b
    return out


def votes(text: str, kind: str, a: int, b: int) -> list[int]:
    """One vote for each of LABELERS: 1 for, -1 against, 0 nothing."""
    span = text[a:b]
    digits = digits_of(span)
    before = [w.lower() for w in WORD.findall(text[max(0, a - WINDOW) : a])]
    if kind == "email":
        name = re.split(r"[.\s\])}]+", span.strip())[-1].lower()
        shape = 1 if re.search(r"@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\Z", span) else -1 if re.search(r"\.\.", span) else 0
        checked = 1 if span.count("@") == 1 else 0
        listed = 1 if name in TOP_DOMAINS else -1
    elif kind == "ip":
        parts = [int(p) if len(p) <= 3 else 999 for p in re.findall(r"[0-9]+", span)]
        shape = 1 if len(parts) == 4 else -1
        checked = 1 if max(parts) <= 255 else -1
        listed = -1 if parts[0] == 0 or parts[0] > 239 else 1 if max(parts) > 9 else 0
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) else 0 if 14 <= len(digits) <= 19 else -1
        checked = 1 if luhn(digits) else -1
        listed = 1 if digits.startswith(CARD_HEADS) else -1
    else:
        shape = 1 if span[0] in "+(" else 0
        checked = 1 if 10 <= len(digits) <= 13 else 0 if len(digits) <= 15 else -1
        listed = -1 if len(set(digits)) <= 2 else 1 if "555" in digits or span.startswith(("+", "00")) else 0
    cue = 1 if any(w in CUES[kind] for w in before) else 0
    counter = -1 if any(w in AGAINST for w in before[-2:]) else 0
    edge = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
    edges = -1 if edge[0].isalnum() or edge[1].isalnum() else 1 if edge[0] in " \n\t:(=\"'<" else 0
    return [shape, checked, listed, cue, counter, edges]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability that each pattern's spans are personal data. ``patterns``: rows of votes -1, 0, 1.

    Two hidden classes, votes independent within a class; the class in which labelers vote for is the positive one.
    Smoothed, so that a labeler never counts as infallible.
    """
    if not len(patterns):
        return np.zeros(0)
    p = np.clip(0.5 + 0.15 * patterns.sum(1), 0.05, 0.95)
    seen = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    prior_votes = {True: np.array([1.0, 2.0, 4.0]), False: np.array([4.0, 2.0, 1.0])}
    for _ in range(rounds):
        share = (counts @ p + 1) / (counts.sum() + 2)
        logs = []
        for positive, w in ((True, counts * p), (False, counts * (1 - p))):
            rate = np.einsum("n,nlv->lv", w, seen) + prior_votes[positive]
            rate /= rate.sum(1, keepdims=True)
            logs.append(np.einsum("nlv,lv->n", seen, np.log(rate)) + np.log(share if positive else 1 - share))
        p = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
    return p


def fit_spans(features: np.ndarray, target: np.ndarray, counts: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic classifier on soft targets, by Newton steps with a small ridge."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    weight = counts / max(1.0, counts.sum())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


Span = tuple[int, int, int, bool, tuple[int, ...]]


def candidates(text: str) -> list[Span]:
    """(place of the kind, start, end, whether a base pattern matches, votes and one feature), by start, then kind."""
    base = base_spans(text)
    spans = [(a, k, b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in loose_spans(text, base)]
    return [(k, a, b, own, (*votes(text, KINDS[k], a, b), int(bool(SPLIT.search(text, a, b))))) for a, k, b, own in sorted(spans)]


def train(docs: DataFrame, text: str = "text") -> dict[int, np.ndarray]:
    """Weights of the span classifier of each kind, from the votes on all candidates of all rows.

    What comes to the driver are counts of vote patterns: at most 4 kinds x 2 x 3^6 x 2 rows, whatever the input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter((k, own, v) for t in batch["text"] if t for k, _, _, own, v in candidates(t))
            yield pd.DataFrame([(k, own, list(v), n) for (k, own, v), n in counts.items()], columns=["kind", "base", "votes", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInPandas(run, "kind int, base boolean, votes array<int>, n long")
    table = counted.groupBy("kind", "base", "votes").agg(F.sum("n").alias("n")).collect()
    weights = {}
    for place in range(len(KINDS)):
        own = sorted((r["base"], r["votes"], r["n"]) for r in table if r["kind"] == place)
        patterns = np.array([v for _, v, _ in own], float).reshape(-1, len(FEATURES))
        counts = np.array([n for _, _, n in own], float)
        target = fit_votes(patterns[:, : len(LABELERS)], counts)
        weights[place] = fit_spans(patterns, target, counts) if len(own) else np.zeros(len(FEATURES) + 1)
    return weights


def detect(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with ``found``: array of (kind, start, end, base, probability), sorted by start, then kind.

    Offsets count code points, the end is exclusive. Null counts as empty; an empty text has no spans. Texts are read
    whole, whatever their length. Repeated rows give repeated results, an empty table none. A column ``found`` of
    ``docs`` is replaced. Base spans stay whatever their probability; others stay from ``threshold`` on.
    """
    weights = train(docs, text)
    rows = docs.select(packed(docs, "found").alias("row"), F.col(text).alias("text"))

    def scored(spans: list[Span]) -> list[dict]:
        out = []
        for k, a, b, own, v in spans:
            p = float(1 / (1 + np.exp(-(weights[k][:-1] @ np.array(v) + weights[k][-1]))))
            if own or p >= threshold:
                out.append({"kind": KINDS[k], "start": a, "end": b, "base": own, "probability": p})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "found": [scored(candidates(t)) if t else [] for t in batch["text"]]})

    found = T.ArrayType(T.StructType.fromDDL("kind string, start int, end int, base boolean, probability double"))
    return rows.mapInPandas(run, T.StructType([rows.schema["row"], T.StructField("found", found)])).select("row.*", "found")


def spell(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the earlier one wins."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, s):
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.concat(state["out"], kept, F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= state["at"], F.struct(out.alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at"))
        )

    masked = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(masked)
