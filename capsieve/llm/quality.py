"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trigrams.

One model is of characters; text of the usual letters passes it however often it repeats itself. So another is of
recurrences: for each word, how many words back it stood last. Text that repeats a word, a phrase or a line is a run of
small numbers there, which clean text doesn't have.

The models are trained on trusted text, all of it. Documents are turned, block by block, into counts of their distinct
trigrams; counts of trigrams, of their contexts and of the lower orders are tables, joined by shuffle on the gram, so
no task holds a model. A block asks once for each of its grams and gets its probabilities back. A document is
rejected when either perplexity exceeds a high quantile of the trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.llm.wordhash import pack, pack_sorted, together, unpack, unpack_sorted, word_hashes
from capsieve.session import materialize

#: Characters of a block; a longer text is a block of its own.
TOGETHER = 2_500_000
#: Bits of a character, and the number of possible characters, over which unseen ones share alike.
BITS, CHARACTERS = 21, 0x110000
LOW, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Recurrences are numbered from the end of the characters on: before the first word, a new word, distances up to NEAR,
#: and powers of two of larger ones. Their grams follow those of characters.
NEAR, RECURRENCES = 8, 128
START, FIRST = CHARACTERS, CHARACTERS << 2 * BITS
#: Languages up to which their thresholds are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
#: Accuracy of the quantiles: ranks are right to one part in this.
ACCURACY = 100_000
UNKNOWN = "und"


def trigrams(text: str) -> np.ndarray:
    """One number for each character: itself and the two before it, zeros before the first."""
    raw = np.frombuffer(text.replace("\0", "�").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    x = np.concatenate([np.zeros(2, np.int64), raw])
    return x[:-2] << 2 * BITS | x[1:-1] << BITS | x[2:]


def recurrences(texts: list[str]) -> list[np.ndarray]:
    """Of each text one number for each word: how far back the word stood last, and the same of the two words before."""
    data = [t.encode("utf-8", "replace") for t in texts]
    out = []
    for a, b in together(data):
        borders, (h,) = word_hashes(data[a:b])
        text = np.repeat(np.arange(b - a), np.diff(borders))
        order = np.lexsort((h, text))
        back = np.zeros(len(h), np.int64)
        again = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        back[order[1:][again]] = (order[1:] - order[:-1])[again]
        far = back > NEAR
        back[far] = NEAR + np.frexp(back[far].astype(float))[1]
        for i, j in zip(borders[:-1], borders[1:]):
            x = np.concatenate([[START] * 2, START + 1 + back[i:j]]).astype(np.int64)
            out.append(x[:-2] << 2 * BITS | x[1:-1] << BITS | x[2:])
    return out


def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of documents: their ids and languages, the grams of all, and of each document the places of its distinct
    grams among them with their counts."""
    task, number = TaskContext.get().partitionId(), 0

    def block(ids, langs, grams):
        nonlocal number
        number += 1
        size = np.array([len(g) for g in grams], np.int64)
        flat = np.concatenate([*grams, np.zeros(0, np.int64)])
        keys, place = np.unique(flat, return_inverse=True)
        del flat
        # One number for document and place; blocks are far too small for it to overflow.
        place += np.repeat(np.arange(len(grams)) * max(1, len(keys)), size)
        both, count = np.unique(place, return_counts=True)
        distinct = np.bincount(both // max(1, len(keys)), minlength=len(grams))
        return {
            "block": task << 32 | number,
            "ids": ids,
            "langs": langs,
            "keys": pack_sorted(keys),
            "n_first": int(np.searchsorted(keys, FIRST)),
            "places": pack((both % max(1, len(keys))).astype(np.uint32)),
            "counts": pack(count.astype(np.uint32)),
            "distinct": pack(distinct.astype(np.uint32)),
        }

    for batch in batches:
        out, at, total = [], 0, 0
        grams = []
        texts = [t or "" for t in batch["text"]]
        for i, (t, again) in enumerate(zip(texts, recurrences(texts))):
            g = np.concatenate([trigrams(t), again])
            if grams and total + len(g) > TOGETHER:
                out.append(block(batch["doc_id"].tolist()[at:i], batch["lang"].tolist()[at:i], grams))
                at, total, grams = i, 0, []
            grams.append(g)
            total += len(g)
        if grams:
            out.append(block(batch["doc_id"].tolist()[at:], batch["lang"].tolist()[at:], grams))
        if not out:
            continue
        frame = pd.DataFrame(out)
        frame["ids"] = [[None if pd.isna(x) else int(x) for x in ids] for ids in frame["ids"]]
        yield frame


BLOCKS = "block long, ids array<long>, langs array<string>, keys binary, n_first long, places binary, counts binary, distinct binary"


def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the grams of the trusted documents of each block."""
    for batch in batches:
        for keys, places, counts, distinct, trusted in zip(*(batch[c] for c in ("keys", "places", "counts", "distinct", "trusted"))):
            key, size = unpack_sorted(keys, "<i8"), unpack(distinct, "<u4").astype(np.int64)
            mine = np.zeros(len(size), bool)
            mine[np.asarray(trusted, np.int64)] = True
            own = np.repeat(mine, size)
            total = np.bincount(unpack(places, "<u4")[own].astype(np.int64), unpack(counts, "<u4")[own], len(key)).astype(np.int64)
            yield pd.DataFrame({"gram": key[total > 0], "n": total[total > 0]})


def discounts(counted: DataFrame) -> list[float]:
    """What modified Kneser-Ney takes from counts of 1, 2, and 3 or more, by the numbers of grams seen 1 to 4 times."""
    seen = {r["n"]: r["count"] for r in counted.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda a, b: a / b if b else 0.5
    return [min(max(i - (i + 1) * y * ratio(b, a), 0.1), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def taken(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def contexts(counted: DataFrame, context: Column, d: list[float]) -> DataFrame:
    """Of each context the sum of its counts and the share that goes to the lower order."""
    total = F.sum("n")
    return counted.groupBy(context.alias("context")).agg(total.alias("total"), (F.sum(taken(F.col("n"), d)) / total).alias("rest"))


def probabilities(asked: DataFrame, counted: DataFrame, symbols: int = CHARACTERS) -> DataFrame:
    """gram, logp of all grams of ``asked``, by joins with the counts of each order and of the contexts.

    The lower orders count the different symbols before a gram. An unseen context leaves all to the lower order;
    the lowest shares what is left among all ``symbols``.
    """
    pairs = materialize(counted.groupBy((F.col("gram").bitwiseAND(PAIR)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    single = materialize(pairs.groupBy((F.col("gram").bitwiseAND(LOW)).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    d3, d2, d1 = (discounts(c) for c in (counted, pairs, single))
    whole = single.agg(F.sum("n").alias("n"), F.sum(taken(F.col("n"), d1)).alias("rest")).first()
    total, rest = float(whole["n"] or 0), float(whole["rest"] or 0)

    def join(left: DataFrame, key: Column, right: DataFrame, on: str, *names: str) -> DataFrame:
        renamed = right.select(F.col(on).alias("k"), *[F.col(a).alias(b) for a, b in zip([c for c in right.columns if c != on], names)])
        return left.withColumn("k", key).join(renamed, "k", "left").drop("k")

    def part(n: str, d: list[float], all_: str, share: str, lower: Column) -> Column:
        own = F.greatest(F.coalesce(F.col(n) - taken(F.col(n), d), F.lit(0.0)), F.lit(0.0))
        return F.when(F.col(all_).isNull(), lower).otherwise(own / F.col(all_) + F.col(share) * lower)

    g = F.col("gram")
    found = join(asked, g.bitwiseAND(LOW), single, "gram", "n1")
    found = join(found, g.bitwiseAND(PAIR), pairs, "gram", "n2")
    found = join(found, F.shiftright(g.bitwiseAND(PAIR), BITS), contexts(pairs, F.shiftright("gram", BITS), d2), "context", "t2", "r2")
    found = join(found, g, counted, "gram", "n3")
    found = join(found, F.shiftright(g, BITS), contexts(counted, F.shiftright("gram", BITS), d3), "context", "t3", "r3")
    lowest = F.lit(1.0 / symbols)
    if total:
        lowest = (F.greatest(F.coalesce(F.col("n1") - taken(F.col("n1"), d1), F.lit(0.0)), F.lit(0.0)) + rest * lowest) / total
    return found.select("gram", F.log(part("n3", d3, "t3", "r3", part("n2", d2, "t2", "r2", lowest))).alias("logp"))


def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The grams of each block."""
    for batch in batches:
        for block, keys in zip(batch["block"], batch["keys"]):
            yield pd.DataFrame({"block": block, "gram": unpack_sorted(keys, "<i8")})


def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters and the mean log probability under each model of each document of a block."""
    names = ("ids", "langs", "n_first", "places", "counts", "distinct", "logp")
    for batch in batches:
        for ids, langs, first, places, counts, distinct, logp in zip(*(batch[c] for c in names)):
            size = unpack(distinct, "<u4").astype(np.int64)
            n, place = unpack(counts, "<u4").astype(float), unpack(places, "<u4").astype(np.int64)
            own = np.repeat(np.arange(len(size)), size)
            logs = np.asarray([] if logp is None else logp, float)
            found = {}
            for name, part in (("mean", place < first), ("again", place >= first)):
                total, length = (np.bincount(own[part], x, len(size)) for x in ((n * logs[place])[part], n[part]))
                found[name] = total / np.maximum(length, 1)
                found.setdefault("n_chars", length.astype(np.int64))
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "lang": langs, "n_chars": found["n_chars"], "mean": found["mean"], "again": found["again"]})


def perplexities(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang (``und`` for null), n_chars, perplexity, recurrence (the perplexity under the model of recurrences)
    and trusted of every row; ``trusted`` holds ids.

    Null counts as empty; an empty text has perplexities of 1. Repeated rows are counted and returned as often as they
    occur. Rows without id are scored but never trusted. Without any trusted text all symbols are equally likely.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"))
    blocks = materialize(rows.mapInPandas(vectors, BLOCKS))
    sure = materialize(trusted.select(F.col(doc_id).cast("long").alias("id")).where("id IS NOT NULL").distinct())
    held = blocks.select("block", F.posexplode("ids").alias("place", "id")).join(sure, "id").groupBy("block").agg(F.collect_list("place").alias("trusted"))
    counted = blocks.drop("ids", "langs").join(held, "block").mapInPandas(count, "gram long, n long")
    counted = materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    asked = blocks.select("block", "keys").mapInPandas(ask, "block long, gram long")
    need, late = asked.select("gram").distinct(), F.col("gram") >= FIRST
    known = probabilities(need.where(~late), counted.where(~late))
    known = known.union(probabilities(need.where(late), counted.where(late), RECURRENCES))
    told = asked.join(known, "gram").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("gram", "logp"))).alias("told"))
    told = told.select("block", F.transform("told", lambda x: x["logp"].cast("float")).alias("logp"))
    schema = "doc_id long, lang string, n_chars long, mean double, again double"
    scored = blocks.drop("keys").join(told, "block", "left").mapInPandas(answer, schema)
    marked = scored.join(sure.select(F.col("id").alias("doc_id"), F.lit(True).alias("trusted")), "doc_id", "left")
    values = F.exp(-F.col("mean")).alias("perplexity"), F.exp(-F.col("again")).alias("recurrence")
    return materialize(marked.select("doc_id", "lang", "n_chars", *values, F.coalesce("trusted", F.lit(False)).alias("trusted")))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.999, **names: str) -> DataFrame:
    """``perplexities`` with threshold, recurrence_threshold and kept.

    A row is kept when each perplexity is at most the ``quantile`` of the trusted documents of its language; a language
    without trusted documents takes the quantile of all of them. Without any, or for an empty text, all is kept.
    """
    scored = perplexities(docs, trusted, **names)
    sure = scored.where("trusted AND n_chars > 0")
    limits = {"perplexity": "threshold", "recurrence": "recurrence_threshold"}
    cuts = [F.percentile_approx(c, quantile, ACCURACY).alias(t) for c, t in limits.items()]
    overall = sure.agg(*cuts).first()
    by_language = materialize(sure.groupBy("lang").agg(*cuts))
    few = by_language.count() <= BROADCAST_LANGUAGES
    found = scored.join(F.broadcast(by_language) if few else by_language, "lang", "left")
    kept = F.lit(True)
    for c, t in limits.items():
        if overall[t] is not None:
            found = found.withColumn(t, F.coalesce(t, F.lit(overall[t])))
        kept = kept & F.coalesce(F.col(c) <= F.col(t), F.lit(True))
    return found.select("doc_id", "lang", "n_chars", *limits, "trusted", *limits.values(), (kept | (F.col("n_chars") == 0)).alias("kept"))
