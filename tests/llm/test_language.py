import zlib

import numpy as np
from pyspark.sql import functions as F

from capsieve.llm import language
from capsieve.llm.language import Network


def plain(net, text):
    """The network written out for one window at a time."""
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    data, total = text.lower().encode(), 0
    for at in range(0, len(data), language.LENGTH):
        x = np.frombuffer(data[at : at + language.LENGTH].ljust(language.LENGTH, b"\0"), np.uint8)
        pooled = []
        for w in language.WIDTHS:
            t = net.weights[f"w{w}"]
            pooled += [max(sum(t[j, x[p + j], f] for j in range(w)) for p in range(language.LENGTH - w + 1)) for f in range(language.FILTERS)]
        z = np.maximum(np.array(pooled) + net.weights["b"], 0) @ net.weights["out"] + net.weights["c"]
        total = total + np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return net.languages[int(np.argmax(total))]


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, language.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        net.prepared()
        return -np.log(net.predict(x)[np.arange(5), y]).mean()

    grads = net.step(x, y)
    for name, g in grads.items():
        for i in np.argsort(-np.abs(g).ravel())[:3]:
            w, e = net.weights[name].reshape(-1), 1e-3
            old = w[i]
            w[i] = old + e
            up = loss()
            w[i] = old - e
            down = loss()
            w[i] = old
            assert abs((up - down) / (2 * e) - g.ravel()[i]) < 0.02


def test_held_out_rows(spark, sf):
    from capsieve.llm.queries import QUERIES

    got = QUERIES["op6_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    own = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in own) >= 0.95 * len(own) > 20


def test_frame(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = language.train(docs)
    some = [r.text for r in docs.orderBy("doc_id").limit(4).collect()]
    rows = [(1, None), (2, ""), (3, "1234 ½ ² --"), (4, some[0]), (4, some[0]), (5, "Ж" * 3000)] + [(10 + i, t[:300]) for i, t in enumerate(some)]
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(documents(rows), net).collect())
    assert got == sorted((i, plain(net, t)) for i, t in rows)
    assert language.identify(documents(rows).limit(0), net).count() == 0


def test_nothing_learned(documents):
    docs = documents([(1, "some text"), (2, None)]).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(docs, language.train(docs)).collect()} == {"und"}
