import hashlib
import random
import re

import numpy as np

from capsieve.llm import private

# The patterns as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for place, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x.lstrip("0")[:9] or 0) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), place, m.end()))
    return sorted(out)


def test_base_spans():
    pick = random.Random(3)
    parts = list("ab@@..--++123450 ()é") + ["a@b.co", "1.2.3.4", "4111111111111111", "4111-1111 1111-1111", "+1 (555) 123-4567", "٣", "0000.1.1.1"]
    for _ in range(20000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))
        assert private.base_spans(text) == brute(text), text


def test_parts_of_thousands_of_digits():
    zeros, nines = "0" * 5_000, "9" * 5_000
    for text, found in ((f"1.2.3.{zeros}", True), (f"{zeros}1.{zeros}.3.4", True), (f"1.2.3.{nines}", False), (f"{nines}.1.1.1", False), (f"1.2.3.{zeros}256", False)):
        assert private.base_spans(text) == ([(0, 1, len(text))] if found else [])
    for text in (zeros, nines, f"+{nines}", f"({nines}) {zeros}", f"1 . 2 . 3 . {nines}", f"1[.]2[.]3[.]{zeros}", f"host 1-2-3-{nines}"):
        private.candidates(text)


def test_linear_in_the_length():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "(12) " * 60_000, "a(at" * 60_000):
        private.candidates(text)


def test_votes_find_the_labelers_that_agree():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    reliable = [0.95, 0.9, 0.85, 0.6, 0.9, 0.8]
    draws = np.stack([np.where(rng.random(4000) < r, truth, ~truth) * 2 - 1 for r in reliable], 1)
    patterns, index, counts = np.unique(draws, axis=0, return_inverse=True, return_counts=True)
    p = private.fit_votes(patterns.astype(float), counts.astype(float))
    assert ((p[index.ravel()] > 0.5) == truth).mean() > 0.95
    w = private.fit_spans(patterns.astype(float), p, counts.astype(float))
    again = 1 / (1 + np.exp(-(patterns @ w[:-1] + w[-1])))
    assert np.abs(again - p).max() < 0.2


ROWS = [(1, None), (2, ""), (3, "mail me: jo@x.org or call +1 (555) 123-4567 now"), (4, "host 10.2.3.4, page 999.1.1.1"), (4, "host 10.2.3.4, page 999.1.1.1"), (5, "write to jo (at) mail (dot) example (dot) com"), (6, "é" * 9 + "card 4111 1111 1111 1111."), (7, "x" * 100_000 + " a@b.co"), (8, "ip 1.2.3." + "0" * 5_000), (9, "ip 1.2.3." + "9" * 5_000)]


def test_frame(documents):
    got = {r.doc_id: r.found for r in private.detect(documents(ROWS)).collect()}
    for i, text in ROWS:
        assert [(s.start, private.KINDS.index(s.kind), s.end) for s in got[i] if s.base] == brute(text or "")
    assert private.detect(documents(ROWS).limit(0)).count() == 0


def test_mask(documents):
    from pyspark.sql import functions as F

    masked = private.detect(documents(ROWS)).select("doc_id", private.mask(F.col("text"), F.col("found")).alias("t"))
    got = {r.doc_id: r.t for r in masked.collect()}
    assert got[1] is None and got[2] == "" and got[6] == "é" * 9 + "card <card>." and got[7] == "x" * 100_000 + " <email>"
    assert got[3] == "mail me: <email> or call <phone> now" and got[4].startswith("host <ip>,")


def test_query(spark, sf):
    from capsieve.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op3_private"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(docs) == len(got)
    for d in docs:
        base = brute(d.text or "")
        spelt = [f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base]
        row = got[d.doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == p for _, p, _ in base) for k in range(4)]
        assert set(spelt) <= set(row.spans.split(","))
