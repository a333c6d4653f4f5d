import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from capsieve.llm import audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(text, copy):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }


def brute(rows, labels):
    """(doc_id, text, source) rows, {doc_id: (quality, toxic)}."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    docs = [(i, p, fails(t, i is not None and any(j is not None and j < i and u == t for j, u, _ in rows))) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                total[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f[name] for _, f in own) - len(gone),
                    sum(f[name] and sum(f.values()) == 1 for _, f in own),
                    *[sum(labels.get(i, (0, 0))[k] == 1 for i, _ in gone) for k in (0, 1)],
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def words(n, distinct):
    return " ".join(f"w{i % distinct}é" for i in range(n))


ROWS = [(1, words(200, 100), None, "a"), (2, words(200, 99), None, "a"), (3, words(199, 199), None, "b"), (4, words(200, 100), None, "b")]
ROWS += [(5, None, None, None), (6, "", None, ""), (None, words(300, 300), None, "a"), (None, words(300, 300), None, "a"), (7, words(300, 300), None, "a")]
ROWS += [(8, "A" * 2 + "é" * 98, None, "b"), (9, "A" * 3 + "é" * 97, None, "b"), (10, words(250, 250) + " |", None, "c"), (10, words(250, 250) + " |", None, "c")]
ROWS += [(11, words(250, 250) + " |", None, "a"), (12, "x y z\x1cq " * 200, None, "c"), (13, "B\tC\x0bD\x0cE\r" * 20_000, None, "c")]
ROWS += [(100 + i, "HOT text # " * 120, None, "hot") for i in range(200)]
LABELS = [(i, i % 2, i % 3 == 0) for i in range(1, 300, 2)] + [(2, None, 1), (4, 0, 0), (4, 1, None), (None, 1, 1)]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in LABELS], "doc_id long, quality int, toxic int")


def known():
    out = {}
    for i, q, t in LABELS:
        a, b = out.get(i, (0, 0))
        out[i] = (max(a, q or 0), max(b, int(t or 0)))
    out.pop(None)
    return out


@pytest.mark.parametrize("size", [1, 5_000, audit.SHARD_BYTES])
def test_brute_force(documents, labels, size, monkeypatch):
    monkeypatch.setattr(audit, "SHARD_BYTES", size)
    got = audit.audit(documents(ROWS), labels)
    assert sorted(map(tuple, got.collect())) == brute([(i, t, s) for i, t, _, s in ROWS], known())


def test_matrix(documents):
    docs = documents(ROWS).repartition(3)
    shards = audit.matrix(docs).collect()
    total, ids = Counter(), set()
    for s in shards:
        indptr, indices, counts = (audit.unsqueeze(s[c], kind) for c, kind in (("indptr", np.int64), ("indices", np.int64), ("counts", np.int32)))
        assert len(indptr) == len(s["doc_id"]) + 1 and indptr[-1] == len(indices) == len(counts)
        for i, doc in enumerate(s["doc_id"]):
            own = indices[indptr[i] : indptr[i + 1]]
            assert len(set(own)) == len(own)
            total[doc] += counts[indptr[i] : indptr[i + 1]].sum()
        ids.update(indices.tolist())
    expected = Counter()
    for i, t, *_ in ROWS:
        expected[i] += len(WORD.findall(t or ""))
    assert total == expected
    vocabulary = {w for _, t, *_ in ROWS for w in WORD.findall(t or "")}
    assert ids == set(range(len(vocabulary)))


def test_empty(documents, labels):
    assert audit.audit(documents(ROWS).limit(0), labels).collect() == []
    got = audit.audit(documents(ROWS[:1]), labels.limit(0)).collect()
    assert len(got) == 600 and not any(r["good_lost"] for r in got)
