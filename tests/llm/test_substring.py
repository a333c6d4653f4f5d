import random
import re
from collections import defaultdict

import numpy as np
import pytest

from capsieve.llm import countmin, substring
from capsieve.llm.substring import remove_repeats


def brute(rows, size):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = defaultdict(lambda: None)
    for i, w in docs:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None and (least[key] is None or i < least[key]):
                least[key] = i
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(repr, out))


def corpus(seed, size):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcé") for _ in range(pick.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (size - 1, size, size + 1, 3 * size)]
    rows = []
    for i in range(60):
        parts = [pick.choice(passages) if pick.random() < 0.5 else [word() for _ in range(pick.randint(0, 2 * size))] for _ in range(4)]
        rows.append((i * 37 % 101, pick.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    words = [word() for _ in range(3 * size)]
    rows += [(400, " ".join(words)), (401, " ".join(words)), (401, " ".join(word() for _ in range(3 * size))), (401, None), (401, " ".join(["new", *words[1:]]))]
    rows += [(402, " ".join(words[: size + 1])), (402, " ".join(words))]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (301, rows[0][1]), (302, None), (303, ""), (304, " \n "), (None, rows[0][1]), (305, "same " * 900), (306, "x" * 50_000), (307, "same " * 901 + "  end")]
    return rows


@pytest.mark.parametrize("size,limit,bits", [(50, 64 << 20, 30), (3, -1, 20), (1, 64 << 20, 30)])
def test_brute_force(documents, monkeypatch, size, limit, bits):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(countmin, "MOST_BITS", bits)
    rows = corpus(size, size)
    got = remove_repeats(documents(rows).repartition(3), size=size).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, size)


def test_a_full_sketch_loses_nothing(documents, monkeypatch):
    """With a sketch of few cells nearly every window is estimated as repeated; the result is the same."""
    monkeypatch.setattr(countmin, "MOST_BITS", 4)
    monkeypatch.setattr(countmin, "LEAST_BITS", 4)
    monkeypatch.setattr(countmin, "PIECE_BITS", 3)
    rows = corpus(9, 10)
    got = remove_repeats(documents(rows), size=10).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, 10)


def test_empty(documents):
    assert remove_repeats(documents([(1, "a")]).limit(0)).collect() == []


def test_parts_of_the_hash_range_stay_small():
    """Memory of a task that answers follows its part of the hashes, so parts follow the input."""
    for length in (1 << 30, 10 << 30, 50 << 30):
        assert length / countmin.shards(length) <= 16 << 20


@pytest.mark.parametrize("size", [1, 2, 3, 10, 50])
def test_equal_windows_have_equal_anchors_and_few_of_them(size):
    pick = random.Random(size)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(3 * size)]
    texts = [" ".join([*[word() for _ in range(pick.randint(0, 99))], *passage, *[word() for _ in range(3000)]]) for _ in range(3)] + [None, "one"]
    ((_, text, place, anchor, _),) = substring.window_hashes(texts, size, 0)
    seen = defaultdict(set)
    for t, p, a in zip(text, place, anchor):
        seen[tuple(texts[t].split()[p : p + size])].add(a)
    assert all(len(a) == 1 for a in seen.values())
    (counted,) = substring.anchors(texts, size)
    assert set(counted) == set(anchor)
    assert len(counted) < 1.3 * len(anchor) * 2 / (substring.spanned(size) + 1) or size < 3
    repeated = {a for a, n in zip(*np.unique(counted, return_counts=True)) if n > 1}
    assert {a for w, s in seen.items() for a in s if w in {tuple(passage[i : i + size]) for i in range(2 * size + 1)}} <= repeated
