import random
import re
import string

import numpy as np
import pytest

from capsieve.llm import countmin, jaccard
from capsieve.llm.jaccard import Rule, join, signatures

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, percent=80):
    sets = [(i, brute_set(t)) for i, t in rows]
    near = {i: {i} for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
    out = []
    for i, s in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(s), None if i is None else min(seen)))
    return sorted(map(repr, out))


def corpus(seed, families=12, size=8):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 5)))
    passage = [word() for _ in range(30)]
    rows = []
    for f in range(families):
        base = [word() for _ in range(pick.choice([3, 5, 6, 8, 12, 25, 60, 150]))]
        if f % 3 == 0:
            base += passage
        for _ in range(size):
            new = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                new[pick.randrange(len(new))] = word()
            if pick.random() < 0.3:
                new = new + [word()]
            rows.append((len(rows) * 7 % 1009, pick.choice([" ", "\n", "\t "]).join(new).title() if pick.random() < 0.2 else " ".join(new)))
    one, two = ([word() for _ in range(40)] for _ in range(2))
    rows += [(3001, " ".join(one)), (3001, " ".join(two)), (3002, " ".join([*two, "more"])), (3003, " ".join([*one, "more"])), (3003, "quite another text of some words"), (3004, "quite another text of some words")]
    rows += [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "ONE"), (2005, "ONE"), (None, "one"), (None, None), (2006, "x" * 90_000), (2007, "w " * 30_000)]
    return rows


@pytest.mark.parametrize("chunk,broadcast", [(1024, 2_000_000), (4, 0)])
def test_brute_force(spark, documents, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    rows = corpus(chunk)
    got = join(documents(rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_one_id_with_two_texts(documents):
    one, two = ("a b c d e f g h i j k l m n o p q r s t", "A1 B1 C1 D1 E1 F1 G1 H1 I1 J1 K1 L1 M1 N1 O1 P1 Q1 R1 S1 T1")
    rows = [(1, one), (1, two), (2, f"{two} x"), (3, f"{one} x")]
    got = {(r["doc_id"], r["component_id"]) for r in join(documents(rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_every_linked_pair_shares_a_signature():
    rng, rule = np.random.default_rng(4), Rule(80)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(4):
            out = rng.permutation(a)[: max(1, len(a) - int(rng.integers(0, 1 + len(a) // 8)))]
            b = np.unique(np.concatenate([out, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(a) // 9))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(a) != common and rule.linked(common, len(a) + len(b)):
                h, who = signatures([a, b], rule)
                assert set(h[who == 0].tolist()) & set(h[who == 1].tolist())


def test_empty(documents):
    assert join(documents([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("ids", [0, 10**6])
def test_many_clustered_documents_are_not_broadcast_with_their_tasks(documents, monkeypatch, ids):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", ids)
    rows = corpus(11, 6)
    got = join(documents(rows).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_the_driver_never_holds_the_whole_sketch(documents, monkeypatch):
    monkeypatch.setattr(countmin, "PIECE_BITS", 12)
    monkeypatch.setattr(countmin, "PART_BITS", 15)
    rows = documents(corpus(3)).select("doc_id", "text").repartition(3)
    bits, parts = countmin.repeated(rows, 1 << 19, lambda texts: jaccard.grouped(texts, 5))
    assert bits == 20 and [len(p.value) for p in parts] == [(1 << 15) // 8] * 32
    h = np.concatenate([s for r in rows.toLocalIterator() for s in jaccard.shingle_sets([r["text"]], 5)])
    _, place, many = np.unique(h, return_inverse=True, return_counts=True)
    told = countmin.estimated(h, bits, parts)
    assert told[many[place] > 1].all() and not told.all()
    whole = countmin.estimated(h, bits, [Held(np.concatenate([p.value for p in parts]))])
    assert (told == whole).all()


class Held:
    def __init__(self, value):
        self.value = value
