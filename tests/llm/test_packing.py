import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from capsieve.llm.packing import boundaries, pack


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts))


def test_boundaries_are_the_best():
    pick = random.Random(5)
    for _ in range(200):
        lengths = sorted(pick.sample(range(1, 40), pick.randint(1, 9)))
        counts = [pick.randint(1, 20) for _ in lengths]
        k = pick.randint(1, 5)
        tops = boundaries(np.array(lengths), np.array(counts), k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert tops == sorted(set(tops)) and len(tops) <= k and tops[-1] == lengths[-1]
        assert padding(lengths, counts, tops) == best
    assert boundaries(np.array([], int), np.array([], int), 3) == []


ROWS = [(i, "w " * (i % 37)) for i in range(400)] + [(900, None), (901, ""), (902, "x\t" * 1000), (7, "w " * 7), (None, "a b")]


@pytest.mark.parametrize("limit,buckets,budget", [(16, 3, 64), (2048, 8, 16384), (5, 1, 3)])
def test_every_token_is_packed_once(documents, limit, buckets, budget):
    got = pack(documents(ROWS), max_length=limit, buckets=buckets, budget=budget).collect()
    want = defaultdict(int)
    for i, t in ROWS:
        want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, batches = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        assert r.length <= limit and r.start == r.part * limit
        if r.length:
            assert r.length <= r.bucket_length
            batches[r.bucket, r.shard, r.batch].append(r)
        else:
            assert r.bucket is None and r.batch is None
    assert have == want
    for rows in batches.values():
        assert len({r.bucket_length for r in rows}) == 1
        assert len(rows) == 1 or len(rows) * rows[0].bucket_length <= budget
    seen = sorted((r.length for r in got if r.length))
    counts = {n: seen.count(n) for n in seen}
    tops = boundaries(np.array(sorted(counts)), np.array([counts[n] for n in sorted(counts)]), buckets)
    assert {r.bucket_length for r in got if r.length} == set(tops)
    part_full = [k for k, rows in batches.items() if len(rows) < max(1, budget // rows[0].bucket_length)]
    assert len(part_full) <= len({k[:2] for k in batches})


def test_empty(documents):
    got = pack(documents(ROWS).limit(0))
    assert got.columns == ["doc_id", "n_tokens", "part", "start", "length", "bucket", "bucket_length", "shard", "batch"]
    assert got.count() == 0
