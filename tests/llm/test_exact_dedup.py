import hashlib
import string
from collections import defaultdict

import pytest

from capsieve.llm.exact_dedup import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000), (8, "X" * 50_000), (9, "x" * 49_999), (None, "a b"), (None, "z"), (None, "z"), (10, "q"), (10, "q"), (11, "a b ")]
ROWS += [(100 + i, "HOT text " * 40) for i in range(300)]


def brute(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for norm, ids in groups.items():
        keep = pick((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x != keep, x is None, x or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    return sorted(map(repr, out))


@pytest.mark.parametrize("largest", [True, False])
def test_brute_force(documents, largest):
    got = exact_dedup(documents(ROWS), keep_largest=largest)
    assert {"lang", "row", "norm", "kept"} <= set(got.columns)
    rows = got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(repr(tuple(r)) for r in rows) == brute(ROWS, max if largest else min)


def test_empty(documents):
    assert exact_dedup(documents(ROWS).limit(0)).collect() == []
