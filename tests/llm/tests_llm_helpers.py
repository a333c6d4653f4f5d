"""Brute-force versions that several tests use."""

from test_jaccard import brute_set
from test_private import brute as brute_spans  # noqa: F401


def brute_components(rows):
    """(doc_id, least doc_id of its group of near duplicates)."""
    sets = [(i, s) for i, t in rows for s in [brute_set(t)]]
    holders = {}
    for i, s in sets:
        for g in s:
            holders.setdefault(g, []).append(i)
    size, of = {i: len(s) for i, s in sets}, dict(sets)
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets:
        shared = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (size[i] + size[j] - n) and of[j]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, find(i)) for i, _ in sets]
