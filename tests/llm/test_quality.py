import math
import random
from collections import Counter, defaultdict

import pytest

from capsieve.llm import quality


def brute(trusted, rows):
    """Perplexities by the textbook formulas, on dictionaries."""
    grams = lambda t: [(a, b, c) for a, b, c in zip("\0\0" + t, "\0" + t, t)]
    three = Counter(g for t in trusted for g in grams(t))
    two = Counter(g[1:] for g in three)
    one = Counter(g[1:] for g in two)

    def rules(counts):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [min(max(k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0.5), 0.1), k - 0.05) for k in (1, 2, 3)]

    d = {3: rules(three), 2: rules(two), 1: rules(one)}
    tables = {3: three, 2: two, 1: one}
    after = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, n in t.items():
            after[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 0x110000
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda n: d[k][min(n, 3) - 1]
        n = tables[k].get(g, 0)
        return (max(n - cut(n), 0) if n else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / max(1, len(t))) for t in rows]


def corpus(seed, n=40):
    pick = random.Random(seed)
    return ["".join(pick.choice("aabcdé \n") for _ in range(pick.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("together", [2_500_000, 50])
def test_against_the_formulas(spark, documents, monkeypatch, together):
    monkeypatch.setattr(quality, "TOGETHER", together)
    texts = corpus(1) + ["Zß漢", "a" * 5000, "", None, "xyz\0"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    sure = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(2,), (None,), (999,)], "doc_id long")
    got = quality.perplexities(documents(rows).repartition(3), sure).collect()
    trusted = [t for i, t in rows if i is not None and i < 40 and i % 2 == 0]
    want = brute(trusted, [(t or "").replace("\0", "�") for _, t in rows])
    have = sorted((repr(r.doc_id), r.n_chars, r.perplexity) for r in got)
    need = sorted((repr(i), len(t or ""), w) for (i, t), w in zip(rows, want))
    assert [h[:2] for h in have] == [n[:2] for n in need]
    # Log probabilities travel in single precision.
    assert [h[2] for h in have] == pytest.approx([n[2] for n in need], rel=1e-5)


def test_nothing_trusted_or_empty(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.classify(documents([(1, "abc"), (2, None)]), none).collect()
    assert all(r.kept for r in got) and len(got) == 2
    assert quality.classify(documents([(1, "abc")]).limit(0), none).collect() == []


def test_junk_goes_and_clean_text_stays(spark, sf):
    from capsieve.llm.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")
    got = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.6 * len(bad)


def test_repeated_words_and_phrases_go(spark, documents):
    pick = random.Random(4)
    parts = "an be ce di eo fa go hu in ja ko la".split()
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(1, 4)))
    clean = [" ".join(word() for _ in range(pick.randint(60, 120))) for _ in range(300)]
    junk = [" ".join([word()] * 100) for _ in range(10)] + [" ".join([word(), word(), word()] * 40) for _ in range(10)]
    sure = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    got = {r.doc_id: r for r in quality.classify(documents(list(enumerate(clean + junk))).repartition(3), sure).collect()}
    assert not any(got[i].kept for i in range(300, 320))
    assert sum(got[i].kept for i in range(300)) >= 290


def test_recurrences_by_a_loop(monkeypatch):
    from capsieve.llm import wordhash

    def plain(text):
        last, x = {}, [quality.START] * 2
        for i, w in enumerate(text.split()):
            d = i - last.get(w, i)
            last[w] = i
            x.append(quality.START + 1 + (d if d <= quality.NEAR else quality.NEAR + d.bit_length()))
        return [a << 42 | b << 21 | c for a, b, c in zip(x, x[1:], x[2:])]

    texts = ["a b a a", "", "a", " \n", " ".join(str(i % 300) for i in range(2000)), "a b a a " * 9]
    for together in (4_000_000, 5):
        monkeypatch.setattr(wordhash, "TOGETHER", together)
        assert [g.tolist() for g in quality.recurrences(texts)] == [plain(t) for t in texts]


def test_nearly_all_labelled_junk_goes(spark, sf):
    from capsieve.llm.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.1")
    got = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    rates = sum(not r.kept for r in bad) / len(bad), sum(r.kept for r in good) / len(good)
    print("junk rejected, clean kept:", rates, len(bad), len(good))
    assert rates[0] >= 0.97 and rates[1] >= 0.99
