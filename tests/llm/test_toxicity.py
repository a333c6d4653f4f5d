import random
import zlib

import numpy as np
import zstandard

from capsieve.llm import toxicity
from capsieve.llm.toxicity import Model, windows


def made(n, seed):
    """Random prose; every third text holds one of two invented slurs, inflected."""
    pick = random.Random(seed)
    parts = "an be ce di eo fa go hu in ja ko la mi no or pe qua ro sa ti".split()
    out = []
    for i in range(n):
        words = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 4))) for _ in range(pick.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), pick.choice(["zwexig", "brulkm"]) + pick.choice(parts + [""]))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_windows_hold_the_whole_text():
    for t in ("", "a", "Word " * 100, "x" * 1000, "É" * 300, " " * 500, "a b" * 77):
        assert b"".join(windows(t)) == t.lower().encode()
        assert all(0 < len(w) < 3 * toxicity.WINDOW for w in windows(t))


def test_learns_unseen_forms_and_agrees_with_single_windows():
    rows = made(600, 1)
    model = Model([t for t, k in rows if k], [t for t, k in rows if not k])
    assert {w[:6] for w in model.words} >= {"zwexig", "brulkm"}
    fresh = made(300, 2)
    got = (model.scores([t for t, _ in fresh]) >= 0.5).astype(int)
    assert (got == [k for _, k in fresh]).mean() > 0.95
    a, b = model.compressors()
    pieces = windows(fresh[0][0])
    assert [len(a.compress(p)) - len(b.compress(p)) for p in pieces] == model.savings(pieces).tolist()
    assert isinstance(a, zstandard.ZstdCompressor)


def test_one_label_only_or_none():
    assert (Model(["bad"], []).scores(["x", None, ""]) > 0.5).all()
    assert (Model([], ["fine"]).scores(["x", None, ""]) < 0.5).all()
    assert (Model([], []).scores(["x"]) < 0.5).all()


def test_frame(documents):
    rows = made(200, 3)
    model = Model([t for t, k in rows if k], [t for t, k in rows if not k])
    table = [(1, None), (2, ""), (3, rows[0][0]), (3, rows[0][0]), (4, rows[1][0]), (5, "long " * 40_000)]
    got = sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(documents(table), model).collect())
    want = model.scores([t for _, t in table])
    assert got == sorted((i, round(s, 9), int(s >= 0.5)) for (i, _), s in zip(table, want))
    assert got[0][1:] == got[1][1:] and got[0][2] == 0
    assert toxicity.score(documents(table).limit(0), model).count() == 0


def test_held_out_rows(spark, sf):
    from capsieve.llm.queries import QUERIES

    sf = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op4_toxicity"](spark, sf).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    order = (s[y == 1][:, None] > s[y == 0]).mean() + (s[y == 1][:, None] == s[y == 0]).mean() / 2
    assert order > 0.88 and (s[y == 1] >= 0.5).mean() > 0.75 and (s[y == 0] >= 0.5).mean() < 0.12


def mixed_in(n, seed, cue):
    """Random prose; ``cue(pick, i)`` gives the words that are mixed into text i, in the toxic half of the texts."""
    pick = random.Random(seed)
    parts = "an be ce di eo fa go hu in ja ko la mi no or pe qua ro sa ti".split()
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(60)]
        for w in cue(pick, i, word) if i % 2 else ():
            words.insert(pick.randrange(len(words)), w)
        out.append((" ".join(words), i % 2))
    return out


def split(rows):
    return [t for t, k in rows if k], [t for t, k in rows if not k]


def test_words_with_digits_and_signs_and_ends_of_words():
    for cue in (lambda pick, i, word: ["1d10t", "sh!t,"], lambda pick, i, word: [word() + "zwexig" for _ in range(3)]):
        model = Model(*split(mixed_in(400, 5, cue)))
        fresh = mixed_in(200, 6, cue)
        got = model.scores([t for t, _ in fresh]) >= 0.5
        assert (got == [k for _, k in fresh]).mean() > 0.95


def test_rare_cues_stand_beside_a_hot_one():
    toxic, ordinary = split(mixed_in(4000, 7, lambda pick, i, word: ["brulkmo"] + ["zwexig"] * (i % 200 == 1)))
    model = Model(toxic, ordinary)
    assert {w[:6] for w in model.words} >= {"brulkm", "zwexig"}
