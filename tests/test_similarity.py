"""The ratio of texts of which one holds the other is told without Python, and equals difflib's."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from capsieve.operators import align


def test_equal_to_difflib(spark):
    rng, rows = random.Random(8), []
    word = lambda n: "".join(rng.choice("abc中") for _ in range(n))
    for _ in range(300):
        a, b = word(rng.randint(0, 30)), word(rng.randint(0, 9))
        rows += [(a, b), (a + b, b), (b, a + b + a), (a, a[3:9]), (a, a)]
    for n in (198, 199, 200, 201, 260):  # frequent letters are passed over from 200 on
        long = word(n)
        rows += [(long, long[5:90]), (long[5:90], long), (long + word(9), long), ("a" * 9, "a" * n), ("a" * n, "a" * 9)]
    df = spark.createDataFrame(rows, "l string, r string")
    got = df.select("l", "r", align.similarity(F.col("l"), F.col("r")).alias("ratio")).collect()
    want = [0.0 if not l or not r else SequenceMatcher(None, l, r).ratio() for l, r in rows]  # noqa: E741
    assert [g.ratio for g in got] == want and len(set(want)) > 100


def test_held_texts_reach_no_worker(spark, monkeypatch):
    """With the UDF out of the way, texts of which one holds the other still have their ratio."""
    monkeypatch.setattr(align, "_ratcliff", lambda left, right: F.lit(None).cast("double"))
    held = spark.createDataFrame([("abcdef", "cde"), ("b", "abc"), ("abc", "acb")], "l string, r string")
    assert [r[0] for r in held.select(align.similarity(F.col("l"), F.col("r"))).collect()] == [2 * 3 / 9, 2 * 1 / 4, None]


def test_stable_samples_keep_to_the_jvm(spark):
    """Without texts that need Unicode's rules there is no Python step; one such sample adds a branch of its own."""
    schema = "run_id string, sample_id long, seg_index long, start_ms long, end_ms long, text string"
    rows = [("r" if i % 5 else None, i % 4, i, i * 100, i * 100 + 90, f"Ab é {i % 3}") for i in range(40)]
    odd = [("r", 3, 99, 20, 50, "ＡＢ １２"), (None, 1, 98, 20, 50, "ﬁ ３")]
    run = lambda data: align.align(spark.createDataFrame(data, schema), spark.createDataFrame(rows, schema), with_ratio=False)
    assert "ArrowEvalPython" not in run(rows)._jdf.queryExecution().optimizedPlan().toString()
    mixed = run(rows + odd)
    assert mixed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got, plain = ({(r.run_id, r.sample_id, r.secondary_index, tuple(r.primary_indexes)): r.token_mismatch for r in x.collect()} for x in (mixed, run(rows)))
    assert len(got) == len(plain) + 2 and got["r", 3, None, (99,)] == ["12", "ab"] and got[None, 1, None, (98,)] == ["3", "fi"]
