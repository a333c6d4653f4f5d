"""Texts that NFKC leaves alone don't pass a Python worker, and get what those beside them get there."""

import random
import unicodedata

from pyspark.sql import functions as F

from capsieve.functions.text import by_need, comparison_text, needs_unicode, normalize_text
from capsieve.operators import captions, quality

SIGNS = [*"abZ 9.,:!?<|>\t\n", "ß", "é", "È", "“", "…", "，", "中", "カ", "ﾊ", "ﾞ", "가", "ᆨ", "́", "²", "\x85", "İ"]
SCHEMA = "run_id string, sample_id long, seg_index long, start_ms long, end_ms long, text string"


def rows(n):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 6)))
    return [("r", i % 9, i, i * 100, i * 100 + 50, None if i % 50 == 7 else rng.choice((text(), "<|en|>x", "ab"))) for i in range(n)]


def test_both_ways_agree(spark):
    df = spark.createDataFrame(rows(900), SCHEMA)
    for rule in (comparison_text, normalize_text):
        made = lambda part, stable: part.select("seg_index", rule(F.col("text"), stable).alias("t"))  # noqa: E731, B023
        got = dict(map(tuple, by_need(df, made).collect()))
        assert got == dict(map(tuple, made(df, False).collect())) and len(got) == 900
    want = {r[2]: None if r[5] is None else "".join(filter(str.isalnum, unicodedata.normalize("NFKC", r[5]).casefold())) for r in rows(900)}
    folded = lambda part, stable: part.select("seg_index", comparison_text(F.col("text"), stable).alias("t"))
    assert dict(map(tuple, by_need(df, folded).collect())) == want
    assert 100 < df.filter(needs_unicode(F.col("text"))).count() < 800


def test_stable_texts_meet_no_python(spark):
    """The branch of the other texts alone has a Python step, in the metrics, the repetitions and the blocks."""
    df = spark.createDataFrame(rows(60), SCHEMA)
    for made in (quality.longest_duplicate_run(df), captions.caption_blocks(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        union = plan[plan.index("Union") :]
        assert union.count("ArrowEvalPython") == 1 and plan.count("ArrowEvalPython") == 1


def test_no_joining_letter_is_stable(spark):
    signs = spark.range(1, 0xFFFF).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("text"))
    both = signs.filter(quality._joining(F.col("text")) & ~needs_unicode(F.col("text")))
    assert signs.filter(quality._joining(F.col("text"))).count() > 1_000 and both.count() == 0


def test_segments_are_searched_where_letters_join_alone(spark, monkeypatch):
    """Without joining letters in the metrics' own pass the segments aren't read once more for them."""
    monkeypatch.setattr(quality, "_suspects", lambda *_: 1 / 0)
    df = spark.createDataFrame([r for r in rows(60) if r[5] is None or r[5].isascii()], SCHEMA)
    assert quality.transcript_metrics(df, df).count() == 9
