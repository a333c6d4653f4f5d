"""Letters across the borders of segments against the texts in a row."""

import random
import unicodedata

from capsieve.functions.text import normalize_text
from capsieve.operators.quality import transcript_metrics

PIECES = ["ᄀ", "ᅡ", "ᆨ", "가", "ㄱ", "ㅏ", "́", "̣", "e", "E", "é", "ß", "ﾊ", "ﾞ", "¨", "ﱞ", "क", "़", "া", "ে", "12", " ", "", "한", "ͅ", "ｶﾞ", "x"]


def compared(text):
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def test_equal_to_the_whole(spark):
    rng, rows = random.Random(2), []
    for sample in range(300):
        rows += [("r", sample, i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(1_500), rng.randint(1, 7))]
    rows += [("r", 900, 0, "ᄀ"), ("r", 900, 1, "ᅡ"), ("r", 901, 0, "plain"), ("r", 901, 1, "text")]
    df = spark.createDataFrame(rows, "run_id string, sample_id long, seg_index long, text string")
    got = {r["sample_id"]: r for r in transcript_metrics(df, df).collect()}
    shown = {(r["sample_id"], r["seg_index"]): r["n"] for r in df.select("sample_id", "seg_index", normalize_text(df["text"]).alias("n")).collect()}
    for sample in got:
        own = sorted(r[2:] for r in rows if r[1] == sample)
        assert got[sample]["secondary_chars"] == len(compared("".join(t for _, t in own)))
        assert got[sample]["primary_chars"] == len(compared("".join(shown[sample, i] for i, _ in own)))
    assert got[900]["secondary_chars"] == got[900]["primary_chars"] == 1
