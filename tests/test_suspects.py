"""Texts of ASCII alone are not searched for joining letters."""

import re

from pyspark.sql import functions as F

from capsieve.operators import quality


def test_ascii_is_told_by_length(spark):
    assert not re.search("[%s%s]" % (quality.JOINING.replace(r"\p{M}", ""), quality.SPACING), "".join(map(chr, range(128))))
    rows = [("r", 1, 0, "plain"), ("r", 2, 0, "e\u0301"), ("r", 3, 0, "\u00e9"), ("r", 4, 0, None), ("r", 5, 0, ""), ("r", 6, 0, "\u00a8")]
    df = spark.createDataFrame(rows, "run_id string, sample_id long, seg_index long, text string")
    some = quality._suspects(df, quality.KEYS)
    assert sorted(r.sample_id for r in some.collect()) == [2, 6]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan and "length(text" in plan
    assert quality._suspects(df.filter(F.col("sample_id").isin(1, 3, 4, 5)), quality.KEYS) is None
