import random
import re

import pytest

import corpus_pipeline
from capsieve.llm import private, quality
from tests_llm_helpers import brute_components, brute_spans  # noqa: F401


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {0: {r.doc_id: r.text for r in docs.collect()}}
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        docs = stage(spark, docs, sf)
        seen.append(name)
        if n < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            docs = corpus_pipeline.materialize(docs)
            kept[n] = {r.doc_id: r.text for r in docs.collect()}
    packed = docs.collect()
    assert seen == ["quality classifier", "exact dedup", "n-gram Jaccard join", "personal data", "packing"]
    judged = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"))
    assert set(kept[1]) == {r.doc_id for r in judged.collect() if r.kept} and len(kept[1]) < len(kept[0])
    groups = {}
    for i, t in kept[1].items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        groups[low] = max(i, groups.get(low, i))
    assert set(kept[2]) == set(groups.values())
    assert set(kept[3]) == {c for _, c in brute_components(list(kept[2].items()))}
    for i, t in kept[3].items():
        base = brute_spans(t)
        assert (kept[4][i] == t) or base or "<" in kept[4][i]
        for start, place, end in base:  # nothing of a base span is left, and what stands before the first one is
            assert kept[4][i].count(t[start:end]) < t.count(t[start:end]) or len(t[start:end]) < 8
        assert kept[4][i].count(f"<{private.KINDS[base[0][1]]}>") > t.count(f"<{private.KINDS[base[0][1]]}>") if base else True
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept[4].items()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == words


def test_registered(spark, sf):
    import __spark_entry__ as contract

    assert contract.queries()["pipeline"](spark, sf).count() > 0
    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of documents with re-used and missing ids, null and empty texts, and a further column that clashes."""
    rng = random.Random(7)
    words = ["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there", "every", "day", "with", "dogs", "talking", "of", "rain"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    good = [(i, text(60)) for i in range(1, 41)]
    near = " ".join(good[0][1].split()[:-1] + ["end"])
    junk = "qzx! " * 5 + "".join(rng.choice("zxqjvk#@") for _ in range(300))
    rows = [*good, (50, good[5][1]), (50, junk), (51, near), (51, text(61)), (None, good[7][1]), (None, junk + "w"), (None, good[1][1]), (60, None), (61, ""), (None, None)]
    rows += [(70, good[2][1]), (70, good[2][1]), (71, "write to jo@example.org, please, " + text(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _digest2 string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in [*range(1, 41), 51, 71]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, junk, near


def test_reused_and_missing_ids(spark, tables):
    folder, rows, junk, near = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        assert docs.columns == columns
        left.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    assert left[0] == sorted((r for r in rows if not (r[1] or "").startswith("qzx!")), key=repr)
    ids = [i for i, _ in left[1]]
    assert ids.count(50) == 1 and ids.count(51) == 2 and ids.count(70) == 1 and not {3, 6} & set(ids)  # the largest id stays
    assert sum(not t for _, t in left[1]) == 1 and (None, rows[1][1]) not in left[1]
    assert [r for r in left[1] if r not in left[2]] == [(51, near)]  # the other text of id 51 stays
    assert any("<email>" in (t or "") for i, t in left[3] if i == 71)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_and_few_columns(spark, tables):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
        docs = corpus_pipeline.materialize(stage(spark, docs, folder)) if stage is not corpus_pipeline.packed else docs
    assert docs.columns == ["doc_id", "text", "lang"]
