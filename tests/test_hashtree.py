"""Snapshot trees: equal to the comparison of all files, and folders that didn't change are not read."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from capsieve.operators import hashtree, snapshot

SCHEMA = "path string, exists boolean, size bigint, mtime timestamp, sha256 string, note string"


def prints(spark, rows):
    return spark.createDataFrame([(p, e, s, None, h, "x") for p, e, s, h in rows], SCHEMA).withColumn(
        "mtime", F.timestamp_seconds("size")
    )


@pytest.fixture
def stored(spark, tmp_path):
    def build(base, now):
        roots = [f"file://{tmp_path}/{n}" for n in ("base", "now")]
        frames = [prints(spark, rows) for rows in (base, now)]
        for frame, root in zip(frames, roots):
            hashtree.store(frame, root)
        return roots, frames

    return build


def plain(base, now):
    lost = snapshot.diff_full(base.filter("path is not null"), now).filter("not matches")
    gone = {r["path"]: "missing" if r["exists"] and not r["now_exists"] else "changed" for r in lost.collect()}
    added = {r["path"]: "added" for r in now.join(base, "path", "left_anti").filter("path is not null").collect()}
    return gone | added


FILES = [(f"/m/{a}/{b}/{c}.mp4", True, a * 100 + b * 10 + c, f"h{a}{b}{c}") for a in range(6) for b in range(4) for c in range(3)]


def test_equals_full_comparison(spark, stored):
    extra = [("top", True, 1, "h"), ("/m/0/x", True, 2, None), ("/m/1/y", True, 3, "h"), ("/m/2/gone/z", False, None, None), (None, True, 1, "h")]
    now = [f for f in FILES if f[0] != "/m/3/1/2.mp4"]
    now = [(p, e, s + (p == "/m/0/0/0.mp4"), "other" if p == "/m/5/3/1.mp4" else h) for p, e, s, h in now]
    now += [("top", True, 1, "h"), ("/m/0/x", True, 2, "known now"), ("/m/1/y", True, 3, None), ("/new/deep/er/f", True, 1, "h")]
    (base_root, now_root), (base, current) = stored(FILES + extra, now)
    rows = hashtree.diff(spark, base_root, now_root).collect()
    found = {r["path"]: r["change"] for r in rows}
    assert len(found) == len(rows) and found == plain(base, current)
    assert found == {
        "/m/3/1/2.mp4": "missing", "/m/0/0/0.mp4": "changed", "/m/5/3/1.mp4": "changed", "/m/1/y": "changed", "/new/deep/er/f": "added"
    }


def test_reads_only_what_differs(spark, stored):
    (base_root, now_root), _ = stored(FILES, [(p, e, s, "new" if p == "/m/2/2/0.mp4" else h) for p, e, s, h in FILES])
    assert [r[0] for r in hashtree.changed_folders(spark, base_root, now_root).collect()] == ["/m/2/2"]
    mine = spark.createDataFrame([("/m/2/2",)], "folder string").select(F.pmod(F.xxhash64("folder"), F.lit(hashtree.BUCKETS))).first()[0]
    for root in (base_root, now_root):
        for part in glob.glob(f"{root.removeprefix('file://')}/files/bucket=*"):
            if os.path.basename(part) != f"bucket={mine}":
                shutil.rmtree(part)  # unchanged folders are gone and nobody misses them
    assert [tuple(r) for r in hashtree.diff(spark, base_root, now_root).collect()] == [("/m/2/2/0.mp4", "changed")]


def test_equal_and_empty(spark, stored):
    (a, b), _ = stored(FILES, FILES[::-1])
    assert hashtree.diff(spark, a, b).isEmpty()


def test_empty_sides(spark, stored):
    (a, b), _ = stored([], FILES)
    assert {r["change"] for r in hashtree.diff(spark, a, b).collect()} == {"added"}
    assert {r["change"] for r in hashtree.diff(spark, b, a).collect()} == {"missing"}


def test_digest_is_of_the_whole_subtree(spark):
    tree = {r["folder"]: r for r in hashtree.folders(prints(spark, FILES)).collect()}
    assert (tree[""]["files"], tree["/m"]["files"], tree["/m/0"]["files"], tree["/m/0/1"]["files"]) == (72, 72, 12, 3)
    assert tree["/m/0"]["own"] is None and tree["/m/0/1"]["own"] == tree["/m/0/1"]["below"] and tree[""]["parent"] is None
    plan = hashtree.folders(prints(spark, FILES))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
