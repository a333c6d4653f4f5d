"""Reports of runs as one transaction: a lost writer, two writers, replaced runs, damaged files."""

import glob
import os
import shutil

import pytest

from capsieve.sources import publish


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/published"


def reports(spark, rows, entries):
    return {
        "quality": spark.createDataFrame(rows, "run_id string, sample_id long, score double"),
        "entries": spark.createDataFrame(entries, "run_id string, target string, tags map<string,int>"),
    }


def held(spark, root, report, version=None):
    return sorted(map(repr, map(tuple, publish.read(spark, root, report, version).collect())))


FIRST = [("001", 1, 0.5), ("001", 2, None), ("r b/=", 1, 0.25)]
ENTRIES = [("001", "/a", {"x": 1, "y": 2}), ("r b/=", "/b", None)]


def test_replaces_runs(spark, root):
    assert publish.publish(spark, root, reports(spark, FIRST, ENTRIES)) == 1
    assert held(spark, root, "quality") == sorted(map(repr, FIRST))
    assert publish.publish(spark, root, reports(spark, [("001", 9, 0.75), ("new", 1, 1.0)], [])) == 2
    assert held(spark, root, "quality") == sorted(map(repr, [("001", 9, 0.75), ("new", 1, 1.0), FIRST[2]]))
    assert held(spark, root, "entries") == [repr(ENTRIES[1])]  # run 001 has none any more
    assert held(spark, root, "entries", 1) == sorted(map(repr, ENTRIES))
    found = publish.check(spark, root).collect()
    assert len(found) == 6 and all(r["same"] for r in found)
    only = {"quality": reports(spark, [("r b/=", 5, 5.0)], [])["quality"]}
    assert publish.publish(spark, root, only) == 3
    assert held(spark, root, "entries") == [repr(ENTRIES[1])]  # a report that isn't given stays


def test_lost_between_reports(spark, root, monkeypatch):
    publish.publish(spark, root, reports(spark, FIRST, ENTRIES))
    broken = reports(spark, [("001", 9, 9.0)], [])
    broken["entries"] = spark.createDataFrame([("001",)], "run_id string").selectExpr("run_id", "CAST(raise_error('lost') AS STRING) AS target")
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, root, broken)
    assert held(spark, root, "quality") == sorted(map(repr, FIRST)) and publish.versions(spark, root) == [1]
    # lost after all reports are written, and while the manifest is put in place
    base = 1
    prepared = publish.prepare(spark, root, reports(spark, [("001", 9, 9.0)], []))
    assert held(spark, root, "quality") == sorted(map(repr, FIRST))
    with monkeypatch.context() as m:
        m.setattr(publish.Folder, "place", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            publish.commit(spark, root, prepared, base)
    assert held(spark, root, "quality") == sorted(map(repr, FIRST))
    assert publish.sweep(spark, root) == []  # they are new
    assert len(publish.sweep(spark, root, older_than_seconds=-10)) == 2
    assert held(spark, root, "quality") == sorted(map(repr, FIRST))
    assert publish.publish(spark, root, reports(spark, [("001", 3, 3.0)], [])) == 2


def test_two_writers(spark, root):
    publish.publish(spark, root, reports(spark, FIRST, ENTRIES))
    one = publish.prepare(spark, root, reports(spark, [("001", 7, 7.0)], []))
    two = publish.prepare(spark, root, reports(spark, [("other", 8, 8.0)], []))
    three = publish.prepare(spark, root, reports(spark, [("001", 9, 9.0)], []))
    assert publish.commit(spark, root, two, 1) == 2
    assert publish.commit(spark, root, one, 1) == 3  # another run: built anew on the other's
    with pytest.raises(publish.Conflict):
        publish.commit(spark, root, three, 1)
    assert held(spark, root, "quality") == sorted(map(repr, [("001", 7, 7.0), ("other", 8, 8.0), FIRST[2]]))


def test_sweep_keeps_what_versions_use(spark, root):
    for k in range(4):
        publish.publish(spark, root, reports(spark, [(f"r{k % 2}", k, float(k))], []))
    assert len(publish.sweep(spark, root, keep=1, older_than_seconds=-10)) == 2
    assert publish.versions(spark, root) == [4]
    assert held(spark, root, "quality") == sorted(map(repr, [("r0", 2, 2.0), ("r1", 3, 3.0)]))


def test_damage_shows(spark, root):
    publish.publish(spark, root, reports(spark, FIRST, ENTRIES))
    folder = next(p for p in glob.glob(f"{root[7:]}/data/quality/attempt=*/run_id=*") if p.endswith("001"))
    shutil.rmtree(folder)
    bad = [tuple(r) for r in publish.check(spark, root).where("NOT same").collect()]
    assert bad == [("001", "quality", 2, 0, False)]
    assert os.path.isdir(root[7:])


def test_nothing_published(spark, root):
    with pytest.raises(ValueError):
        publish.read(spark, root, "quality")
    assert publish.check(spark, root).collect() == [] and publish.sweep(spark, root) == []
    with pytest.raises(ValueError):
        publish.publish(spark, root, reports(spark, [(None, 1, 1.0)], []))
    assert publish.publish(spark, root, reports(spark, [], [])) == 1
    assert publish.manifest(spark, root).count() == 0
