"""Logs that grow while they are read, and run state that ends."""

import json
import random

import pytest

from capsieve.operators.progress import ENGINES
from capsieve.sources import growing
from capsieve.sources.eventlog import events
from capsieve.streaming import lifecycle
from capsieve.streaming import progress as live


def test_each_line_is_in_one_range(tmp_path):
    rng = random.Random(0)
    for k in range(60):
        content = "".join(rng.choice(["", "a", "é", "line", "\r", "x" * 40]) + rng.choice(["\n", "", "\n\n"]) for _ in range(rng.randint(0, 30))).encode()
        (tmp_path / f"{k}.log").write_bytes(content)
        cuts = sorted({0, len(content), *(rng.randint(0, len(content)) for _ in range(4))})
        found = [x for a, b in zip(cuts, cuts[1:]) for x in growing.lines(growing.LogRange(f"{tmp_path}/{k}.log", a, b), rng.choice([1, 2, 7, 1000]))]
        whole, at = [], 0
        for line in content.split(b"\n")[:-1]:
            whole.append((at, line))
            at += len(line) + 1
        assert found == whole


def test_many_short_logs_share_a_task(tmp_path):
    for k in range(1000):
        (tmp_path / f"{k}.log").write_bytes(b"one\ntwo\nha")
    (tmp_path / "long.log").write_bytes(b"x\n" * 50)
    parts = growing.ranges(str(tmp_path), {}, growing.sizes(str(tmp_path)), 60)
    tasks = growing.packed(str(tmp_path), parts, 6000, 300)
    assert len(tasks) <= 6 and sum(len(t.parts) for t in tasks) == len(parts) == 1002
    assert all(len(t.parts) <= 300 and sum(b - a for _, a, b in t.parts) <= 6000 for t in tasks)
    rows = [r for t in tasks for b in growing.batches(t, 70) for r in b.to_pylist()]
    assert sorted((r["run_id"], r["line_no"], r["value"]) for r in rows) == sorted(
        [(str(k), at, v) for k in range(1000) for at, v in ((0, "one"), (4, "two"))] + [("long", 2 * k, "x") for k in range(50)]
    )


def test_ranges(tmp_path):
    (tmp_path / "a.log").write_bytes(b"x" * 25)
    (tmp_path / "notes.txt").write_bytes(b"no log")
    now = growing.sizes(str(tmp_path))
    assert now == {"a.log": 25} and growing.sizes(f"file://{tmp_path}/nothing") == {}
    parts = growing.ranges(str(tmp_path), {"a.log": 4}, now, 10)
    assert [(p.start, p.end) for p in parts] == [(4, 14), (14, 24), (24, 25)]
    with pytest.raises(ValueError):
        growing.ranges(str(tmp_path), {"a.log": 26}, now)


def test_half_lines_wait(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    seen = []
    for piece in (b"one\ntw", b"o\r\n\xff bad", b" end", b"\nlast\n"):
        with open(folder / "r 1.log", "ab") as file:
            file.write(piece)
        (folder / "empty.log").touch()
        rows = live.drain(growing.read_logs(spark, str(folder)), out)
        seen.append(sorted((r.run_id, r.line_no, r.value) for r in rows.collect()))
    assert [len(s) for s in seen] == [1, 2, 2, 4]
    assert seen[-1] == [("r 1", 0, "one"), ("r 1", 4, "two"), ("r 1", 9, "� bad end"), ("r 1", 19, "last")]
    batch = growing.read_logs(spark, str(folder), stream=False)
    assert sorted((r.run_id, r.line_no, r.value) for r in batch.collect()) == seen[-1]
    (tmp_path / "none").mkdir()
    assert growing.read_logs(spark, str(tmp_path / "none"), stream=False).collect() == []


def step(video, engine=ENGINES[0]):
    return json.dumps({"event": "progress", "engine": engine, "index": 1, "total": 9, "video_path": video})


def failed(sample):
    return json.dumps({"event": "candidate_failed", "phase": "setup", "reason": "r", "video_path": "v", "sample_id": sample})


DONE = json.dumps({"event": "done", "run_dir": "/r"})


class Logs:
    def __init__(self, spark, folder):
        self.spark, self.folder = lifecycle.with_states(spark), folder
        (folder / "logs").mkdir()

    def append(self, run, *lines):
        with open(self.folder / "logs" / f"{run}.log", "a") as file:
            file.writelines(f"{x}\n" for x in lines)

    def parsed(self, stream=True):
        return events(growing.read_logs(self.spark, str(self.folder / "logs"), stream).drop("path"))

    def rows(self):
        return live.drain(lifecycle.fold_runs(self.parsed()), str(self.folder / "out"), "update")


def test_stream_equals_batch(spark, tmp_path):
    logs, rng = Logs(spark, tmp_path), random.Random(4)
    for _ in range(3):
        for run in range(6):
            lines = [rng.choice([step(f"v{rng.randint(0, 3)}", rng.choice([*ENGINES, "other"])), failed(f"S{rng.randint(0, 2)}"), "human line"]) for _ in range(rng.randint(0, 9))]
            if rng.random() < 0.3:
                lines.insert(rng.randint(0, len(lines)), DONE)
            logs.append(run, *lines)
        rows = logs.rows()
    batch = lifecycle.fold_batch(logs.parsed(False))
    order = lambda df: sorted(map(repr, map(tuple, df.select(*batch.columns).collect())))
    assert order(lifecycle.settled(rows)) == order(batch)
    assert {r.kind for r in batch.collect()} == {"progress", "failure", "late"}


def test_state_ends(spark, tmp_path):
    logs = Logs(spark, tmp_path)
    logs.append("a", *[step(f"v{i}", e) for i in range(20) for e in ENGINES], failed("S1"), failed("S1"))
    logs.append("b", step("v"))
    got, sizes = [], []

    def run():
        stream = lifecycle.fold_runs(logs.parsed(), grace_ms=0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        query = stream.foreachBatch(lambda rows, n: got.extend(rows.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])

    run()
    logs.append("a", DONE, step("late"))
    run()
    logs.append("b", step("v"))
    run()  # the timer removes the mark
    logs.append("a", step("again"))
    run()
    kinds = [(r.run_id, r.kind, r.completed, r.steps, r.done) for r in got if r.run_id == "a"]
    assert kinds[0][1] == "failure"
    assert [k[1:] for k in kinds[1:]] == [("progress", 20, 40, False), ("progress", 20, 40, True), ("late", 20, 40, True), ("progress", 0, 1, False)]
    assert sizes[0] > 60 and sizes[1] <= 5 and sizes[2] == 3  # what is left is of run b
