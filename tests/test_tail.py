"""The tail of a log against the plain rule, with the lines of a run dealt over tasks in any order."""

import random

from capsieve.operators import progress

LOG = "run_id string, line_no bigint, value string"


def plain(rows, chars):
    runs = {}
    for run, seq, value in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
        runs.setdefault(run, []).append(value)
    found = {run: "\n".join(lines).strip()[-chars:] for run, lines in runs.items()}
    return {run: tail for run, tail in found.items() if tail}


def check(spark, rows, chars, parts=5):
    df = spark.createDataFrame(rows, LOG).repartition(parts)
    got = progress.output_tail(df, chars=chars).collect()
    assert {r["run_id"]: r["tail"] for r in got} == plain(rows, chars) and len(got) == len({r["run_id"] for r in got})


def test_brute_force(spark):
    rng = random.Random(5)
    for chars in (1, 7, 40):
        rows = []
        for run in range(30):
            solid = rng.choice(("a  ", "ab\t ", "　é😀 ", "   "))
            for seq in range(rng.randint(1, 60)):
                width = rng.choice((0, 0, 1, 3, 3 * chars))
                rows.append((f"r{run}", seq * 3, "".join(rng.choices(solid, k=width)) if rng.random() < 0.7 else " " * (width % 5)))
        check(spark, rows, chars)


def test_long_blanks_and_ends(spark):
    wide = " " * 3000
    rows = [
        ("lead", 1, wide + "x" + wide + "y"), ("lead", 2, ""), ("trail", 1, "a"), ("trail", 2, "b" + wide), ("trail", 3, wide),
        ("inner", 1, "a" + wide), ("inner", 2, "b"), ("one", 5, wide + "z" + wide), ("blank", 1, wide), ("empty", 1, ""),
    ]
    rows += [("pause", 1, "first")] + [("pause", n, "") for n in range(2, 4000)] + [("pause", 4000, "last")]
    rows += [("open", 1, "first")] + [("open", n, " ") for n in range(2, 4000)]
    check(spark, rows + [(None, 1, "x"), ("none", None, "x"), ("null", 1, None), ("null", 2, "kept")], 1200)


def test_one_run_holds_most_lines(spark, monkeypatch):
    monkeypatch.setattr(progress, "HELD_ROWS", 50)
    rows = [("hot", n, f"line {n}") for n in range(20_000)] + [(f"r{n}", 1, str(n)) for n in range(500)]
    check(spark, rows, 1200, parts=8)


def test_a_task_keeps_no_more_than_the_tail():
    import pandas as pd

    frames = [pd.DataFrame({"run": "r", "seq": range(a, a + 5000), "text": "x" * 59}) for a in (0, 5000, 10_000)]
    (kept,) = progress._newest("run", "seq", 1200)(iter(frames))
    assert list(kept["seq"]) == list(range(14_999, 14_978, -1))


def test_empty(spark):
    check_empty = progress.output_tail(spark.createDataFrame([], LOG))
    assert check_empty.columns == ["run_id", "tail"] and check_empty.isEmpty()
