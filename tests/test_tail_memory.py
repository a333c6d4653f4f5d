"""Log tails: what a task holds is bounded by rows and by characters, whatever the number of runs."""

import pandas as pd

from capsieve.operators import progress


def test_held_lines_are_bounded():
    def frames():
        for k in range(30):
            yield pd.DataFrame({"run_id": range(k * 2000, k * 2000 + 2000), "line_no": 1, "text": "x" * 1200, "after": " " * 1200, "lead": 0})

    given = list(progress._newest("run_id", "line_no", 1200)(frames()))
    assert sum(len(g) for g in given) == 60_000 and len({r for g in given for r in g["run_id"]}) == 60_000
    assert max(len(g) * 2400 for g in given) <= (16 << 20) + 2000 * 2400

    short = [pd.DataFrame({"run_id": range(k * 10_000, k * 10_000 + 10_000), "line_no": 1, "text": "x", "after": "", "lead": 0}) for k in range(20)]
    assert max(len(g) for g in progress._newest("run_id", "line_no", 1200)(iter(short))) <= 60_000
