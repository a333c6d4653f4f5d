"""Caption rules over ranges against the rules over whole files."""

import random

from capsieve.operators.caption_ranges import numbered_pieces, validate_ranges, whole_lines
from capsieve.operators.captions import validate_captions


def damaged(rng):
    """A caption file, most often with something wrong."""
    second, blocks = 0, []
    for _ in range(rng.randint(0, 6)):
        second += rng.choice([0, 1, 59, 3_700, -1 if rng.random() < 0.1 else 2])
        time = f"{second // 3600}:{second // 60 % 60:02d}:{second % 60:02d}" if second >= 3600 else f"{second // 60:02d}:{second % 60:02d}"
        blocks.append(f"{time}\r\n{rng.choice(['a', 'é日本', 'x' * 30, 'two words'])}\r\n")
    raw = "\r\n".join(blocks).encode()
    for _ in range(rng.choice([0, 0, 1, 1, 2])):
        at, piece = rng.randint(0, len(raw)), rng.choice([b"\n", b"\r", b"\r\n", b"\xff", b"\xef\xbb\xbf", b"x", b"", b"\r\r\n", b"00:01\r\n"])
        raw = rng.choice([raw[:at] + piece + raw[at:], raw[:at] + raw[at + 1 :], piece + raw, raw + piece])
    return raw


def test_equal_to_whole_files(spark):
    rng = random.Random(5)
    whole = [("r", i, damaged(rng)) for i in range(400)] + [("r", 900, b""), ("r", 901, b"\r\n"), ("r", 902, b"\r"), ("r", 903, b"\xef\xbb"), ("q", 904, b"\xef\xbb\xbf")]
    ranges = []
    for run, i, raw in whole:
        cuts = sorted([0, len(raw), *(rng.randint(0, len(raw)) for _ in range(rng.choice([0, 1, 3, 8, 40])))])
        ranges += [(run, i, k, raw[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rng.shuffle(ranges)
    want = validate_captions(spark.createDataFrame(whole, "run_id string, sample_id long, caption binary")).drop("caption")
    got = validate_ranges(spark.createDataFrame(ranges, "run_id string, sample_id long, part_no long, caption binary"))
    order = lambda df: sorted(map(repr, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    assert order(got) == order(want)
    assert len({r["format_code"] for r in want.collect()}) >= 8


def test_lines_of_any_cut(spark):
    raw = "one\r\ntwo é\r\n\r\n\rthree\r\r\nfour".encode()
    ranges = spark.createDataFrame([("r", "s", i, raw[i : i + 1]) for i in range(len(raw))] + [("r", "s", 99, b"")], "run_id string, sample_id string, part_no int, caption binary")
    lines = whole_lines(numbered_pieces(ranges)).orderBy("line_no").collect()
    assert [bytes(r["line"]) for r in lines] == raw.split(b"\r\n") and [r["last"] for r in lines] == [False] * 4 + [True]
    assert validate_ranges(ranges.limit(0)).collect() == []
