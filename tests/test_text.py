import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from capsieve.functions import paths, text, timecode
from capsieve.operators.align import similarity, token_mismatch


def evaluate(spark, values, expr, schema="v STRING"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {schema}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


ALPHABET = list("aZ09.,:;!? \t\r\n\x1c<|>é ßİ") + ["，", "。", "：", "…", "“", "你", "ａ", "１", "①", "²", "\u0301", "\u2028", "٣", "፩", "ﬁ", "ſ", "Σ", "㌔", "\U00020000"]


def noise(n=1500, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


def test_normalize_vectors(spark):
    given = ["你好，世界。", "A.B", "3:45", "你好<|en|>世界", "  PyTorch\t 2.5 \n"]
    assert evaluate(spark, given, text.normalize_text) == ["你好世界", "A.B", "3:45", "你好世界", "PyTorch 2.5"]


def test_normalize_marks(spark):
    vectors = {
        "a,b": "a b", "a.b": "a.b", "a. b": "a b", ".a": "a", "a.": "a", "1:2": "1:2", "a:b": "a b", "1:": "1", "9;9": "9 9",
        "你.好": "你好", "你:1": "你1", "a!?b": "ab", "a\r\n\tb": "a b", "<|x|>": "", "<|>": "<|>", "ａ，ｂ": "a b", "①.②": "1.2", "": "",
    }
    assert evaluate(spark, list(vectors), text.normalize_text) == list(vectors.values())


def test_normalize_properties(spark):
    given = noise()
    got = evaluate(spark, given, text.normalize_text)
    # Letters that a dropped mark kept apart may compose; elsewhere the rule changes nothing a second time.
    stable = [t for t in got if unicodedata.is_normalized("NFKC", t)]
    assert len(stable) > 0.9 * len(got) and evaluate(spark, stable, text.normalize_text) == stable
    solid = lambda t: [c for c in t if c not in text.DROPPED_MARKS and not c.isspace()]
    kept = re.compile(r"(?<=[A-Za-z0-9])\.(?=[A-Za-z0-9])|(?<=[\d፩]):(?=[\d፩])")
    for raw, out in zip(given, got):
        assert solid(out) == solid(re.sub(r"<\|[^|>]+\|>", "", unicodedata.normalize("NFKC", raw)))
        assert not set(kept.sub("", out)) & set(text.DROPPED_MARKS)
        assert out == " ".join(out.split())


def test_comparison_random(spark):
    given = noise(seed=8)
    want = ["".join(c for c in unicodedata.normalize("NFKC", v).casefold() if c.isalnum()) for v in given]
    assert evaluate(spark, given, text.comparison_text) == want


def test_tokens_random(spark):
    pattern = re.compile(r"[A-Za-z]+(?:[._+#/-][A-Za-z0-9]+)*|\d+(?:\.\d+)?")
    given = noise(seed=9) + ["C++ v1.2-b PyTorch_2 a/b x#y 3.14.15"]
    got = evaluate(spark, given, text.token_set)
    assert [set(x) for x in got] == [{t.casefold() for t in pattern.findall(unicodedata.normalize("NFKC", v))} for v in given]


def test_blank_and_strip_follow_python(spark):
    given = noise(seed=10) + [" \r\n\t", "", "\x1f\u3000", "x"]
    assert evaluate(spark, given, text.is_blank) == [not v.strip() for v in given]
    assert evaluate(spark, given, text.strip_space) == [v.strip() for v in given]


def test_stable_ranges_hold():
    stable = re.compile(f"[{text.STABLE_RANGES}]")
    for cp in range(0x110000):
        c = chr(cp)
        if stable.match(c):
            assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c), hex(cp)
            assert c.casefold() == c.lower().replace("ß", "ss"), hex(cp)


def test_casefold_key(spark):
    given = ["/A/Straße.MP4", "/a/ΣΑΣ.mkv", "/İ.txt"]
    assert evaluate(spark, given, text.casefold) == [v.casefold() for v in given]


def test_decode(spark):
    given = ["你好".encode(), b"\xef\xbb\xbfhi", "hi".encode("utf-16"), b"\xc4\xe3\xba\xc3", b"\x81", b"\xff\xfe\x00"]
    got = evaluate(spark, given, text.decode_text, "v BINARY")
    assert [(r.text, r.encoding, r.bom) for r in got] == [
        ("你好", "utf-8", False), ("hi", "utf-8", True), ("hi", "utf-16-le", True), ("你好", "gb18030", False),
        (None, None, False), (None, None, True),
    ]


def test_initial_states(spark):
    given = [None, b"", b" \r\n\t", b"\xef\xbb\xbf", b"x", b"\x81"]
    want = ["missing", "zero_byte", "whitespace_only", "whitespace_only", "nonempty", "nonempty"]
    assert evaluate(spark, given, text.initial_state, "v BINARY") == want


def test_timestamps(spark):
    given = [0, 3_599_000, 3_600_000, 6_030_000, 90_000_000, -5, 999]
    assert evaluate(spark, given, timecode.format_timestamp, "v BIGINT") == ["00:00", "59:59", "1:00:00", "1:40:30", "25:00:00", "00:00", "00:00"]
    given = ["00:00", "59:59", "1:00:00", "25:00:00", "100:00", "0:00", "0:0", "00:0", "1:2:3", "1::00", "abc", "", "12:34:56:78", "00:00\n"]
    assert evaluate(spark, given, timecode.parse_timestamp) == [0, 3599, 3600, 90000, 6000, 0] + [None] * 8


def test_probe_duration_and_clock(spark):
    given = ["Duration: 00:01:23.45", "x duration:  01:02:03, y", "N/A", "", None]
    assert evaluate(spark, given, timecode.parse_probe_duration) == [pytest.approx(83.45), 3723.0, None, None, None]
    given = ["2026-01-01T00:00:00+00:00", "2026-01-01T01:00:00+01:00", "2026-01-01T00:00:00", "bad", None]
    assert evaluate(spark, given, timecode.iso_epoch) == [1767225600.0] * 3 + [None, None]


def test_estimate(spark):
    rows = spark.createDataFrame([(0, None, 1024), (1, 600.0, 0), (2, 600.0, 8 << 20), (3, 3600.0, 0), (4, 10.0, None)], "i INT, d DOUBLE, s BIGINT")
    got = [r.x for r in rows.select("i", timecode.estimate_seconds(F.col("d"), F.col("s")).alias("x")).orderBy("i").collect()]
    assert got == [None, 210, 211, 1110, 33]


def test_ansi(spark):
    assert evaluate(spark, ["\x1b[Aa\x1b[34mb\x1b[0m[A]"], text.strip_ansi) == ["ab[A]"]


def test_paths(spark):
    given = ["/a/x.MP4", "/a/.mp4", "/a.b/c", "C:\\v\\y.mkv", "/a/x.tar.ts"]
    assert evaluate(spark, given, paths.is_video) == [True, False, False, True, True]
    assert evaluate(spark, given, paths.target_path) == ["/a/x.txt", "/a/.mp4", "/a.b/c", "C:\\v\\y.txt", "/a/x.tar.txt"]
    stems = ["/v/PyTorch-2.0-第3章.mp4", "/v/GPT4-4K.mp4", "/v/C++基础.mp4", "/v/纯数字-123.mp4", "/v/a1b.mp4"]
    assert evaluate(spark, stems, paths.stem_terms) == [["PyTorch"], ["GPT4", "4K"], ["C"], [], ["a1b"]]


def test_similarity_is_the_stdlib_ratio(spark):
    rng = random.Random(3)
    pairs = [("", "a"), ("a", ""), ("ab" * 200, "ab" * 200), ("a" * 300, "a" * 300)]
    pairs += [("".join(rng.choices("abc你", k=rng.randint(1, 260))), "".join(rng.choices("abc你", k=rng.randint(1, 260)))) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING")
    got = [r.x for r in rows.select("i", similarity(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs]


def test_token_mismatch(spark):
    rows = spark.createDataFrame([(["b", "a"], ["a", "c"]), ([], [])], "l ARRAY<STRING>, r ARRAY<STRING>")
    assert [r.x for r in rows.select(token_mismatch(F.col("l"), F.col("r")).alias("x")).collect()] == [["b", "c"], []]


def test_timestamps_beyond_the_usual(spark):
    given = ["１:０２", "٠١:٠٢:٠٣", "999999999999999999:00", "99999999999999999999:00", "1:2", "01:02"]
    assert evaluate(spark, given, timecode.parse_timestamp) == [62, 3723, None, None, None, 62]
