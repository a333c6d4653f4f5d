import json
import random
import statistics
import unicodedata
from collections import defaultdict
from difflib import SequenceMatcher
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from capsieve.operators import align, captions, catalog, ordering, profile, progress, quality, runs, snapshot
from capsieve.sources import eventlog, files, sinks, transcripts

SEG = "run_id STRING, sample_id STRING, seg_index BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING"


def segments(spark, rows, sample="s", extra=""):
    return spark.createDataFrame([("r", sample, i, *row) for i, row in enumerate(rows)], SEG + extra)


# --- ordering ------------------------------------------------------------------------------------


def test_numbering_is_total_and_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ordering.number_rows(rows, [F.col("v")]).orderBy("v").collect()
    assert [(r.v, r.row_no) for r in got] == [(i, i + 1) for i in range(1000)]


def test_blocked_lag_and_sums_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 9)) for k in ("hot", "cold") for i in range(200 if k == "hot" else 7) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k STRING, i BIGINT, v BIGINT")
    lagged = ordering.lag_in_blocks(df, ["k"], F.floor(F.col("i") / 16), ["i"], ["v"]).collect()
    summed = ordering.running_sum_in_blocks(df, ["k"], F.floor(F.col("i") / 16), ["i"], {"t": F.col("v")}).collect()
    for k in ("hot", "cold"):
        own = sorted(r for r in rows if r[0] == k)
        assert [(r.previous and r.previous.v) for r in sorted((r for r in lagged if r.k == k), key=lambda r: r.i)] == [None] + [r[2] for r in own[:-1]]
        assert [r.t for r in sorted((r for r in summed if r.k == k), key=lambda r: r.i)] == [sum(x[2] for x in own[:i]) for i in range(len(own))]


# --- files and catalog ---------------------------------------------------------------------------


def test_catalog_from_folders(spark, tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    (root / "sub").mkdir()
    for name in ("a.mp4", "b.MKV", "c.mov", "d.ts", ".mp4", "x.jpg", "sub/_e.avi"):
        (root / name).write_bytes(b"v")
    (root / "b.txt").write_bytes(b"")
    (root / "c.txt").write_bytes(b" \r\n")
    (root / "d.txt").write_bytes("你好".encode())
    (root / "notes.txt").write_bytes(b"keep")
    (root / "empty.txt").write_bytes(b"")
    media = catalog.dedupe_paths(files.scan_media(spark, [str(root), str(root)]))
    texts = files.scan_texts(spark, [str(root)])
    targeted = catalog.with_targets(media)
    got = catalog.candidates(targeted, texts).orderBy("sample_id").collect()
    assert [(r.sample_id, r.video_path.rsplit("/", 1)[1], r.initial_state) for r in got] == [
        ("CC-CANDIDATE-00001", "a.mp4", "missing"), ("CC-CANDIDATE-00002", "b.MKV", "zero_byte"),
        ("CC-CANDIDATE-00003", "c.mov", "whitespace_only"), ("CC-CANDIDATE-00004", "d.ts", "nonempty"),
        ("CC-CANDIDATE-00005", "_e.avi", "missing"),
    ]
    assert [r.path.rsplit("/", 1)[1] for r in catalog.protected_texts(targeted, texts).collect()] == ["notes.txt"]
    import hashlib

    base = files.fingerprints(files.list_files(spark, [str(root)]))
    assert {r.sha256 for r in base.filter("path LIKE '%d.txt'").collect()} == {hashlib.sha256("你好".encode()).hexdigest()}
    counts = catalog.discovery_summary(targeted, texts).first().asDict()
    assert counts == {"video_count": 5, "matched_text_count": 3, "missing_text_count": 2, "candidate_count": 5, "conflict_count": 0, "protected_count": 1}


@pytest.mark.parametrize("names, videos, conflicts, left", [
    (["episode.mp4", "episode.mkv", "standalone.mp4"], 3, 1, 1), (["EPISODE.MP4", "episode.mkv"], 2, 1, 0),
])
def test_conflicts(spark, names, videos, conflicts, left):
    listed = spark.createDataFrame([(f"/m/{n}", 0, 1) for n in names], "path STRING, root_ord INT, length BIGINT")
    targeted = catalog.with_targets(catalog.dedupe_paths(listed))
    rows = catalog.conflicts(targeted).orderBy("position").collect()
    assert len({r.target_path for r in rows}) == conflicts and len(rows) == 2
    assert rows[0].video_path.lower() == "/m/episode.mkv" and rows[0].target_path == "/m/episode.txt"
    assert targeted.count() == videos and catalog.without_conflicts(targeted).count() == left


def test_terms(spark, tmp_path):
    (tmp_path / "t.txt").write_text("\ufeff# c\n\nAlpha, beta\r\n机器学习\n", encoding="utf-8")
    listed = files.read_terms(spark, str(tmp_path / "t.txt"))
    cands = spark.createDataFrame([("r", "1", "/v/Alpha-01.mp4"), ("r", "2", "/v/beta-2.0.mp4"), ("r", "3", "/v/PyTorch-1.mp4")], "run_id STRING, sample_id STRING, video_path STRING")
    assert [r.term for r in catalog.terms(cands, listed).collect()] == ["Alpha", "beta", "机器学习", "PyTorch"]
    many = spark.createDataFrame([(i, f"own{i}") for i in range(60)], "position BIGINT, term STRING")
    extra = spark.createDataFrame([(run, f"{i:03d}", f"/v/{run}{i}.mp4") for run in ("a", "b") for i in range(150)], "run_id STRING, sample_id STRING, video_path STRING")
    got = catalog.terms(extra, many).orderBy("run_id", "place").collect()
    for run in ("a", "b"):  # the limit is a run's own
        own = [r.term for r in got if r.run_id == run]
        assert len(own) == 200 and own[0] == "own0" and own[-1] == f"{run}139"


def test_exclusions(spark, tmp_path):
    good, bad, worse = tmp_path / "g.json", tmp_path / "b.json", tmp_path / "w.json"
    good.write_text('\ufeff["/a.mp4", "/b.mp4", "/a.mp4"]', encoding="utf-8")
    bad.write_text('{"a": 1}')
    worse.write_text('["/a.mp4", 3]')
    assert {r.video_path for r in files.read_exclusions(spark, str(good)).collect()} == {"/a.mp4", "/b.mp4"}
    for path in (bad, worse):
        with pytest.raises(Exception):
            files.read_exclusions(spark, str(path)).collect()


def test_optional_json(spark, tmp_path):
    for name, body in (("a", '{"run_id": "x", "status": "committed"}'), ("b", "[1]"), ("c", "{broken"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(body)
    got = files.read_optional_json(spark, str(tmp_path / "*.json"), "run_id STRING, status STRING").collect()
    assert [(r.run_id, r.status) for r in got] == [("x", "committed")]
    assert files.read_optional_json(spark, str(tmp_path / "none.json"), "run_id STRING").count() == 0


def test_snapshots(spark):
    fp = "path STRING, exists BOOLEAN, size BIGINT, mtime TIMESTAMP, sha256 STRING"
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    base = spark.createDataFrame([("same", True, 1, t, "h"), ("bytes", True, 1, t, "h"), ("size", True, 1, t, "h"), ("gone", True, 1, t, "h"), ("nohash", True, 1, t, None), ("quick", True, 1, t, "h"), ("absent", False, None, None, None)], fp)
    now = spark.createDataFrame([("same", True, 1, t, "h"), ("bytes", True, 1, t, "x"), ("size", True, 2, t, "h"), ("nohash", True, 1, t, "h"), ("quick", True, 1, t, None)], fp)
    quick = {r.path: r.matches for r in snapshot.diff_quick(base, now).collect()}
    full = {r.path: r.matches for r in snapshot.diff_full(base, now).collect()}
    assert quick == {"same": True, "bytes": True, "size": False, "gone": False, "nohash": True, "quick": True, "absent": True}
    assert full == {"same": True, "bytes": False, "size": False, "gone": False, "nohash": True, "quick": False, "absent": True}


# --- transcripts ---------------------------------------------------------------------------------


def test_secondary_clamp(spark):
    raw = spark.createDataFrame([(551.7018, 551.7020, "a", 551.701312), (0.0, 1.234, " b ", 5.0), (-0.5, 1.0, "c", 5.0), (1.0, 10.0, "d", 5.0), (1.0, 2.0, "  ", 5.0)], "start DOUBLE, end DOUBLE, text STRING, d DOUBLE")
    got = transcripts.clamp_secondary(raw, F.col("d")).select("start_ms", "end_ms", "text").collect()
    assert [tuple(r) for r in got] == [(0, 1234, "b"), (0, 1000, "c"), (1000, 5000, "d")]


def test_raw_results(spark):
    docs = {
        "nested": [[{"text": "b", "start": 500, "end": 900}, {"sentence": "a", "begin": "100", "finish": 200}], 4, None],
        "children": {"text": "p", "sentence_info": [{"text": "c1", "start": 10, "end": 20}, {"text": " "}, 3]},
        "parent": [{"text": "p", "sentence_info": [{"text": ""}], "timestamp": [[5, 2], [10, 40], [50, 90]], "score": True}],
        "explicit null": [{"text": "n", "start": None, "start_ms": 300, "end": None}],
        "short": [{"text": "s", "start": 400, "end": 400}, {"text": "late", "start": 99999}],
        "numbers": [{"text": None, "value": 7, "start": True, "end": "1e2"}],
    }
    rows = spark.createDataFrame([("r", k, json.dumps(v), 1.0) for k, v in docs.items()] + [("r", "bad", "{", 1.0), ("r", "deep", "[[[[[{}]]]]]", 1.0), ("r", "none", "[]", 1.0), ("r", "forty", "[" * 40 + '{"text": "x", "start": 1, "end": 2.5}, [3, {"text": "y"}]' + "]" * 40, 1.0)], "run_id STRING, sample_id STRING, raw STRING, duration_seconds DOUBLE")
    good, bad = transcripts.normalize_primary(rows)
    got = {}
    for r in good.orderBy("sample_id", "seg_index").collect():
        got.setdefault(r.sample_id, []).append((r.start_ms, r.end_ms, r.text, r.confidence))
    assert got == {
        "nested": [(100, 200, "a", None), (500, 900, "b", None)],
        "children": [(10, 20, "c1", None)],
        "parent": [(10, 90, "p", 1.0)],
        "explicit null": [(0, 1000, "n", None)],
        "short": [(400, 900, "s", None)],
        "numbers": [(0, 100, "7", None)],
        "forty": [(0, 1000, "y", None), (1, 2, "x", None)],
    }
    assert {r.sample_id: r.rejected_reason for r in bad.collect()} == {"bad": "invalid_json", "deep": "no_segments", "none": "no_segments"}


def test_engine_documents(spark, tmp_path):
    doc = {"schema_version": "1.0", "sample_id": "a", "source_path": "/a.mp4", "engine": "funasr", "duration_seconds": 2.5, "segments": [{"start_ms": 0, "end_ms": 9, "text": "x", "metadata": {"avg_logprob": -0.5}}, {"start_ms": 9, "end_ms": 19, "text": "y"}]}
    for i, change in enumerate(({}, {"sample_id": "z"}, {"source_path": "/b.mp4"}, {"engine": "other"})):
        (tmp_path / f"{i}.json").write_text(json.dumps({**doc, **change}, indent=1))
    cands = spark.createDataFrame([("r", "a", "/a.mp4")], "run_id STRING, sample_id STRING, video_path STRING")
    checked = transcripts.check_identity(transcripts.read_engine_outputs(spark, str(tmp_path), "r"), cands, progress.ENGINES)
    assert sorted(str(r.rejected_reason) for r in checked.collect()) == ["None", "engine_mismatch", "sample_id_mismatch", "source_path_mismatch"]
    rows = transcripts.segment_rows(checked.filter("rejected_reason IS NULL"), ["sample_id"]).orderBy("seg_index").collect()
    assert [(r.seg_index, r.start_ms, r.text, r.avg_logprob) for r in rows] == [(0, 0, "x", -0.5), (1, 9, "y", None)]


def test_segment_validity(spark):
    rows = [("r", "ok", "e", 0, 0, 1000, "a"), ("r", "flat", "e", 0, 0, 1000, "a"), ("r", "flat", "e", 1, 1000, 1000, "b"), ("r", "late", "e", 0, 0, 15001, "a"), ("r", "edge", "e", 0, 0, 15000, "a"), ("r", "back", "e", 0, 5, 10, "a"), ("r", "back", "e", 1, 4, 10, "a")]
    segs = spark.createDataFrame(rows, "run_id STRING, sample_id STRING, engine STRING, seg_index BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING")
    outs = spark.createDataFrame([("r", s, "e", 10.0) for s in ("ok", "flat", "late", "edge", "back", "none")], "run_id STRING, sample_id STRING, engine STRING, duration_seconds DOUBLE")
    got = {r.sample_id: (r.first_bad_index, r.invalid_reason) for r in transcripts.validate_segments(segs, outs).collect()}
    assert got == {"ok": (None, None), "edge": (None, None), "flat": (1, "invalid_segment"), "late": (0, "invalid_segment"), "back": (1, "invalid_segment"), "none": (None, "no_segments")}


# --- alignment -----------------------------------------------------------------------------------


def covered_milliseconds(prim, sec):
    """Partners by definition: segments that hold one millisecond in common."""
    holders = defaultdict(set)
    for i, (a, b, _) in enumerate(prim):
        for ms in range(a, b):
            holders[ms].add(i)
    partners = [sorted(set().union(*(holders[ms] for ms in range(a, b)))) for a, b, _ in sec]
    return partners, sorted(set(range(len(prim))).difference(*partners))


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    def make(n):
        out = []
        for _ in range(n):
            a = rng.randint(0, 60_000)
            out.append((a, a + rng.choice([0, 1, 50, 4000, 45_000]), "".join(rng.choices("abc 12你.", k=6))))
        return sorted(out)
    prim, sec = make(40), make(40)
    p, s = segments(spark, prim), segments(spark, sec)
    partners, lone = covered_milliseconds(prim, sec)
    texts = ["".join(prim[i][2] for i in found) for found in partners]
    fold = lambda t: "".join(filter(str.isalnum, unicodedata.normalize("NFKC", t).casefold()))
    ratios = [SequenceMatcher(None, fold(t), fold(s[2])).ratio() if fold(t) and fold(s[2]) else 0.0 for t, s in zip(texts, sec)]
    rows = [(j, tuple(found), t, round(r, 6)) for j, (found, t, r) in enumerate(zip(partners, texts, ratios))]
    got = align.align(p, s, width=7_000).collect()
    matched = sorted((r.secondary_index, tuple(r.primary_indexes), r.primary_text, r.similarity_ratio) for r in got if r.secondary_index is not None)
    assert matched == rows
    assert sorted(r.primary_indexes[0] for r in got if r.secondary_index is None) == lone
    assert all(r.high_risk == (not r.primary_indexes or r.secondary_index is None or r.similarity_ratio < 0.6 or bool(r.token_mismatch)) for r in got)
    plain = {tuple(r) for r in align.overlap_pairs_plain(p, s).collect()}
    for width in (1, 500, 20_000, 10**9):
        assert {tuple(r) for r in align.overlap_pairs(p, s, width=width).collect()} == plain if width > 1 else True
    ratios = [r.similarity_ratio for r in got]
    top = align.alignment_summary(align.align(p, s)).first()
    assert (top.alignment_count, top.median_similarity_ratio) == (len(got), pytest.approx(statistics.median(ratios)))


def test_touching_intervals_do_not_match(spark):
    p, s = segments(spark, [(0, 10, "a"), (10, 20, "b")]), segments(spark, [(10, 20, "b")])
    assert [(r.secondary_index, r.primary_index, r.overlap_ms) for r in align.overlap_pairs(p, s).collect()] == [(0, 1, 10)]
    rows = align.align(p, s).orderBy(*align.alignment_order()).collect()
    assert [(r.decision, r.high_risk) for r in rows] == [(align.MISSING, True), (align.REVIEW, False)]


# --- captions ------------------------------------------------------------------------------------


def test_render(spark):
    segs = segments(spark, [(2500, 4200, "PyTorch 2.5。"), (5000, 6000, "。"), (0, 1800, "你好，世界。")])
    parts = captions.caption_parts(segs)
    want = "00:00\r\n你好世界\r\n\r\n00:02\r\nPyTorch 2.5\r\n".encode()
    assert bytes(captions.whole_captions(parts).first().caption) == want
    assert captions.caption_parts(segments(spark, [(0, 1, "。")])).count() == 0


def test_parts_join_and_hash_to_the_whole(spark):
    import hashlib

    segs = segments(spark, [(i * 1700, i * 1700 + 900, f"line {i}") for i in range(300)]).unionByName(segments(spark, [(0, 5, "x")], "t"))
    one = {r.sample_id: bytes(r.caption) for r in captions.whole_captions(captions.caption_parts(segs)).collect()}
    parts = captions.caption_parts(segs, part_ms=20_000)
    assert {r.sample_id: bytes(r.caption) for r in captions.whole_captions(parts).collect()} == one
    got = {r.sample_id: (r.caption_size, r.caption_sha256) for r in captions.caption_digests(parts).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in one.items()}
    checked = {r.sample_id: r for r in captions.validate_captions(captions.whole_captions(parts)).drop("caption").collect()}
    straight = {r.sample_id: r for r in captions.block_metrics(segs).collect()}
    for k, r in straight.items():
        assert checked[k].format_code is None
        assert all(checked[k][c] == r[c] for c in straight[k].asDict())


GOOD = "00:00\r\n你好\r\n\r\n00:02\r\nx\r\n"


@pytest.mark.parametrize("payload, code", [
    (GOOD.encode(), None), ("1:40:00\r\na\r\n\r\n25:00:00\r\nb\r\n".encode(), None), (b"100:00\r\na\r\n", None), (b"00:00\r\na\r\n\r\n", None),
    (GOOD.encode("utf-16"), "encoding"), (b"\xef\xbb\xbf" + GOOD.encode(), "encoding"), (b"\xff\xff", "encoding"),
    (GOOD.replace("\r\n", "\n").encode(), "bare_newline"), (GOOD[:-2].encode(), "no_final_newline"), (b"", "no_final_newline"),
    (b"00:00\r\na\r\n00:02\r\nb\r\n", "missing_blank_line"), (b"00:03\r\na\r\n\r\n00:00\r\nb\r\n", "not_monotonic"),
    (b"00:00\r\n", "incomplete_block"), (b"0:0\r\na\r\n", "invalid_block"), (b"00:00\r\n\r\n", "invalid_block"),
])
def test_validation_rules(spark, payload, code):
    row = captions.validate_captions(spark.createDataFrame([(bytearray(payload),)], "caption BINARY")).first()
    assert row.format_code == code
    if payload == GOOD.encode():
        assert (row.segment_count, row.first_timestamp, row.last_timestamp, row.median_gap_seconds, row.median_text_chars) == (2, "00:00", "00:02", 2.0, 1.5)
    if code:
        assert row.segment_count == 0


# --- quality -------------------------------------------------------------------------------------


def spread(texts, logprob=None, speech=None):
    step = 60_000 // len(texts)
    return [(i * step, (i + 1) * step, t, (logprob or [None] * len(texts))[i], (speech or [None] * len(texts))[i]) for i, t in enumerate(texts)]


def varied(length, count):
    return [chr(0x4E00 + i) * (length - 1) + chr(0x5E00 + i) for i in range(count)]


GATES = {
    "density_error": (varied(4, 5), None), "density_high": (varied(35, 40), None),
    "ratio_low": (varied(8, 5), varied(20, 5)), "ratio_high": (varied(46, 5), varied(20, 5)),
    "duplicates": (["同样的字幕重复十一个字"] * 5 + varied(20, 1), None), "few": (varied(20, 2), None),
    "thin": (varied(10, 5), None), "thick": (varied(36, 20), None),
    "ratio_warn": (varied(10, 5), varied(20, 5)), "ratio_warn2": (varied(30, 5), varied(20, 5)),
    "duplicate_warn": (["同样的字幕重复十一个字"] * 4 + varied(30, 2), None),
    "long": (varied(51, 5), None), "clean": (varied(30, 5), None), "none": ([], varied(20, 5)),
}


def test_quality_gates(spark):
    extra = ", avg_logprob DOUBLE, no_speech_prob DOUBLE"
    prim = sec = None
    for name, (a, b) in GATES.items():
        if a:
            p = segments(spark, spread(a), name, extra)
            prim = p if prim is None else prim.unionByName(p)
        s = segments(spark, spread(b or a), name, extra)
        sec = s if sec is None else sec.unionByName(s)
    cands = spark.createDataFrame([("r", n, 60.0) for n in GATES] + [("r", "zero", 0.0)], "run_id STRING, sample_id STRING, duration_seconds DOUBLE")
    risk = align.alignment_summary(align.align(prim, sec))
    report = quality.quality(cands, prim, sec, risk, captions.block_metrics(prim))
    got = {r.sample_id: r for r in report.collect()}
    errors = {n: r.errors for n, r in got.items() if r.errors}
    assert errors == {
        "density_error": ["density_error"], "density_high": ["density_error"], "ratio_low": ["ratio_error"],
        "ratio_high": ["ratio_error"], "duplicates": ["duplicate_error"], "few": ["few_segments"],
        "none": ["format_empty_caption", "few_segments", "density_error", "ratio_error"],
        "zero": ["format_empty_caption", "zero_duration", "few_segments", "ratio_error"],
    }
    assert "density_warn" not in got["density_error"].warnings
    for name, code in (("thin", "density_warn"), ("thick", "density_warn"), ("ratio_warn", "ratio_warn"), ("ratio_warn2", "ratio_warn"), ("duplicate_warn", "duplicate_warn"), ("long", "median_chars_warn")):
        assert got[name].passed and code in got[name].warnings, name
    assert got["clean"].passed and got["clean"].warnings == []
    assert got["ratio_low"].text_length_ratio == 0.4 and got["ratio_high"].text_length_ratio == 2.3


def test_confidence(spark):
    extra = ", avg_logprob DOUBLE, no_speech_prob DOUBLE"
    rows = spread(varied(10, 3), [-0.5, -1.2, -0.3], [0.6, None, 0.1])
    r = quality.confidence(segments(spark, rows, "s", extra)).first()
    assert (round(r.avg_logprob_mean, 4), r.avg_logprob_min, r.no_speech_prob_max, r.checked_segments) == (-0.6667, -1.2, 0.6, 3)
    r = quality.confidence(segments(spark, spread(varied(10, 5)), "s", extra)).first()
    assert (r.avg_logprob_mean, r.no_speech_prob_max, r.checked_segments) == (None, None, 5)


def test_duplicate_runs_any_block_size(spark):
    rng = random.Random(11)
    for block in (1, 2, 3, 7, 4096):
        df, want = None, {}
        for k in range(6):
            texts = [rng.choice(["a", "A!", "b", "…"]) for _ in range(rng.randint(1, 30))]
            lines = groupby(x.lower().strip("!…") for x in texts)
            want[f"k{k}"] = max(len(list(same)) if line else 1 for line, same in lines)
            part = segments(spark, [(i, i + 1, t) for i, t in enumerate(texts)], f"k{k}")
            df = part if df is None else df.unionByName(part)
        got = {r.sample_id: r.longest_duplicate_run for r in quality.longest_duplicate_run(df, block=block).collect()}
        assert got == want, block


# --- runs ----------------------------------------------------------------------------------------


def test_stage_commit_and_merge(spark):
    cands = spark.createDataFrame([("r1", s, f"/{s}.mp4", f"/{s}.txt") for s in "abc"] + [("r2", "d", "/d.mp4", "/d.txt")], "run_id STRING, sample_id STRING, video_path STRING, target_path STRING")
    none = spark.createDataFrame([], "run_id STRING, sample_id STRING, reason STRING")
    fails = spark.createDataFrame([("r1", "c", "x"), ("r2", "d", "x")], none.schema)
    rep = "run_id STRING, sample_id STRING, passed BOOLEAN, warning_count BIGINT"
    old = spark.createDataFrame([("r1", "a", False, 1), ("r1", "b", True, 2)], rep)
    new = spark.createDataFrame([("r1", "a", True, 0)], rep)
    merged = runs.merge_stage(old, new)
    assert sorted(map(tuple, merged.collect())) == [("r1", "a", True, 0), ("r1", "b", True, 2)]
    state = lambda reports, f: {r.run_id: (r.staged_all, r.all_passed, r.warning_count, r.has_warnings) for r in runs.stage_summary(reports, cands, f).collect()}
    assert state(old, fails) == {"r1": (True, False, 3, True), "r2": (True, True, 0, False)}
    assert state(merged, none) == {"r1": (False, False, 2, True), "r2": (False, False, 0, False)}
    assert state(merged, fails)["r1"] == (True, True, 2, True)
    digests = spark.createDataFrame([("r1", s, 5, "h") for s in "ab"], "run_id STRING, sample_id STRING, caption_size BIGINT, caption_sha256 STRING")
    summary = runs.stage_summary(merged, cands, fails)
    assert sorted(r.sample_id for r in runs.commit_plan(cands, fails, digests, summary).collect()) == ["a", "b"]
    blocked = runs.commit_plan(cands, fails, digests, summary, [spark.createDataFrame([("r1",)], "run_id STRING")])
    assert blocked.count() == 0
    assert runs.commit_plan(cands, none, digests, runs.stage_summary(merged, cands, none)).count() == 0


def test_run_summary_and_completion(spark):
    manifest = spark.createDataFrame([("r", "committed", "2026-01-01T08:00:00+00:00", "2026-01-01T08:09:00+00:00", 5, 3)], "run_id STRING, status STRING, created_at_utc STRING, updated_at_utc STRING, video_count BIGINT, candidate_count BIGINT")
    one = spark.createDataFrame([("r", "a")], "run_id STRING, sample_id STRING")
    none = one.limit(0)
    reports = one.select("*", F.lit(True).alias("passed"), F.lit(3).cast("bigint").alias("warning_count"))
    commits = spark.createDataFrame([("r", "2026-01-01T08:05:30+00:00", 7)], "run_id STRING, committed_at_utc STRING, entry_count BIGINT")
    verification = spark.createDataFrame([("r", True, 7)], "run_id STRING, passed BOOLEAN, verified_count BIGINT")
    row = runs.run_summary(manifest, one, none, none, reports, one, commits, verification, none).first()
    assert (row.candidate_count, row.excluded_count, row.passed_count, row.warning_count, row.committed_count, row.verification, row.ended_at) == (1, 2, 1, 3, 1, "passed", "2026-01-01T08:05:30+00:00")
    stages = spark.createDataFrame([("r", 3)], "run_id STRING, warning_count BIGINT")
    row = runs.completion_stats(manifest, commits, one, stages, none).first()
    assert (row.elapsed_seconds, row.written_count, row.warning_count, row.failed_count) == (330.0, 7, 3, 0)


def test_manifest_tables(spark, tmp_path):
    from capsieve import schemas

    body = {"run_id": "r", "status": "running", "discovery": {"video_count": 4, "candidate_count": 2}, "excluded_videos": ["/x", "/x"],
            "candidates": [{"sample_id": "a", "video_path": "/a"}, {"sample_id": "b", "video_path": "/b"}],
            "candidate_failures": [{"sample_id": "b", "video_path": "/b", "phase": "verify", "reason": "y"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(body, indent=2))
    (tmp_path / "broken.json").write_text("{")
    tables = runs.manifest_tables(files.read_optional_json(spark, str(tmp_path), schemas.MANIFEST))
    assert {k: v.count() for k, v in tables.items()} == {"runs": 1, "candidates": 2, "failures": 1, "excluded": 1}
    left = runs.eligible(tables["candidates"], tables["failures"]).collect()
    assert [r.sample_id for r in left] == ["a"] and runs.is_resumable(tables["runs"]).count() == 1


def test_flows(spark, tmp_path):
    from capsieve.plans import flows

    (tmp_path / "a.mp4").write_bytes(b"v")
    (tmp_path / "n.txt").write_bytes(b"keep")
    scanned = flows.scan(spark, [str(tmp_path)])
    assert {k: v.count() for k, v in scanned.items()} == {"candidates": 1, "conflicts": 0, "protected": 1, "summary": 1}
    extra = ", avg_logprob DOUBLE, no_speech_prob DOUBLE"
    prim = segments(spark, spread(varied(30, 5)), "ok", extra).unionByName(segments(spark, spread(varied(20, 2)), "few", extra))
    cands = spark.createDataFrame([("r", s, f"/{s}.mp4", f"/{s}.txt", 60.0) for s in ("ok", "few")], "run_id STRING, sample_id STRING, video_path STRING, target_path STRING, duration_seconds DOUBLE")
    none = spark.createDataFrame([], "run_id STRING, sample_id STRING")
    staged = flows.stage(cands, prim, prim, none)
    assert {r.sample_id: r.passed for r in staged["reports"].collect()} == {"ok": True, "few": False}
    assert staged["entries"].count() == 0 and staged["summary"].first().all_passed is False
    failed = cands.filter("sample_id = 'few'").select("run_id", "sample_id")
    again = flows.stage(cands, prim, prim, failed)
    assert [r.sample_id for r in again["entries"].collect()] == ["ok"]
    sinks.write_reports({k: again[k] for k in ("reports", "alignments", "entries")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "reports")).count() == 1


def test_inventory(spark):
    sizes = spark.createDataFrame([("c", 5), ("A", 1), ("A", 2), ("b", 4)], "run_id STRING, length BIGINT")
    known = spark.createDataFrame([("A", "committed", "t"), ("b", "staged_partial", None)], "run_id STRING, status STRING, created_at_utc STRING")
    got = runs.run_inventory(sizes, known).orderBy("run_key")
    assert [(r.run_id, r.status, r.size_bytes) for r in got.collect()] == [("A", "committed", 3), ("b", "staged_partial", 4), ("c", "unknown", 5)]
    assert tuple(runs.inventory_total(got).first()) == (3, 12, False)


def test_sinks_replace_only_their_runs(spark, tmp_path):
    path = str(tmp_path / "captions")
    rows = lambda *r: spark.createDataFrame(list(r), "sample_id STRING, part_no BIGINT, caption BINARY, run_id STRING")
    sinks.write_captions(rows(("a", 0, bytearray(b"1"), "r1"), ("b", 0, bytearray(b"2"), "r2")), path)
    sinks.write_captions(rows(("c", 0, bytearray(b"3"), "r2")), path)
    assert {(r.run_id, r.sample_id) for r in spark.read.parquet(path).collect()} == {("r1", "a"), ("r2", "c")}


# --- events --------------------------------------------------------------------------------------


def event(kind, **fields):
    return json.dumps({"event": kind, **fields})


def log(spark, lines, run="r"):
    return spark.createDataFrame([(run, i, v) for i, v in enumerate(lines)], "run_id STRING, line_no BIGINT, value STRING")


def test_event_parsing(spark):
    good = [
        event("progress", engine="e", index="2", total=3.7, video_path="v"), event("run_dir", path="/r"),
        event("error", phase="verify", reason="x", video_path=None), event("engine_start", engine=None, device=1),
        event("candidate_failed", phase="setup", reason="x", video_path="v", sample_id="s"), event("done", run_dir="/r"), "  " + event("done", run_dir="/r"),
    ]
    bad = ["plain", "", "{}", '{"a": 1}', event("nope"), event("progress", engine="e", index=1), event("error", phase="scan", reason="x"),
           event("progress", engine="e", index="2.0", total=1, video_path="v"), event("progress", engine="e", index=None, total=1, video_path="v"),
           '{"event": "done", "run_dir": "/r"} tail', "[" + event("done", run_dir="/r") + "]"]
    rows = {r.line_no: r for r in eventlog.parse_lines(log(spark, good + bad)).collect()}
    assert [rows[i].event is not None for i in range(len(good + bad))] == [True] * len(good) + [False] * len(bad)
    assert (rows[0]["index"], rows[0]["total"], rows[2].video_path, rows[3].engine, rows[3].device) == (2, 3, None, "None", "1")


def step(engine, video):
    return event("progress", engine=engine, index=1, total=5, video_path=video)


@pytest.mark.parametrize("steps, total, elapsed, want", [
    ([("funasr", "a"), ("faster_whisper", "a"), ("funasr", "b"), ("funasr", "b")], 5, 10.0, (1, 30, pytest.approx(70 / 3))),
    ([("funasr", "a"), ("faster_whisper", "a")], 10, 100.0, (1, 10, 900.0)),
    ([("funasr", "a"), ("faster_whisper", "a")], 3, 1.0, (1, 33, 2.0)), ([("funasr", "a")], 0, 1.0, (0, 0, None)), ([], 4, 1.0, (0, 0, None)),
])
def test_progress(spark, steps, total, elapsed, want):
    totals = spark.createDataFrame([("r", total, elapsed)], "run_id STRING, total BIGINT, elapsed_seconds DOUBLE")
    row = progress.progress(eventlog.events(log(spark, [step(*s) for s in steps])), totals).first()
    assert (row.completed, row.percent, row.remaining_seconds) == want


def test_failure_info(spark):
    lines = [event("run_dir", path="/run"), event("progress", engine="e", index=2, total=9, video_path="v"), event("error", phase="setup", reason="a"), event("error", phase="verify", reason="b", video_path="v")]
    df = log(spark, lines)
    row = progress.failure_info(df, eventlog.events(df), "fb").first()
    assert tuple(row)[1:] == ("写回", "b", "v", "/run", 2, 9)
    rng = random.Random(2)
    for trial in range(4):
        lines = ["".join(rng.choices("ab \t", k=rng.randint(0, 40 * trial + 1))) for _ in range(rng.randint(1, 90))] + ["", " "]
        want = "\n".join(lines).strip()[-1200:]
        df = log(spark, lines)
        got = progress.failure_info(df, eventlog.events(df), "fb").first()
        assert ((got.reason if got else ""), (got.stage if got else "fb")) == (want, "fb")


def test_transfer(spark):
    plan = "source STRING, total_bytes BIGINT, component_index BIGINT, component_count BIGINT, elapsed_seconds DOUBLE"
    def run(lines, *p):
        df = spark.createDataFrame([("s", v) for v in lines], "source STRING, value STRING")
        return progress.transfer_progress(df, spark.createDataFrame([("s", *p)], plan)).first()
    assert run(["Downloading a (10 kB)"], 10**9, 1, 4, 1.0).downloaded_bytes == 10240
    assert run(["Downloading a.whl (100 MB)", "Downloading b (50 MB)"], 10**9, 3, 4, 1.0).downloaded_bytes == 157_286_400
    row = run(["x 500/1000 MB", "x 20/1000 MB"], 1000 << 20, 3, 4, 100.0)
    assert (row.speed_bytes, row.remaining_seconds, row.percent) == (5 << 20, 100.0, 50)


# --- profile -------------------------------------------------------------------------------------


def test_quantiles_and_ranks(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.5, rng.random() * 9]) for _ in range(101)]
    df = spark.createDataFrame([("m", v, i % 7 * 1.0) for i, v in enumerate(values)], "g STRING, value DOUBLE, y DOUBLE")
    want = df.agg(F.percentile("value", F.lit(list(profile.PROBABILITIES)))).first()[0]
    got = profile.quantiles(df, ["g"]).first()
    assert [got[n] for n in profile.NAMES] == pytest.approx(want)
    import pandas as pd

    pdf = df.toPandas()
    rho = pdf["value"].rank().corr(pdf["y"].rank())
    assert profile.spearman(df, "value", "y").first().spearman == pytest.approx(rho)
    assert profile.quantiles_approx(df, ["g"]).first()["p50"] == pytest.approx(statistics.median(values))
    secs = spark.createDataFrame([(s,) for s in (59.9, 60.0, 300.0, 1200.0, 10_800.0, 10_801.0)], "s DOUBLE")
    assert [r.b for r in secs.select(profile.length_bucket(F.col("s")).alias("b")).collect()] == ["under_1m", "1m_to_5m", "1m_to_5m", "5m_to_20m", "20m_to_3h", "over_3h"]
    assert isinstance(pd.__version__, str)


# --- engine documents and incremental staging ----------------------------------------------------


def test_every_document_of_a_file_and_of_each_run(spark, tmp_path):
    doc = {"sample_id": "a", "source_path": "/a.mp4", "engine": "funasr", "segments": [{"start_ms": 0, "end_ms": 9, "text": "x"}]}
    for run in ("r 1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "lines.json").write_text("\n".join(json.dumps({**doc, "sample_id": s}) for s in "abc") + "\n\n")
    (tmp_path / "r2" / "deep").mkdir()
    (tmp_path / "r2" / "deep" / "whole.json").write_text(json.dumps({**doc, "sample_id": "d"}, indent=2))
    (tmp_path / "r2" / "bad.json").write_text('{"sample_id": "a"')
    read = transcripts.read_engine_outputs(spark, str(tmp_path))
    assert sorted((r.run_id, r.sample_id or "") for r in read.collect()) == [*(("r 1", s) for s in "abc"), ("r2", ""), *(("r2", s) for s in "abcd")]
    cands = spark.createDataFrame([(run, s, "/a.mp4") for run in ("r 1", "r2") for s in "abd"], "run_id STRING, sample_id STRING, video_path STRING")
    checked = transcripts.check_identity(read, cands, progress.ENGINES)
    bad = sorted((r.run_id, r.rejected_reason) for r in checked.collect() if r.rejected_reason)
    assert bad == [("r 1", "sample_id_mismatch"), ("r2", "sample_id_mismatch"), ("r2", "unreadable")]
    assert transcripts.segment_rows(checked.filter("rejected_reason IS NULL")).count() == 5


def test_staging_in_two_steps(spark):
    from capsieve.plans import flows

    extra = ", avg_logprob DOUBLE, no_speech_prob DOUBLE"
    one, two = (segments(spark, spread(varied(30, 5)), s, extra) for s in ("a", "b"))
    cands = spark.createDataFrame([("r", s, f"/{s}.mp4", f"/{s}.txt", 60.0) for s in "ab"], "run_id STRING, sample_id STRING, video_path STRING, target_path STRING, duration_seconds DOUBLE")
    none = spark.createDataFrame([], "run_id STRING, sample_id STRING")
    first = flows.stage(cands.filter("sample_id = 'a'"), one, one, none)
    later = flows.stage(cands, two, two, none, previous=first)
    assert {r.sample_id: (r.passed, list(r.errors)) for r in later["reports"].collect()} == {"a": (True, []), "b": (True, [])}
    assert sorted(r.sample_id for r in later["entries"].collect()) == ["a", "b"]
    narrow = flows.stage(cands.filter("sample_id = 'b'"), two, two, none, previous={k: first[k].limit(0) for k in ("reports", "digests")})
    assert [r.sample_id for r in narrow["entries"].collect()] == ["b"]


def test_bad_numbers_end_no_job(spark):
    huge = [event("progress", engine="funasr", index=n, total=3, video_path="/v") for n in (10**19, -(10**19), 10**40, 2)]
    got = eventlog.events(log(spark, huge)).orderBy("line_no").collect()
    assert [r["index"] for r in got] == [2**63 - 1, -(2**63), 2]


def test_linked_folders_are_not_walked(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "v.mp4").write_bytes(b"1")
    (tmp_path / "a" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "a" / "w.mp4").symlink_to(tmp_path / "a" / "v.mp4")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_files(spark, [str(tmp_path)]).collect()) == ["v.mp4", "w.mp4"]


def test_rank_limit_acts_before_the_shuffle(spark):
    from capsieve.session import tune

    plan = progress.output_tail(log(tune(spark), ["x"] * 5))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_quantiles_of_equal_values_stay_spread(spark):
    rows = spark.range(4000).select(F.lit("m").alias("metric"), F.when(F.col("id") < 3990, 1.0).otherwise(F.col("id").cast("double")).alias("value"))
    got = profile.quantiles(rows, ["metric"]).first()
    assert (got.n, got.min, got.p50, got.p90, got.max) == (4000, 1.0, 1.0, 1.0, 3999.0)
    ranks = profile.average_ranks(rows, "value", "r").groupBy("value").agg(F.max("r").alias("r")).orderBy("value").collect()
    assert [r.r for r in ranks][:2] == [1995.5, 3991.0]
