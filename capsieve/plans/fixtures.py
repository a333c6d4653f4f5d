"""Caption-QA inputs derived from the given tables: transcripts, catalogs, snapshots, runs, event logs."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.functions.labels import PHASES, PRIMARY_ENGINE, SECONDARY_ENGINE
from capsieve.functions.paths import is_video
from capsieve.operators import catalog
from capsieve.operators.ordering import running_sum_in_blocks
from capsieve.session import materialize
from capsieve.sources.files import open_store

PIECE = 24
RUNS = 40
TURN_BLOCK = 512
BLANK = " \r\n\t"


_scope = threading.local()


@contextmanager
def scope() -> Iterator[None]:
    """Inputs shared by the branches of one query are materialised once inside it."""
    outer = getattr(_scope, "tables", None)
    _scope.tables = {}
    try:
        yield
    finally:
        _scope.tables = outer


def once(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    tables = getattr(_scope, "tables", None)
    if tables is None:
        return build()
    if name not in tables:
        tables[name] = materialize(build())
    return tables[name]


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A given table. One of fewer files than cores is spread over the cores, narrowed to ``columns`` first."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def run_of(sample: Column) -> Column:
    return F.concat(F.lit("run"), (sample % RUNS).cast("string"))


# --- transcripts ---------------------------------------------------------------------------------


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation cut into 24-character pieces laid out in time."""
    return once("pieces", lambda: _pieces(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    sample = F.col("sample_id")
    turns = table(spark, sf, "conversations", "conv_id", "turn", "text").select(
        F.col("conv_id").alias("sample_id"), "turn", "text", F.char_length("text").cast("bigint").alias("n")
    ).filter("n > 0")
    placed = running_sum_in_blocks(
        turns, ["sample_id"], F.floor(F.col("turn") / TURN_BLOCK), ["turn"],
        {"pieces_before": F.ceil(F.col("n") / PIECE), "chars_before": F.col("n")},
    )
    pace = (
        F.when(sample % 11 == 0, 20).when(sample % 11 == 1, 60).otherwise(F.lit(110) + (sample % 5) * 60)
    ).cast("bigint")
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = placed.select(
        "sample_id", "n", "pieces_before", "chars_before", F.posexplode(parts).alias("c", "piece")
    ).withColumn("c", F.col("c").cast("bigint"))
    index = F.col("pieces_before") + F.col("c")
    start = pace * (F.col("chars_before") + F.col("c") * PIECE)
    length = pace * F.least(F.lit(PIECE), F.col("n") - F.col("c") * PIECE)
    repeated = ((sample % 9 == 0) & (index < 5)) | ((sample % 9 == 1) & (index < 4))
    return cut.select(
        run_of(sample).alias("run_id"),
        sample,
        index.alias("seg_index"),
        start.alias("start_ms"),
        (start + length).alias("end_ms"),
        F.when(repeated, "same line again").otherwise(F.col("piece")).alias("text"),
    )


def primary(spark: SparkSession, sf: str) -> DataFrame:
    return pieces(spark, sf).filter("seg_index % 7 <> 5")


def secondary(spark: SparkSession, sf: str) -> DataFrame:
    s, i = F.col("sample_id"), F.col("seg_index")
    text = (
        F.when(s % 13 == 1, F.substring("text", 1, 8))
        .when(s % 13 == 2, F.substring("text", 1, 15))
        .when((s + i) % 10 == 4, F.concat("text", F.lit(" 42")))
        .otherwise(F.col("text"))
    )
    kept = (i % 5 != 3) & ~((s % 3 == 0) & (i % 10).isin(4, 5))
    tenth = lambda c: (c / F.lit(10.0)).cast("double")
    return pieces(spark, sf).filter(kept).select(
        "run_id", "sample_id", "seg_index",
        (F.col("start_ms") + 200).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms"),
        text.alias("text"),
        tenth(-((s * 7 + i * 3) % F.when(s % 2 == 0, 10).otherwise(15))).alias("avg_logprob"),
        tenth((s + i * 5) % F.when(s % 4 < 2, 6).otherwise(10)).alias("no_speech_prob"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per conversation, with its audio length."""
    spans = primary(spark, sf).select("run_id", "sample_id", "end_ms").unionByName(
        secondary(spark, sf).select("run_id", "sample_id", "end_ms")
    )
    name = F.concat_ws("/", F.lit("/v"), F.col("run_id"), F.concat(F.lit("s"), F.col("sample_id").cast("string")))
    return spans.groupBy("run_id", "sample_id").agg(((F.max("end_ms") + 500) / F.lit(1000.0)).alias("duration_seconds")).select(
        "run_id", "sample_id", "duration_seconds",
        F.concat(name, F.lit(".mp4")).alias("video_path"), F.concat(name, F.lit(".txt")).alias("target_path"),
    )


def both_engines(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["run_id", "sample_id", "seg_index", "start_ms", "end_ms", "text"]
    one = primary(spark, sf).select(F.lit(PRIMARY_ENGINE).alias("engine"), *cols)
    return one.unionByName(secondary(spark, sf).select(F.lit(SECONDARY_ENGINE).alias("engine"), *cols))


def damaged(segments: DataFrame) -> DataFrame:
    """Some segments with a bad order, an empty span, a late end, blank text or a negative start."""
    s, i = F.col("sample_id"), F.col("seg_index")
    hit = lambda m, at: (s % 10 == m) & (i == at)
    return segments.withColumns(
        {
            "start_ms": F.when(hit(1, 6), F.lit(0)).when(hit(2, 0), F.lit(-5)).otherwise(F.col("start_ms")).cast("bigint"),
            "end_ms": F.when(hit(3, 7), F.col("start_ms")).when(hit(4, 4), F.col("end_ms") + 900_000_000).otherwise(F.col("end_ms")),
            "text": F.when(hit(5, 2), BLANK).otherwise(F.col("text")),
        }
    ).filter((s % 10 != 6) | (F.col("engine") == PRIMARY_ENGINE))


def orphaned(segments: DataFrame) -> DataFrame:
    """The segments, and beside them some of samples that no output names, and some without index."""
    s, i = F.col("sample_id"), F.col("seg_index")
    strange = segments.filter(s % 7 == 3).withColumn("sample_id", s + 1_000_000)
    loose = segments.filter((s % 9 == 2) & (i == 1)).withColumn("seg_index", F.lit(None).cast("bigint"))
    return segments.unionByName(strange).unionByName(loose)


def split_letters(segments: DataFrame) -> DataFrame:
    """The segments, their texts beginning or ending with letters that others complete: Hangul and a loose accent."""
    i, s = F.col("seg_index"), F.col("sample_id")
    head = F.when(i % 4 == 1, "\u1161").when(i % 4 == 2, "\u11a8").when((i % 4 == 3) & (s % 2 == 0), "\u0301").otherwise("")
    tail = F.when(i % 4 == 0, "\u1112").when((i % 4 == 1) & (s % 3 == 0), "\uac00").when(i % 4 == 2, "e").otherwise("")
    text = F.when((i % 12 == 2) & (s % 3 == 0), "\u11ab").when(i % 12 == 5, "").otherwise(F.concat(head, "text", tail))
    return segments.withColumn("text", text)


def long_segments(segments: DataFrame) -> DataFrame:
    """The segments, and for every third sample one more over some 30,000 years, from before its start."""
    spans = segments.filter("sample_id % 3 = 0").groupBy("run_id", "sample_id").agg((F.max("seg_index") + 1).alias("seg_index"))
    long = spans.withColumns({"start_ms": -F.col("sample_id") - 1, "end_ms": F.lit(10**15), "text": F.lit("long")})
    return segments.select(*long.columns).unionByName(long)


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Both engines' documents per candidate; a few disagree on the audio length."""
    engine = F.explode(F.array(F.lit(PRIMARY_ENGINE), F.lit(SECONDARY_ENGINE)))
    c = candidates(spark, sf).select("run_id", "sample_id", "duration_seconds", engine.alias("engine"))
    off = (F.col("sample_id") % 12 == 5) & (F.col("engine") == SECONDARY_ENGINE)
    return c.withColumn(
        "duration_seconds", F.when(off, F.col("duration_seconds") + 0.25).otherwise(F.col("duration_seconds"))
    )


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded candidate failures."""
    s = F.col("sample_id")
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), (s % 8 + 1).cast("int"))
    return candidates(spark, sf).filter(s % 17 == 3).select(
        "run_id", "sample_id", "video_path", phase.alias("phase"), F.concat(F.lit("failed in "), phase).alias("reason")
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Run manifests; some lack a state or discovery counts."""
    n = F.substring("run_id", 4, 9).cast("bigint")
    named = table(spark, sf, "conversations").select(run_of(F.col("conv_id")).alias("run_id")).distinct()
    time = lambda minute: F.concat(F.lit("2026-05-01T08:"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00+00:00"))
    return named.select(
        "run_id",
        F.when(n % 5 == 0, None).when(n % 5 == 1, "staged_partial").when(n % 5 == 2, "staged_all").otherwise("committed").alias("status"),
        time(n % 30).alias("created_at_utc"),
        F.when(n % 3 != 0, time(n % 30 + 7)).alias("updated_at_utc"),
        F.when(n % 4 != 0, n + 5).alias("video_count"),
        F.when(n % 4 != 0, n % 7 + 1).alias("candidate_count"),
    )


# --- catalog -------------------------------------------------------------------------------------


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Listed files: videos and other media, some reachable from two roots, some colliding by case."""
    d = F.col("doc_id")
    shadow = d % 20 == 15
    owner = F.when(shadow, d - 5).otherwise(d)
    ext = F.element_at(F.array(*[F.lit(e) for e in (".mp4", ".MKV", ".mov", ".jpg", ".ts")]), (d % 5 + 1).cast("int"))
    path = F.concat(
        F.lit("/f"), (owner % 10).cast("string"), F.lit("/"), F.when(d % 7 == 0, "CLIP").otherwise("clip"),
        owner.cast("string"), F.when(shadow, ".avi").otherwise(ext),
    )
    roots = F.when(d % 6 == 0, F.array(d % 3, (d + 1) % 3)).otherwise(F.array(d % 3))
    return table(spark, sf, "documents").select(
        F.explode(F.transform(roots, lambda r: r.cast("int"))).alias("root_ord"),
        d,
        path.alias("path"),
        F.col("n_chars").alias("length"),
        F.timestamp_seconds(d + 1_700_000_000).alias("modification_time"),
    )


def videos(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.dedupe_paths(media(spark, sf).filter(is_video(F.col("path"))))


def targeted(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_targets(videos(spark, sf))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text files: targets in every state, and notes that belong to no video."""
    d = F.col("doc_id")
    content = F.when(d % 4 == 1, "").when(d % 4 == 2, BLANK).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    name = F.concat(F.lit("/f"), (d % 10).cast("string"), F.lit("/"))
    own = docs.filter((d % 4 != 0) & (d % 20 != 15)).select(
        F.concat(name, F.when(d % 7 == 0, "CLIP").otherwise("clip"), d.cast("string"), F.lit(".txt")).alias("path"),
        content.alias("t"),
    )
    notes = docs.filter(d % 9 == 0).select(
        F.concat(name, F.lit("notes"), d.cast("string"), F.lit(".txt")).alias("path"), content.alias("t")
    )
    return own.unionByName(notes).select(
        "path", F.octet_length("t").cast("bigint").alias("length"), F.encode("t", "UTF-8").alias("content")
    )


def put_files(rows: DataFrame, folder: str) -> str:
    """Write one file for each row of ``path`` (below the folder) and ``content``; a task that runs again writes the same."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, made = 0, set()
        store, base = open_store(folder)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                inner = f"{base}/{path.lstrip('/')}"
                parent = inner.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent)
                    made.add(parent)
                with store.open_output_stream(inner) as out:
                    out.write(content or b"")
                n += 1
        yield pd.DataFrame({"n": [n]})

    rows.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Baseline and current fingerprints of one file per document."""
    d = F.col("doc_id")
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("/s/"), d.cast("string")).alias("path")
    time = F.timestamp_seconds(d + 1_700_000_000).alias("mtime")
    base = docs.select(
        path, F.lit(True).alias("exists"), F.col("n_chars").alias("size"), time,
        F.when(d % 5 != 0, F.sha2("text", 256)).alias("sha256"),
    )
    now = docs.filter(d % 13 != 0).select(
        path, F.lit(True).alias("exists"),
        F.when(d % 17 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), time,
        F.when(d % 23 != 0, F.sha2(F.when(d % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("sha256"),
    )
    return base, now


def nested_snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The documents as files of a folder for each source and 16 ids; a seventh of the folders changed since."""
    d, n = F.col("doc_id"), F.floor(F.col("doc_id") / 16)
    docs = table(spark, sf, "documents", "doc_id", "source", "n_chars", "text")
    path = F.concat_ws("/", F.lit("/s"), F.coalesce("source", F.lit("none")), n.cast("string"), d.cast("string")).alias("path")
    busy, time = n % 7 == 0, F.timestamp_seconds(d + 1_700_000_000).alias("mtime")
    base = docs.filter(~(busy & (d % 11 == 0))).select(
        path, F.lit(True).alias("exists"), F.col("n_chars").alias("size"), time, F.when(n % 5 != 0, F.sha2("text", 256)).alias("sha256")
    )
    now = docs.filter(~(busy & (d % 13 == 0))).select(
        path, F.lit(True).alias("exists"), F.when(busy & (d % 3 == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), time,
        F.when(n % 5 != 0, F.sha2(F.when(busy & (d % 2 == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("sha256"),
    )
    return base, now


def fingerprinted(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates whose video and target are two neighbouring files of the baseline."""
    base, _ = snapshots(spark, sf)
    n = F.substring("path", 4, 20).cast("bigint")
    fp = F.struct("exists", "size", "mtime", "sha256")
    video = base.filter(n % 2 == 0).select((n / 2).cast("bigint").alias("sample_id"), F.col("path").alias("video_path"), fp.alias("video_fp"))
    target = base.filter(n % 2 == 1).select(((n - 1) / 2).cast("bigint").alias("sample_id"), F.col("path").alias("target_path"), fp.alias("target_fp"))
    return video.join(target, "sample_id").withColumn("run_id", run_of(F.col("sample_id")))


# --- event log -----------------------------------------------------------------------------------


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``run_id, line_no, value``: JSON events between human lines, one log per user."""
    e = F.col("event_id")
    engine = F.when(e % 2 == 0, PRIMARY_ENGINE).otherwise(SECONDARY_ENGINE)
    video = F.concat(F.lit("v"), (F.floor(e / 2) % 40).cast("string"))
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]), (e % 8 + 1).cast("int"))
    sample = F.concat(F.lit("S"), (e % 40).cast("string"))
    q = lambda key, value: F.concat(F.lit(f'"{key}": "'), value, F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    kind = F.col("event_type")
    number = F.concat(F.lit('"index": '), (e % 40).cast("string"))
    total = F.when(e % 3 == 0, '"total": "40"').otherwise('"total": 40')
    value = (
        F.when(kind == "view", obj(q("event", F.lit("progress")), q("engine", engine), number, total, q("video_path", video)))
        .when((kind == "error") & (F.col("user_id") % 3 != 0), F.concat(F.lit("音频提取失败 "), e.cast("string")))
        .when((kind == "error") & (e % 7 == 0), obj(q("event", F.lit("error")), q("phase", F.lit("nowhere")), q("reason", F.lit("x"))))
        .when(kind == "error", obj(q("event", F.lit("error")), q("phase", phase), q("reason", F.concat(F.lit("no "), e.cast("string"))), q("video_path", video)))
        .when(kind == "signup", obj(q("event", F.lit("candidate_failed")), q("phase", phase), q("reason", F.lit("skipped")), q("video_path", video), q("sample_id", sample)))
        .when(kind == "purchase", obj(q("event", F.lit("engine_start")), q("engine", engine), q("device", F.lit("cpu"))))
        .when(e % 5 == 0, obj(q("event", F.lit("run_dir")), q("path", F.concat(F.lit("/runs/"), e.cast("string")))))
        .when(e % 5 == 1, obj(q("event", F.lit("done")), q("run_dir", F.concat(F.lit("/runs/"), e.cast("string")))))
        .when(e % 5 == 2, obj(q("event", F.lit("progress")), q("engine", engine)))
        .when(e % 5 == 3, F.concat(F.lit("扫描 "), e.cast("string")))
        .otherwise("")
    )
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), value.alias("value"))


def log_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The event lines as bytes of a log for each run: ``run_id, start, content`` and the log's length ``total``."""
    lines = event_lines(spark, sf).withColumn("content", F.encode(F.concat("value", F.lit("\n")), "UTF-8"))
    size = F.octet_length("content").cast("bigint")
    placed = running_sum_in_blocks(lines, ["run_id"], F.floor(F.col("line_no") / TURN_BLOCK), ["line_no"], {"start": size})
    total = placed.groupBy("run_id").agg(F.max(F.col("start") + size).alias("total"))
    return placed.join(total, "run_id").select("run_id", "start", "content", "total")


def append_logs(logs: DataFrame, folder: str, part: int, parts: int) -> None:
    """A producer's stand-in: the part-th share of each log's bytes is written behind what is there, cut anywhere.

    Each task writes its lines' bytes at their places, so a task that runs again changes nothing. The folder must be
    mounted where the tasks run.
    """
    root = folder.removeprefix("file://")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        n, at, file = 0, None, -1
        for frame in frames:
            for run, start, content, total in zip(frame["run_id"], frame["start"], frame["content"], frame["total"]):
                low, high = total * (part - 1) // parts, total * part // parts
                piece = content[max(0, low - start) : max(0, high - start)]
                if piece:
                    if run != at:
                        if file >= 0:
                            os.close(file)
                        at, file = run, os.open(f"{root}/{run}.log", os.O_WRONLY | os.O_CREAT, 0o644)
                    os.pwrite(file, piece, max(start, low))
                    n += 1
        if file >= 0:
            os.close(file)
        yield pd.DataFrame({"n": [n]})

    logs.mapInPandas(write, "n long").agg(F.sum("n")).collect()


def progress_totals(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        u.alias("run_id"), F.when(u % 10 == 0, 0).otherwise(40).cast("bigint").alias("total"), (u % 100 + 60).cast("double").alias("elapsed_seconds")
    ).distinct()


def transfer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Download logs, one source per supplier: announced items, progress frames and other text."""
    o = F.col("l_orderkey") + F.col("l_linenumber")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "kB", "MB", "GB")]), (o % 4 + 1).cast("int"))
    amount = F.concat((o % 97 + 1).cast("string"), F.when(o % 2 == 0, ".5").otherwise(""))
    value = (
        F.when(o % 3 == 0, F.concat(F.lit("Downloading pkg-"), o.cast("string"), F.lit(".whl ("), amount, F.lit(" "), unit, F.lit(")")))
        .when(o % 3 == 1, F.concat(F.lit("   bar "), amount, F.lit("/"), F.lit("120.5 "), unit, F.lit(" eta")))
        .otherwise("Installing collected packages")
    )
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), value.alias("value"))


def transfer_plans(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("source"),
        F.when(s % 9 == 0, 0).otherwise((s % 50 + 1) * 10_000_000_000).cast("bigint").alias("total_bytes"),
        (s % 4).alias("component_index"),
        F.when(s % 8 == 0, 0).otherwise(5).cast("bigint").alias("component_count"),
        (s % 6).cast("double").alias("elapsed_seconds"),
    )
