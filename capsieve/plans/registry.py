"""Named queries: every operator applied to inputs derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsieve.functions import labels, paths, text, timecode
from capsieve.operators import align, caption_ranges, captions, catalog, hashtree, profile, progress, quality, runs, snapshot
from capsieve.plans import fixtures as fx
from capsieve.session import shared_dir
from capsieve.sources import eventlog, files, growing, publish, run_tables, sinks, transcripts
from capsieve.streaming import lifecycle
from capsieve.streaming import progress as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYS = ("run_id", "sample_id")
METRICS = ("duration_seconds", "text_density", "text_length_ratio", "longest_duplicate_run", "primary_segments", "segment_margin", "median_text_chars")


def query(fn: Query) -> Query:
    @wraps(fn)
    def scoped(spark: SparkSession, sf: str) -> DataFrame:
        with fx.scope():
            return fn(spark, sf)

    QUERIES[fn.__name__] = scoped
    return scoped


def joined(column: str) -> Column:
    """An array as one comparable string."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "|")


# --- catalog -------------------------------------------------------------------------------------


@query
def media_files(spark, sf):
    listed = fx.media(spark, sf)
    return listed.filter(paths.is_video(F.col("path"))).select(
        "root_ord", "path", paths.suffix(F.col("path")).alias("suffix"), "length"
    )


@query
def first_root_paths(spark, sf):
    return catalog.dedupe_paths(fx.media(spark, sf)).select("path", "root_ord", "doc_id", "length")


@query
def target_keys(spark, sf):
    return fx.targeted(spark, sf).select("path", "target_path", "target_key", "path_key")


@query
def target_pairing(spark, sf):
    return catalog.pair_targets(fx.targeted(spark, sf), fx.texts(spark, sf).select("path", "length")).select(
        "path", "target_path", "target_exists", "target_length"
    )


@query
def target_conflicts(spark, sf):
    return catalog.conflicts(fx.targeted(spark, sf))


@query
def protected_texts(spark, sf):
    return catalog.protected_texts(fx.targeted(spark, sf), fx.texts(spark, sf).select("path", "length"))


@query
def discovery_counts(spark, sf):
    return catalog.discovery_summary(fx.targeted(spark, sf), fx.texts(spark, sf).select("path", "length"))


@query
def numbered_candidates(spark, sf):
    found = catalog.candidates(fx.targeted(spark, sf), fx.texts(spark, sf))
    return found.select("sample_id", "video_path", "target_path", "initial_state")


@query
def text_states(spark, sf):
    return fx.texts(spark, sf).select("path", text.initial_state(F.col("content")).alias("state"))


@query
def document_states(spark, sf):
    """States of every document's whole text, and beside it those of empty, blank, marked and broken files."""
    utf8 = F.encode("text", "UTF-8")
    blank = F.encode(F.lit(fx.BLANK), "UTF-8")
    forms = {"own": utf8, "empty": F.unhex(F.lit("")), "blank": blank, "padded": F.concat(blank, utf8), "mark": F.unhex(F.lit("EFBBBF0D0A")), "broken": F.concat(F.unhex(F.lit("EFBBBFFF")), utf8)}
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("content")) for k, c in forms.items()])).alias("f")
    return fx.table(spark, sf, "documents", "doc_id", "text").select("doc_id", listed).select("doc_id", "f.form", text.initial_state(F.col("f.content")).alias("state"))


def _excluded(spark, sf):
    return fx.videos(spark, sf).filter("doc_id % 9 = 0").select(F.col("path").alias("video_path"))


def _numbered(spark, sf):
    return catalog.number_candidates(catalog.without_conflicts(fx.targeted(spark, sf))).withColumnRenamed(
        "path", "video_path"
    )


@query
def exclusions(spark, sf):
    found, listed = _numbered(spark, sf), _excluded(spark, sf)
    kept = catalog.apply_exclusions(found, listed).select("sample_id", "video_path", F.lit(False).alias("excluded"))
    hit = catalog.matched_exclusions(found, listed).select("sample_id", "video_path", F.lit(True).alias("excluded"))
    return kept.unionByName(hit)


@query
def selection_counts(spark, sf):
    targeted = fx.targeted(spark, sf)
    plain = catalog.without_conflicts(targeted).withColumnRenamed("path", "video_path")
    return catalog.selection_summary(
        plain,
        catalog.apply_exclusions(plain, _excluded(spark, sf)),
        catalog.conflicts(targeted),
        catalog.protected_texts(targeted, fx.texts(spark, sf).select("path", "length")),
    )


@query
def cost_estimates(spark, sf):
    d = F.col("doc_id")
    seconds = F.when(d % 6 != 0, d * F.lit(0.5))
    return catalog.cost_profile(fx.videos(spark, sf), seconds, F.col("length") * 4096).select("path", "estimate_seconds")


@query
def engine_terms(spark, sf):
    found = fx.candidates(spark, sf).select("run_id", F.concat_ws("-", F.lit("/v/Lesson"), F.substring("run_id", 1, 6), F.concat(F.lit("T"), (F.col("sample_id") % 1500).cast("string")), F.concat(F.lit("U"), (F.col("sample_id") % 1700).cast("string"))).alias("stem"), "sample_id")
    return catalog.terms(found.withColumn("video_path", F.concat("stem", F.lit(".mp4")))).select("run_id", "term_key", "term")


# --- files, written from the tables and read back ------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/capsieve-{name}-{uuid.uuid4().hex}"


def _below(folder: str, path: str) -> Column:
    """The path below the folder; listings and metadata spell its scheme in different ways."""
    name = folder.rsplit("/", 1)[-1]
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), f"^.*/{name}", "")


@query
def listed_media(spark, sf):
    """Video files of a folder, each with its document's text as content."""
    docs = fx.table(spark, sf, "documents", "doc_id", "text").withColumn("content", F.encode("text", "UTF-8"))
    media = fx.media(spark, sf).select("doc_id", "path").distinct()
    folder = fx.put_files(docs.join(media, "doc_id"), _folder(spark, "media"))
    return files.scan_media(spark, [folder]).select(_below(folder, "path").alias("path"), "length")


@query
def listed_texts(spark, sf):
    """Text files with their bytes, one for each document, whole."""
    name = F.concat(F.lit("/f"), (F.col("doc_id") % 10).cast("string"), F.lit("/clip"), F.col("doc_id").cast("string"), F.lit(".txt"))
    docs = fx.table(spark, sf, "documents", "doc_id", "text").select(name.alias("path"), F.encode("text", "UTF-8").alias("content"))
    folder = fx.put_files(docs, _folder(spark, "texts"))
    found = files.scan_texts(spark, [folder])
    return found.select(_below(folder, "path").alias("path"), "length", F.sha2("content", 256).alias("sha256"))


@query
def hashed_files(spark, sf):
    """Fingerprints of those files, hashed in chunks."""
    name = F.concat(F.lit("/f"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    docs = fx.table(spark, sf, "documents", "doc_id", "text").select(name.alias("path"), F.encode("text", "UTF-8").alias("content"))
    folder = fx.put_files(docs, _folder(spark, "hashed"))
    found = files.fingerprints(files.list_files(spark, [folder]))
    return found.select(_below(folder, "path").alias("path"), "exists", "size", "sha256")


@query
def optional_reports(spark, sf):
    """Reports as files, beside each a broken one, a list or an empty one, which count as absent."""
    d = F.col("doc_id")
    docs = fx.table(spark, sf, "documents", "doc_id", "text").select(d, F.to_json(F.struct(d.alias("number"), F.coalesce("text", F.lit("")).alias("note"))).alias("t"))
    bad = F.when(d % 3 == 0, F.concat(F.lit("["), F.col("t"), F.lit("]"))).when(d % 3 == 1, F.substring("t", 1, 9)).otherwise("")
    put = lambda kind, c: docs.select(F.concat(F.lit(f"/{kind}"), d.cast("string"), F.lit(".json")).alias("path"), F.encode(c, "UTF-8").alias("content"))
    folder = fx.put_files(put("good", F.col("t")).unionByName(put("bad", bad)), _folder(spark, "reports"))
    found = files.read_optional_json(spark, f"{folder}/*.json", "number BIGINT, note STRING")
    return found.select(_below(folder, "source_file").alias("path"), "number", "note")


@query
def listed_terms(spark, sf):
    """Term files, one for each document: a comment, then its lines, each a list of terms."""
    d = F.col("doc_id")
    body = F.concat(F.lit("\ufeff# terms, of\r\n\n"), F.coalesce("text", F.lit("")))
    docs = fx.table(spark, sf, "documents", "doc_id", "text").select(F.concat(F.lit("/"), d.cast("string"), F.lit(".txt")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    folder = fx.put_files(docs, _folder(spark, "terms"))
    found = files.read_term_files(spark, folder)
    return found.select(_below(folder, "source_file").alias("path"), "position", "term")


@query
def listed_exclusions(spark, sf):
    """Excluded paths from JSON lists, one for each two documents that follow each other, some paths named twice."""
    d = F.col("doc_id")
    path = lambda n: F.concat(F.lit("/v/é "), n.cast("string"), F.lit(".mp4"))
    body = F.to_json(F.array(path(d), path(d + 1), path(d)))
    docs = fx.table(spark, sf, "documents", "doc_id").select(F.concat(F.lit("/"), d.cast("string"), F.lit(".json")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    return files.read_exclusions(spark, fx.put_files(docs, _folder(spark, "exclusions")))


# --- snapshots -----------------------------------------------------------------------------------


@query
def snapshot_quick(spark, sf):
    return snapshot.diff_quick(*fx.snapshots(spark, sf)).select("path", "matches")


@query
def snapshot_full(spark, sf):
    return snapshot.diff_full(*fx.snapshots(spark, sf)).select("path", "matches")


@query
def changed_candidates(spark, sf):
    return snapshot.validate_candidates(fx.fingerprinted(spark, sf), fx.snapshots(spark, sf)[1])


@query
def changed_protected(spark, sf):
    base, now = fx.snapshots(spark, sf)
    return snapshot.validate_protected(base, now)


@query
def snapshot_tree_changes(spark, sf):
    """Two snapshots stored as trees and compared from the roots down."""
    root = _folder(spark, "snapshots")
    for name, prints in zip(("base", "now"), fx.nested_snapshots(spark, sf)):
        hashtree.store(prints, f"{root}/{name}")
    return hashtree.diff(spark, f"{root}/base", f"{root}/now")


# --- text and time -------------------------------------------------------------------------------


@query
def normalized_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query
def normalized_pages(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", text.normalize_text(F.col("html")).alias("normal"))


@query
def comparison_documents(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.comparison_text(F.col("text")).alias("comparison"))


@query
def page_tokens(spark, sf):
    tokens = F.array_sort(text.token_set(F.col("html")))
    return fx.table(spark, sf, "pages").select("page_id", F.array_join(tokens, "|").alias("tokens"))


@query
def decoded_documents(spark, sf):
    d = F.col("doc_id")
    utf8 = F.encode("text", "UTF-8")
    content = (
        F.when(d % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(d % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(d % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(utf8)
    )
    docs = fx.table(spark, sf, "documents").select("doc_id", text.decode_text(content).alias("d"))
    return docs.select("doc_id", "d.text", "d.encoding", "d.bom")


@query
def stripped_logs(spark, sf):
    escape = F.lit("\x1b[34m")
    line = F.concat(escape, "text", F.lit("\x1b[0m [A] \x1b[2;5H"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", text.strip_ansi(line).alias("line"))


@query
def timecodes(spark, sf):
    ms = (F.col("l_orderkey") * 977 + F.col("l_linenumber") * 61_000).cast("bigint")
    coded = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ms.alias("ms"))
    coded = coded.withColumn("timecode", timecode.format_timestamp(F.col("ms")))
    return coded.withColumn("seconds", timecode.parse_timestamp(F.col("timecode")))


@query
def probe_durations(spark, sf):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    said = F.concat(F.lit("  duration: "), two(k % 30), F.lit(":"), two(k % 60), F.lit(":"), two((k + 7) % 60), F.when(k % 2 == 0, ".25").otherwise(""), F.lit(", start"))
    line = F.when(k % 5 == 0, "  Duration: N/A").otherwise(said)
    return fx.table(spark, sf, "orders").select("o_orderkey", timecode.parse_probe_duration(line).alias("seconds"))


@query
def clock_times(spark, sf):
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(e % 4 == 0, F.concat(stamp, F.lit("+02:00"))).when(e % 4 == 1, "not a time").otherwise(stamp)
    factor = timecode.real_time_factor((e % 50).cast("double"), (e % 7).cast("double"))
    return fx.table(spark, sf, "events").select("event_id", timecode.iso_epoch(iso).alias("epoch"), factor.alias("rtf"))


@query
def stage_labels(spark, sf):
    e = F.col("event_id")
    words = ["质量门禁 x", "音频提取失败", "engine=funasr", "x FunASR", "engine=faster-whisper", "回滚 faster", "扫描", "nothing", ""]
    reason = F.element_at(F.array(*[F.lit(w) for w in words]), (e % 9 + 1).cast("int"))
    phase = F.element_at(F.array(*[F.lit(p) for p in labels.PHASES]), (e % 8 + 1).cast("int"))
    engine = F.element_at(F.array(F.lit("funasr"), F.lit("faster-whisper"), F.lit("faster_whisper")), (e % 3 + 1).cast("int"))
    status = F.element_at(F.array(F.lit("committed"), F.lit("running"), F.lit("other")), (e % 3 + 1).cast("int"))
    return fx.table(spark, sf, "events").select(
        "event_id",
        labels.detect_stage(reason, F.lit("fallback")).alias("stage"),
        labels.phase_label(phase, F.lit("fallback")).alias("phase_label"),
        labels.engine_phase(engine).alias("engine_phase"),
        labels.status_label(status).alias("status_label"),
    )


# --- transcripts ---------------------------------------------------------------------------------


@query
def transcript_segments(spark, sf):
    return fx.both_engines(spark, sf)


@query
def secondary_clamps(spark, sf):
    raw = fx.pieces(spark, sf).select(
        "sample_id", "seg_index", "text",
        ((F.col("start_ms") - 300) / F.lit(1000.0)).alias("start"),
        ((F.col("end_ms") - F.when(F.col("seg_index") % 4 == 0, 9000).otherwise(0)) / F.lit(1000.0)).alias("end"),
    )
    return transcripts.clamp_secondary(raw, F.lit(60.0)).select("sample_id", "seg_index", "start_ms", "end_ms", "text")


@query
def primary_clamps(spark, sf):
    i = F.col("seg_index")
    raw = fx.pieces(spark, sf).select(
        "sample_id", "seg_index", "text",
        F.when(i % 5 != 0, F.col("start_ms").cast("double")).alias("start"),
        F.when(i % 3 != 0, F.col("end_ms").cast("double") - F.when(i % 4 == 0, 9000).otherwise(0)).alias("end"),
    )
    return transcripts.clamp_primary(raw, F.lit(60.0)).select("sample_id", "seg_index", "start_ms", "end_ms", "text")


def _document_name() -> Column:
    """Numbered per run, so that every run has the same names."""
    number = F.floor(F.col("conv_id") / fx.RUNS).cast("string")
    return F.concat(F.lit("D"), number, F.lit("-"), F.col("turn").cast("string"))


def _documents(spark, sf):
    """Engine documents whose segments are the lines of a conversation turn."""
    c = F.col("conv_id")
    lines = F.split("text", "\n")
    segs = F.transform(
        lines,
        lambda t, i: F.struct(
            (i * 1000).cast("bigint").alias("start_ms"), (i * 1000 + 900).cast("bigint").alias("end_ms"), t.alias("text"),
            F.struct(F.lit(-0.5).alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), F.lit(1.5).alias("compression_ratio"), F.lit(None).cast("double").alias("confidence")).alias("metadata"),
        ),
    )
    name = _document_name()
    return fx.table(spark, sf, "conversations").select(
        fx.run_of(c).alias("run_id"),
        F.when(c % 11 == 0, F.lit("nobody")).otherwise(name).alias("sample_id"),
        F.concat(F.lit("/d/"), name, F.when(c % 7 == 0, ".avi").otherwise(".mp4")).alias("source_path"),
        F.when(c % 5 == 0, F.lit("other")).when(F.col("turn") % 2 == 0, labels.PRIMARY_ENGINE).otherwise(labels.SECONDARY_ENGINE).alias("engine"),
        segs.alias("segments"),
    )


def _document_owners(spark, sf):
    name = _document_name()
    return fx.table(spark, sf, "conversations").select(
        fx.run_of(F.col("conv_id")).alias("run_id"), name.alias("sample_id"), F.concat(F.lit("/d/"), name, F.lit(".mp4")).alias("video_path")
    )


def _checked(spark, sf):
    engines = (labels.PRIMARY_ENGINE, labels.SECONDARY_ENGINE)
    return transcripts.check_identity(_documents(spark, sf), _document_owners(spark, sf), engines)


@query
def document_identity(spark, sf):
    return _checked(spark, sf).groupBy(F.coalesce("rejected_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("documents"))


@query
def document_segments(spark, sf):
    rows = transcripts.segment_rows(_checked(spark, sf).filter("rejected_reason IS NULL"))
    return rows.select(*KEYS, "engine", "seg_index", "start_ms", "end_ms", "text", "avg_logprob")


def _raw_forms():
    """Raw result documents of a text: nested lists, sentence children, timestamp pairs, alternative keys; one without text."""
    quoted = F.to_json(F.struct(F.col("text").alias("text")))
    body = F.substring(quoted, 2, 1 << 30)
    plain = F.concat(F.lit('{"start": 100, "end_ms": "2500", '), body)
    stamped = F.concat(F.lit('{"timestamp": [[700, 900], [5, 1], [1000, 1800]], "score": 0.25, '), body)
    nested = F.concat(F.lit('{"text": "parent", "sentence_info": [{"start": 4000, "end": 4400, "text": "second"}, 7, {"begin": 3000, "finish": 3000, '), F.regexp_replace(body, r"\}$", "}]}"))
    return [
        F.concat(F.lit("[["), plain, F.lit(", "), stamped, F.lit("]]")), F.concat(F.lit("["), nested, F.lit("]")), stamped,
        F.concat(F.lit("[[[[[["), plain, F.lit("]]]]]]")), F.lit('[{"text": "  "}, 3]'),
    ]


def _raw_results(spark, sf):
    """One form for each conversation."""
    doc = F.element_at(F.array(*_raw_forms()), (F.col("conv_id") % 5 + 1).cast("int"))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", doc.alias("raw"), F.lit(10.0).alias("duration_seconds"))


def _all_raw_results(spark, sf):
    """Every form of every turn."""
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.array(*_raw_forms())).alias("form", "raw"), F.lit(10.0).alias("duration_seconds"))


@query
def raw_form_segments(spark, sf):
    return transcripts.normalize_primary(_all_raw_results(spark, sf), ["conv_id", "turn", "form"])[0]


@query
def raw_form_rejects(spark, sf):
    return transcripts.normalize_primary(_all_raw_results(spark, sf), ["conv_id", "turn", "form"])[1]


@query
def raw_result_segments(spark, sf):
    return transcripts.normalize_primary(_raw_results(spark, sf), ["conv_id", "turn"])[0]


@query
def raw_result_rejects(spark, sf):
    return transcripts.normalize_primary(_raw_results(spark, sf), ["conv_id", "turn"])[1]


@query
def segment_validity(spark, sf):
    return transcripts.validate_segments(
        fx.damaged(fx.both_engines(spark, sf)), fx.outputs(spark, sf), ("run_id", "sample_id", "engine")
    ).select("run_id", "sample_id", "engine", "segment_count", "first_bad_index", "invalid_reason")


_ALL_KEYS = ("run_id", "sample_id", "engine")


def _orphaned(spark, sf):
    return fx.once("orphaned", lambda: fx.orphaned(fx.damaged(fx.both_engines(spark, sf))))


@query
def orphan_segments(spark, sf):
    """Segments of no known output, and segments without index."""
    rows = transcripts.reject_segments(_orphaned(spark, sf), fx.outputs(spark, sf))
    return rows.select(*_ALL_KEYS, "seg_index", "start_ms", "end_ms", "text", "rejected_reason")


@query
def orphan_validity(spark, sf):
    """Validity of outputs some of whose segments have no index, beside segments of other samples."""
    rows = transcripts.validate_segments(_orphaned(spark, sf), fx.outputs(spark, sf))
    return rows.select(*_ALL_KEYS, "segment_count", "first_bad_index", "invalid_reason")


@query
def segment_order(spark, sf):
    shuffled = fx.pieces(spark, sf).select(
        "sample_id", "start_ms", "end_ms", (F.lit(10_000) - F.col("seg_index")).alias("raw_pos")
    )
    return transcripts.index_segments(shuffled, ["sample_id"]).select("sample_id", "start_ms", "end_ms", "seg_index")


# --- alignment -----------------------------------------------------------------------------------


def _sides(spark, sf):
    return fx.primary(spark, sf), fx.secondary(spark, sf)


@query
def overlap_pairs(spark, sf):
    return align.overlap_pairs(*_sides(spark, sf))


@query
def long_overlap_pairs(spark, sf):
    """Overlaps where every third sample has a segment of some 30,000 years on the secondary side."""
    prim, sec = _sides(spark, sf)
    return align.overlap_pairs(prim, fx.long_segments(sec))


@query
def loose_alignments(spark, sf):
    """Alignment rows of segments some of which have no index: they keep their rows."""
    prim, sec = (fx.orphaned(side) for side in _sides(spark, sf))
    rows = align.align(prim, sec.select(*prim.columns), with_ratio=False)
    return _flat(rows).drop("similarity_ratio", "primary_text", "primary_indexes")


@query
def matched_text(spark, sf):
    rows = align.matched_text(*_sides(spark, sf))
    return rows.select(*KEYS, "secondary_index", "start_ms", "end_ms", "secondary_text", "primary_text", joined("primary_indexes").alias("primary_indexes"))


@query
def unmatched_primary(spark, sf):
    return align.unmatched_primary(*_sides(spark, sf)).select(*KEYS, "seg_index", "start_ms", "end_ms", "text")


def _flat(rows):
    return rows.withColumns({"primary_indexes": joined("primary_indexes"), "token_mismatch": joined("token_mismatch")})


@query
def alignment_tokens(spark, sf):
    """Alignment judged by partners and tokens only."""
    return _flat(align.align(*_sides(spark, sf), with_ratio=False)).drop("similarity_ratio")


@query
def alignment_ratios(spark, sf):
    """Full alignment with the similarity ratio."""
    return _flat(align.align(*_sides(spark, sf)))


@query
def alignment_counts(spark, sf):
    risk = align.alignment_summary(align.align(*_sides(spark, sf), with_ratio=False))
    return risk.select(*KEYS, "alignment_count", "high_risk_count")


@query
def alignment_medians(spark, sf):
    return align.alignment_summary(align.align(*_sides(spark, sf)))


@query
def risky_candidates(spark, sf):
    """Which candidates have high-risk disagreement between the two engines?"""
    rows = align.align(*_sides(spark, sf), with_ratio=False).filter("high_risk")
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("high_risk_count"), F.min("start_ms").alias("first_risk_ms"),
        F.count_if(F.size("token_mismatch") > 0).alias("token_mismatch_count"),
    )


# --- captions and quality ------------------------------------------------------------------------


@query
def caption_blocks(spark, sf):
    return captions.caption_blocks(fx.pieces(spark, sf)).select(*KEYS, "seg_index", "timecode", "caption")


@query
def rendered_captions(spark, sf):
    whole = captions.whole_captions(captions.caption_parts(fx.pieces(spark, sf)))
    return whole.select(*KEYS, F.col("caption").cast("string").alias("caption"))


@query
def caption_digests(spark, sf):
    return captions.caption_digests(captions.caption_parts(fx.pieces(spark, sf), part_ms=60_000))


@query
def stored_captions(spark, sf):
    """Caption parts written by run, those of the even runs a second time, read back and hashed."""
    folder = _folder(spark, "captions")
    parts = captions.caption_parts(fx.pieces(spark, sf), part_ms=60_000)
    even = F.substring("run_id", 4, 9).cast("bigint") % 2 == 0
    sinks.write_captions(parts.withColumn("caption", F.when(even, F.encode(F.lit("old"), "UTF-8")).otherwise(F.col("caption"))), folder)
    sinks.write_captions(parts.filter(even), folder)
    return captions.caption_digests(spark.read.schema(parts.schema).parquet(folder))


@query
def stored_reports(spark, sf):
    """Candidates and failures written by run, the even runs a second time, read back."""
    folder = _folder(spark, "reports")
    cands, fails = fx.candidates(spark, sf), fx.failures(spark, sf)
    even = F.substring("run_id", 4, 9).cast("bigint") % 2 == 0
    sinks.write_reports({"candidates": cands, "failures": fails}, folder)
    sinks.write_reports({"candidates": cands.filter(even).withColumn("duration_seconds", F.col("duration_seconds") * 2)}, folder)
    none = lambda kind: F.lit(None).cast(kind)
    read = lambda name, df: spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    one = read("candidates", cands).select(*KEYS, F.lit("candidates").alias("report"), "duration_seconds", none("string").alias("reason"))
    return one.unionByName(read("failures", fails).select(*KEYS, F.lit("failures").alias("report"), none("double").alias("duration_seconds"), "reason"))


@query
def caption_metrics(spark, sf):
    return captions.block_metrics(fx.pieces(spark, sf))


def _damaged_captions(spark, sf):
    """Rendered captions, some of them damaged."""
    s, c = F.col("sample_id"), F.col("caption").cast("string")
    broken = (
        F.when(s % 9 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(c, "UTF-8")))
        .when(s % 9 == 2, F.encode(F.replace(c, F.lit("\r\n"), F.lit("\n")), "UTF-8"))
        .when(s % 9 == 3, F.encode(F.concat(c, F.lit("end")), "UTF-8"))
        .when(s % 9 == 4, F.encode(F.concat(c, F.lit("\r\n00:01\r\n")), "UTF-8"))
        .when(s % 9 == 5, F.encode(F.concat(c, F.lit("\r\n0:1\r\nx\r\n")), "UTF-8"))
        .when(s % 9 == 6, F.encode(F.concat(c, F.lit("99:59\r\nx\r\n")), "UTF-8"))
        .when(s % 9 == 7, F.encode(F.concat(F.lit("99:59:59\r\nx\r\n\r\n"), c), "UTF-8"))
        .otherwise(F.col("caption"))
    )
    whole = captions.whole_captions(captions.caption_parts(fx.pieces(spark, sf)))
    return whole.withColumn("caption", broken)


@query
def caption_checks(spark, sf):
    """Rendered captions, some of them damaged, through the format rules."""
    return captions.validate_captions(_damaged_captions(spark, sf)).drop("caption")


@query
def caption_range_checks(spark, sf):
    """The same rules over ranges of 101 bytes, cut anywhere."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("caption") / 101))).alias("part_no")
    cut = _damaged_captions(spark, sf).select(*KEYS, "caption", at)
    ranges = cut.select(*KEYS, "part_no", F.expr("substring(caption, CAST(part_no * 101 + 1 AS INT), 101)").alias("caption"))
    return caption_ranges.validate_ranges(ranges)


@query
def confidence(spark, sf):
    rows = quality.confidence(fx.secondary(spark, sf))
    return rows.withColumn("avg_logprob_mean", F.round("avg_logprob_mean", 6))


@query
def text_lengths(spark, sf):
    rows = quality.transcript_metrics(*_sides(spark, sf))
    return rows.select(*KEYS, "primary_segments", "secondary_segments", "primary_chars", "secondary_chars")


@query
def joined_text_lengths(spark, sf):
    """Lengths of transcripts whose letters are split between segments."""
    rows = quality.transcript_metrics(*(fx.split_letters(side) for side in _sides(spark, sf)))
    return rows.select(*KEYS, "primary_chars", "secondary_chars")


@query
def duplicate_runs(spark, sf):
    return quality.longest_duplicate_run(fx.pieces(spark, sf), block=16)


def _quality(spark, sf, with_ratio=False):
    prim, sec = _sides(spark, sf)
    risk = align.alignment_summary(align.align(prim, sec, with_ratio=with_ratio))
    report = quality.quality(fx.candidates(spark, sf), prim, sec, risk)
    return report.withColumns(
        {"text_density": F.col("density"), "text_length_ratio": F.col("length_ratio"), "segment_margin": F.col("primary_segments") - F.col("minimum_segments")}
    )


@query
def quality_gate(spark, sf):
    """The gate with risk from partners and tokens."""
    return _quality(spark, sf).select(
        *KEYS, "passed", "warning_count", "high_risk_count", "primary_segments", "secondary_segments",
        "longest_duplicate_run", "text_density", "text_length_ratio", "median_text_chars",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


@query
def stored_quality_gate(spark, sf):
    """The gate over run tables: candidates, metrics and risk stored in buckets and joined where they lie."""
    prim, sec = _sides(spark, sf)
    risk = align.alignment_summary(align.align(prim, sec, with_ratio=False))
    stored = [run_tables.create(part) for part in (fx.candidates(spark, sf), *quality.sample_metrics(prim, sec), risk)]
    first, *parts = (run_tables.read(spark, name) for name in stored)
    return quality.judge(first, parts).select(
        *KEYS, "passed", "warning_count", "high_risk_count", "primary_segments", "secondary_segments",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


@query
def quality_gate_ratios(spark, sf):
    """The gate with the similarity ratio in the risk."""
    return _quality(spark, sf, with_ratio=True).select(
        *KEYS, "passed", "warning_count", "high_risk_count", "median_similarity_ratio",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


def _rounded(rows):
    return rows.withColumns({name: F.round(name, 6) for name in profile.NAMES})


@query
def quality_reports(spark, sf):
    """Full reports: the gate beside the staged captions' size, hash and gaps."""
    prim, sec = _sides(spark, sf)
    risk = align.alignment_summary(align.align(prim, sec, with_ratio=False))
    staged = captions.caption_digests(captions.caption_parts(prim)).join(captions.block_metrics(prim), list(KEYS))
    report = quality.quality(fx.candidates(spark, sf), prim, sec, risk, staged)
    return report.select(
        *KEYS, "passed", "warning_count", "caption_size", "caption_sha256", "caption_count", "median_text_chars",
        "max_text_chars", "median_gap_seconds", "first_timestamp", "last_timestamp",
    )


@query
def corpus_profile(spark, sf):
    return _rounded(profile.corpus_profile(_quality(spark, sf), METRICS))


@query
def bucket_profile(spark, sf):
    return _rounded(profile.profile_by_bucket(_quality(spark, sf), METRICS))


@query
def density_rank_correlation(spark, sf):
    rows = profile.spearman(_quality(spark, sf), "text_density", "duration_seconds")
    return rows.withColumn("spearman", F.round("spearman", 6))


# --- runs ----------------------------------------------------------------------------------------


def _reports(spark, sf):
    return fx.once(
        "reports",
        lambda: _quality(spark, sf).select(
            *KEYS, "video_path", "target_path", "passed", "warning_count", "errors", "warnings"
        ),
    )


@query
def pending_candidates(spark, sf):
    valid = transcripts.validate_segments(fx.damaged(fx.both_engines(spark, sf)), fx.outputs(spark, sf)).filter("invalid_reason IS NULL")
    return runs.pending(fx.candidates(spark, sf), valid, progress.ENGINES).select(*KEYS, "video_path")


@query
def eligible_candidates(spark, sf):
    cands = fx.candidates(spark, sf)
    only = fx.table(spark, sf, "conversations").filter("conv_id % 3 <> 0").select(fx.run_of(F.col("conv_id")).alias("run_id"), F.col("conv_id").alias("sample_id"))
    return runs.eligible(cands, fx.failures(spark, sf), only).select(*KEYS)


@query
def pilot_phases(spark, sf):
    return runs.split_phases(fx.candidates(spark, sf), 2).select(*KEYS, "candidate_no", "phase")


@query
def duration_mismatches(spark, sf):
    return runs.duration_mismatch(fx.outputs(spark, sf), labels.PRIMARY_ENGINE, labels.SECONDARY_ENGINE)


@query
def merged_stage(spark, sf):
    reports = _reports(spark, sf).select(*KEYS, "passed", "warning_count")
    new = reports.filter("sample_id % 3 = 0").withColumn("warning_count", F.col("warning_count") + 100)
    return runs.merge_stage(reports.filter("sample_id % 2 = 0"), new)


@query
def merged_run_table(spark, sf):
    """The same merge into a stored table, then a second one, read back after compaction."""
    reports = _reports(spark, sf).select(*KEYS, "passed", "warning_count")
    name = run_tables.create(reports.filter("sample_id % 2 = 0"))
    for more, plus in ((3, 100), (5, 1000)):
        run_tables.merge(reports.filter(F.col("sample_id") % more == 0).withColumn("warning_count", F.col("warning_count") + plus), name)
    whole = run_tables.compact(spark, name)
    run_tables.drop(spark, name)
    return run_tables.read(spark, whole)


@query
def stage_states(spark, sf):
    reports = _reports(spark, sf).filter("sample_id % 8 <> 7")
    chosen = fx.candidates(spark, sf).filter("sample_id % 2 = 0")
    return runs.stage_summary(reports, fx.candidates(spark, sf), fx.failures(spark, sf), chosen)


@query
def warned_samples(spark, sf):
    return runs.warning_samples(_reports(spark, sf))


def _digests(spark, sf):
    return fx.once("digests", lambda: captions.caption_digests(captions.caption_parts(fx.primary(spark, sf))))


@query
def broken_staging(spark, sf):
    digests = _digests(spark, sf)
    said = digests.withColumn("caption_sha256", F.when(F.col("sample_id") % 5 == 0, F.lit("0")).otherwise(F.col("caption_sha256")))
    return runs.check_staged(digests, said).select(*KEYS, "caption_sha256")


def _entries(spark, sf):
    return fx.once("entries", lambda: _commit_plan(spark, sf))


def _commit_plan(spark, sf):
    cands, fails = fx.candidates(spark, sf), fx.failures(spark, sf)
    summary = runs.stage_summary(_reports(spark, sf), cands, fails)
    return runs.commit_plan(cands, fails, _digests(spark, sf), summary)


@query
def commit_entries(spark, sf):
    return _entries(spark, sf)


def _published(spark, sf):
    return fx.once("published", lambda: _verify(spark, sf))


def _verify(spark, sf):
    """Candidates with baselines, and what is found after publishing."""
    s = F.col("sample_id")
    time = F.timestamp_seconds(s + 1_700_000_000)
    fp = F.struct(F.lit(True).alias("exists"), (s * 10).alias("size"), time.alias("mtime"), F.lit(None).cast("string").alias("sha256"))
    cands = fx.candidates(spark, sf).withColumn("video_fp", fp)
    videos = cands.filter(s % 11 != 4).select(
        F.col("video_path").alias("path"), F.lit(True).alias("exists"),
        F.when(s % 7 == 1, s).otherwise(s * 10).alias("size"), time.alias("mtime"),
    )
    digests = _digests(spark, sf)
    targets = digests.join(cands.select(*KEYS, "target_path"), list(KEYS)).filter(s % 6 != 5).select(
        F.col("target_path").alias("path"),
        F.when(s % 10 == 3, 0).otherwise(F.col("caption_size")).alias("size"),
        F.when(s % 9 == 2, F.lit("0")).otherwise(F.col("caption_sha256")).alias("sha256"),
        F.when(s % 8 == 1, F.lit("bare_newline")).alias("format_code"),
    )
    return runs.verify_publish(cands, fx.failures(spark, sf), videos, targets, digests)


@query
def published_reports(spark, sf):
    """Candidates and failures published twice, the second time for the even runs, then by a writer that is lost; read
    back from the files of the newest version."""
    root = f"{shared_dir(spark)}/capsieve-published-{uuid.uuid4().hex}"
    cands, fails = fx.candidates(spark, sf), fx.failures(spark, sf)
    even = F.substring("run_id", 4, 9).cast("bigint") % 2 == 0
    publish.publish(spark, root, {"candidates": cands, "failures": fails})
    again = cands.filter(even).withColumn("duration_seconds", F.col("duration_seconds") * 2)
    publish.publish(spark, root, {"candidates": again, "failures": fails.filter(even & (F.col("sample_id") % 3 == 0))}, runs=again)
    publish.prepare(spark, root, {"candidates": cands.withColumn("duration_seconds", F.lit(0.0))})
    none = lambda kind: F.lit(None).cast(kind)
    one = publish.read(spark, root, "candidates").select(*KEYS, F.lit("candidates").alias("report"), "duration_seconds", none("string").alias("reason"))
    two = publish.read(spark, root, "failures").select(*KEYS, F.lit("failures").alias("report"), none("double").alias("duration_seconds"), "reason")
    return one.unionByName(two)


@query
def published_captions(spark, sf):
    return _published(spark, sf)


@query
def verification_counts(spark, sf):
    return runs.verification_summary(_published(spark, sf))


def _commits(spark, sf):
    return fx.runs(spark, sf).filter("status = 'committed'").select(
        "run_id", F.lit("2026-05-01T09:00:30+00:00").alias("committed_at_utc"), F.lit(0).cast("bigint").alias("entry_count")
    )


@query
def run_summaries(spark, sf):
    verified = _published(spark, sf)
    return runs.run_summary(
        fx.runs(spark, sf),
        fx.candidates(spark, sf),
        fx.candidates(spark, sf).filter("sample_id % 4 = 1"),
        fx.failures(spark, sf),
        _reports(spark, sf),
        _entries(spark, sf),
        _commits(spark, sf),
        runs.verification_summary(verified),
        verified.filter("failure_code IS NOT NULL"),
    )


@query
def completion_stats(spark, sf):
    stages = runs.stage_summary(_reports(spark, sf), fx.candidates(spark, sf), fx.failures(spark, sf))
    return runs.completion_stats(fx.runs(spark, sf), _commits(spark, sf), _entries(spark, sf), stages, fx.failures(spark, sf))


@query
def run_issues(spark, sf):
    bad = _published(spark, sf).filter("failure_code IS NOT NULL")
    return runs.run_issues(_reports(spark, sf), fx.failures(spark, sf), bad, _entries(spark, sf)).select(
        "run_id", "section", "section_no", "sample_id", "item_no", "message"
    )


def _run_files(spark, sf):
    areas = F.element_at(F.array(*[F.lit(a) for a in ("models", "runs", "temp", "venv")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return fx.table(spark, sf, "documents").select(
        F.concat(F.lit("run"), (F.col("doc_id") % 60).cast("string")).alias("run_id"), areas.alias("area"), F.col("n_chars").alias("length")
    )


@query
def run_inventory(spark, sf):
    return runs.run_inventory(_run_files(spark, sf), fx.runs(spark, sf))


@query
def inventory_total(spark, sf):
    return runs.inventory_total(runs.run_inventory(_run_files(spark, sf), fx.runs(spark, sf)))


@query
def usage_by_area(spark, sf):
    return runs.usage_by_area(_run_files(spark, sf))


@query
def resumable_runs(spark, sf):
    return runs.is_resumable(fx.runs(spark, sf)).select("run_id", "status")


@query
def first_failed_samples(spark, sf):
    return runs.first_failed(_reports(spark, sf))


@query
def all_failures(spark, sf):
    changed = snapshot.validate_candidates(fx.fingerprinted(spark, sf), fx.snapshots(spark, sf)[1])
    parts = {
        "candidate": fx.failures(spark, sf).select(*KEYS, "phase", "reason"),
        "gate": _reports(spark, sf).filter("NOT passed").select(*KEYS, F.lit("quality_gate").alias("phase"), F.array_join("errors", "|").alias("reason")),
        "snapshot": changed.select(*KEYS, F.lit("fingerprint").alias("phase"), F.concat_ws(" ", F.col("kind"), F.col("path")).alias("reason")),
        "verify": _published(spark, sf).filter("failure_code IS NOT NULL").select(*KEYS, F.lit("verify").alias("phase"), F.col("failure_code").alias("reason")),
    }
    return runs.all_failures(parts)


# --- event log -----------------------------------------------------------------------------------


@query
def parsed_events(spark, sf):
    return eventlog.events(fx.event_lines(spark, sf))


@query
def plain_lines(spark, sf):
    return eventlog.plain_lines(fx.event_lines(spark, sf))


@query
def run_progress(spark, sf):
    return progress.progress(eventlog.events(fx.event_lines(spark, sf)), fx.progress_totals(spark, sf))


_STATUS = (
    "run_id", "last_error.reason AS error_reason", "last_error.phase AS error_phase", "last_run_dir.path AS run_dir",
    "last_progress.index AS done_count", "last_progress.total AS total_count", "done",
)


@query
def last_events(spark, sf):
    rows = progress.last_events(eventlog.events(fx.event_lines(spark, sf)))
    return rows.selectExpr(*_STATUS)


@query
def failure_reports(spark, sf):
    lines = fx.event_lines(spark, sf)
    return progress.failure_info(lines, eventlog.events(lines), "fallback")


@query
def transfer_progress(spark, sf):
    return progress.transfer_progress(fx.transfer_lines(spark, sf), fx.transfer_plans(spark, sf))


# --- event log as a stream -----------------------------------------------------------------------


def _live(spark, sf):
    """A stream of the event lines, and a folder for what it gives."""
    folder = f"{shared_dir(spark)}/capsieve-stream-{uuid.uuid4().hex}"
    lines = fx.event_lines(spark, sf)
    lines.write.parquet(f"{folder}/lines")
    return live.route(live.read_lines(spark, f"{folder}/lines", lines.schema, max_files=8)), f"{folder}/out"


@query
def streamed_events(spark, sf):
    stream, out = _live(spark, sf)
    return live.drain(stream, out)


@query
def streamed_progress(spark, sf):
    stream, out = _live(spark, sf)
    return live.fold_steps(live.drain(live.progress_steps(stream), out), fx.progress_totals(spark, sf))


@query
def streamed_status(spark, sf):
    stream, out = _live(spark, sf)
    return live.newest(live.drain(live.latest_status(stream), out, "update")).selectExpr(*_STATUS)


@query
def streamed_failures(spark, sf):
    stream, out = _live(spark, sf)
    return live.drain(live.failed_candidates(stream), out).select("run_id", "sample_id")


# --- logs that grow while a stream reads them ----------------------------------------------------


def _grown(spark, sf, fold, mode):
    """What a stream gives over logs that are appended to between its runs, in pieces that end inside lines."""
    folder = f"{shared_dir(spark)}/capsieve-logs-{uuid.uuid4().hex}"
    logs = fx.once("log_bytes", lambda: fx.log_bytes(spark, sf))
    for part in (1, 2, 3):
        fx.append_logs(logs, f"{folder}/logs", part, 3)
        rows = live.drain(fold(live.route(growing.read_logs(spark, f"{folder}/logs").drop("path"))), f"{folder}/out", mode)
    return rows


@query
def growing_events(spark, sf):
    """Events of logs that grow; a line's number is the byte at which it starts."""
    rows = _grown(spark, sf, lambda parsed: parsed, "append")
    return rows.withColumn("run_id", F.col("run_id").cast("bigint"))


@query
def ended_runs(spark, sf):
    """Progress, failures and late rows of growing logs, the state of a run removed when it is done."""
    rows = lifecycle.settled(_grown(lifecycle.with_states(spark), sf, lifecycle.fold_runs, "update"))
    return rows.withColumn("run_id", F.col("run_id").cast("bigint"))
