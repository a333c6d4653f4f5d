"""Engine outputs: documents to segment rows, with clamps and validity checks.

Work on one document stays inside its row (higher-order functions over arrays and VARIANT), so
parsing and indexing need no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve import schemas
from capsieve.functions.binding import let, strict_json
from capsieve.functions.text import is_blank, strip_space
from capsieve.operators.ordering import lag_in_blocks, number_in_groups

#: List levels that are flattened natively; rows with more of them go through Python, whatever their depth.
NATIVE_NESTING = 3
INDEX_BLOCK = 4096


def read_engine_outputs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Every engine document below ``path``: ``file_path, run_id, readable`` and the document's fields.

    A file holds one JSON object, or one per line when it is compacted. A file of which some line is no object is
    read as a whole; if that is no object either, it gives one row that isn't readable. ``run_id`` is the folder
    directly below ``path``, unless it is given.
    """

    def texts(wholetext: bool = False) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=wholetext)
        found = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("value"))
        return found.withColumn("_object", F.startswith(F.schema_of_variant(strict_json("value")), F.lit("OBJECT")))

    lines = texts().where(strip_space(F.col("value")) != "").withColumn("_object", F.coalesce("_object", F.lit(False)))
    compacted = lines.groupBy("file_path").agg(F.bool_and("_object").alias("_compacted"))
    by_line = lines.join(compacted.where("_compacted"), "file_path").select("file_path", "value", F.lit(True).alias("readable"))
    whole = texts(wholetext=True).join(compacted.where("_compacted"), "file_path", "left_anti")
    whole = whole.select("file_path", "value", F.coalesce("_object", F.lit(False)).alias("readable"))
    below = F.substring_index("file_path", quote(path.split("://")[-1].rstrip("/")) + "/", -1)
    folder = F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1))
    folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    document = F.from_json(F.when(F.col("readable"), F.col("value")), schemas.ENGINE_OUTPUT)
    rows = by_line.unionByName(whole).select("file_path", (F.lit(run_id) if run_id else folder).alias("run_id"), "readable", document.alias("_d"))
    return rows.select("file_path", "run_id", "readable", "_d.*")


def check_identity(
    outputs: DataFrame, candidates: DataFrame, engines: Sequence[str], keys: Sequence[str] = ("run_id", "sample_id")
) -> DataFrame:
    """Adds ``rejected_reason``: the document must name a known sample of its run, its video and a known engine.

    Sample ids are numbered per run, so the run belongs to the key. Each document comes out once.
    """
    known = candidates.select(*keys, F.col("video_path").alias("_video"))
    unreadable = ~F.col("readable") if "readable" in outputs.columns else F.lit(False)
    return (
        outputs.join(known, list(keys), "left")
        .withColumn(
            "rejected_reason",
            F.when(unreadable, "unreadable")
            .when(F.col("_video").isNull(), "sample_id_mismatch")
            .when(~F.col("source_path").eqNullSafe(F.col("_video")), "source_path_mismatch")
            .when(~F.coalesce(F.col("engine").isin(*engines), F.lit(False)), "engine_mismatch"),
        )
        .drop("_video")
    )


def segment_rows(outputs: DataFrame, keys: Sequence[str] = ("run_id", "sample_id")) -> DataFrame:
    """``keys, engine, seg_index, start_ms, end_ms, text`` and the confidence columns."""
    return outputs.select(
        *keys, "engine", F.posexplode("segments").alias("seg_index", "s")
    ).select(
        *keys,
        "engine",
        F.col("seg_index").cast("bigint").alias("seg_index"),
        "s.start_ms",
        "s.end_ms",
        "s.text",
        "s.metadata.*",
    )


def _whole(value: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(value, 0).cast("bigint")


def clamp_secondary(raw: DataFrame, duration: Column) -> DataFrame:
    """Raw ``start``/``end`` seconds to ``start_ms``/``end_ms`` inside the audio; drops blank and empty ones."""
    total = _whole(duration * 1000.0)
    start = F.least(total, F.greatest(F.lit(0), _whole(F.col("start") * 1000.0)))
    end = F.least(total, F.greatest(F.col("start_ms") + 1, _whole(F.col("end") * 1000.0)))
    return (
        raw.withColumn("start_ms", start)
        .withColumn("end_ms", end)
        .withColumn("text", strip_space(F.col("text")))
        .filter("text <> '' AND end_ms > start_ms")
        .drop("start", "end")
    )


def clamp_primary_bounds(start: Column, end: Column, duration_ms: Column) -> Column:
    """STRUCT<start_ms, end_ms>; null when nothing is left inside the audio."""

    def stretch(b: Column) -> Column:
        high = F.when(b["high"] <= b["low"], F.least(duration_ms, b["low"] + 500.0)).otherwise(b["high"])
        return F.struct(b["low"].alias("low"), high.alias("high"))

    low = F.when(start.isNull(), 0.0).otherwise(F.least(F.greatest(F.lit(0.0), start), duration_ms))
    bounded = let(
        F.struct(low.alias("low"), end.alias("end")),
        lambda b: F.struct(
            b["low"].alias("low"),
            F.when(b["end"].isNull(), duration_ms)
            .otherwise(F.least(F.greatest(b["low"], b["end"]), duration_ms))
            .alias("high"),
        ),
    )
    return let(
        let(bounded, stretch),
        lambda b: F.when(
            b["high"] > b["low"],
            F.struct(_whole(b["low"]).alias("start_ms"), _whole(b["high"]).alias("end_ms")),
        ),
    )


def clamp_primary(raw: DataFrame, duration: Column) -> DataFrame:
    """Raw ``start``/``end`` milliseconds (either may be null) to bounds inside the audio."""
    bounds = clamp_primary_bounds(F.col("start"), F.col("end"), duration * 1000.0)
    return (
        raw.withColumn("_b", bounds)
        .withColumn("text", strip_space(F.col("text")))
        .filter("_b IS NOT NULL AND text <> ''")
        .drop("start", "end")
        .select("*", "_b.*")
        .drop("_b")
    )


# --- raw primary engine results ------------------------------------------------------------------


def _members(value: Column) -> Column:
    """An object as MAP<STRING, VARIANT>, else null. A member that is null stays a VARIANT null."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _items(value: Column) -> Column:
    """Elements of a JSON array, else null."""
    return F.try_variant_get(value, "$", "array<variant>")


def _present(members: Column, *keys: str) -> Column:
    """The first key that is present, even when its value is null."""
    return F.coalesce(*[F.try_element_at(members, F.lit(k)) for k in keys])


def _string(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _milliseconds(value: Column) -> Column:
    """A finite number >= 0 (also as text), else null; booleans are not numbers."""
    text = F.when(F.schema_of_variant(value) != "BOOLEAN", F.try_variant_get(value, "$", "string"))
    number = F.regexp_extract(text, r"^\s*\+?((?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*$", 1)
    return let(number.try_cast("double"), lambda n: F.when(n < float("inf"), n))


def _bounds(value: Column) -> Column:
    """STRUCT<start, end> over the valid pairs of a timestamp list: first start, last end."""

    def as_pair(item: Column) -> Column:
        numbers = F.transform(_items(item), _milliseconds)
        return let(numbers, lambda n: F.struct(F.get(n, F.lit(0)).alias("start"), F.get(n, F.lit(1)).alias("end")))

    pairs = F.filter(F.transform(_items(value), as_pair), lambda p: p["end"] >= p["start"])
    return let(
        pairs,
        lambda p: F.struct(
            F.get(p, F.lit(0))["start"].alias("start"),
            F.get(p, F.size(p) - 1)["end"].alias("end"),
        ),
    )


def _segment(members: Column, duration_ms: Column) -> Column:
    """STRUCT<start_ms, end_ms, text, confidence> of one result object, or null."""

    def clamp(f: Column) -> Column:
        start = F.coalesce(F.get(f["own"], F.lit(0)), f["stamps"]["start"])
        end = F.coalesce(F.get(f["own"], F.lit(1)), f["stamps"]["end"])
        return F.struct(
            f["text"].alias("text"),
            f["score"].alias("score"),
            clamp_primary_bounds(start, end, duration_ms).alias("b"),
        )

    def build(f: Column) -> Column:
        kind = F.schema_of_variant(f["score"])
        confidence = F.when(
            kind == "BOOLEAN", F.try_variant_get(f["score"], "$", "boolean").cast("int").cast("double")
        ).when(kind != "STRING", F.try_variant_get(f["score"], "$", "double"))
        return F.when(
            f["text"].isNotNull() & f["b"].isNotNull(),
            F.struct(
                f["b"]["start_ms"].alias("start_ms"),
                f["b"]["end_ms"].alias("end_ms"),
                f["text"].alias("text"),
                confidence.alias("confidence"),
            ),
        )

    texts = F.transform(
        F.array(*[F.try_element_at(members, F.lit(k)) for k in ("text", "sentence", "value")]),
        lambda v: strip_space(_string(v)),
    )
    own = F.transform(
        F.array(_present(members, "start", "start_ms", "begin"), _present(members, "end", "end_ms", "finish")),
        _milliseconds,
    )
    fields = F.struct(
        F.get(F.filter(texts, lambda t: t != ""), F.lit(0)).alias("text"),
        own.alias("own"),
        _bounds(_present(members, "timestamp", "timestamps")).alias("stamps"),
        F.try_element_at(members, F.lit("score")).alias("score"),
    )
    return let(let(fields, clamp), build)


def _flatten_once(items: Column) -> Column:
    """Lists inside the list are replaced by their elements."""
    return F.flatten(F.transform(items, lambda x: F.coalesce(_items(x), F.array(x))))


@F.pandas_udf(T.StringType())
def _flat_json(raw: pd.Series) -> pd.Series:
    """JSON documents with all their nested lists as one list; null stays null."""

    def flat(text: str | None) -> str | None:
        if text is None:
            return None
        out, rest = [], [json.loads(text)]
        while rest:
            item = rest.pop()
            if isinstance(item, list):
                rest.extend(reversed(item))
            else:
                out.append(item)
        return json.dumps(out)

    return raw.map(flat, na_action="ignore")


def normalize_primary(
    raw: DataFrame, keys: Sequence[str] = ("run_id", "sample_id")
) -> tuple[DataFrame, DataFrame]:
    """Raw result JSON (``keys, raw, duration_seconds``) to (segments, rejects).

    Children in ``sentence_info`` replace their parent when at least one is valid. Segments are
    indexed by (start, end), ties in document order; lists may be nested to any depth. Rejects: invalid
    documents, and documents without a valid segment.
    """
    duration_ms = F.col("duration_seconds") * 1000.0
    level = "level_0"
    staged = raw.withColumn("doc", strict_json(F.col("raw"))).withColumn(
        level, F.coalesce(_items(F.col("doc")), F.array("doc"))
    )
    for depth in range(NATIVE_NESTING):
        level = f"level_{depth + 1}"
        staged = staged.withColumn(level, _flatten_once(F.col(f"level_{depth}")))
    deep = F.exists(level, lambda x: _items(x).isNotNull())
    flat = _flat_json(F.when(deep, F.col("raw")))
    staged = staged.withColumn("_flat", flat).withColumn(
        "level_all", F.when(F.col("_flat").isNotNull(), _items(strict_json(F.col("_flat")))).otherwise(F.col(level))
    )
    level = "level_all"
    members = F.filter(F.transform(level, _members), lambda m: m.isNotNull())

    def chosen(item: Column) -> Column:
        sentences = F.transform(_items(F.try_element_at(item, F.lit("sentence_info"))), _members)
        # The parent stands last, behind its children; it counts only when no child is valid.
        both = F.concat(F.coalesce(sentences, F.array().cast("array<map<string,variant>>")), F.array(item))
        found = F.transform(both, lambda m: _segment(m, duration_ms))
        children = lambda a: F.filter(
            F.slice(a, F.lit(1), F.size(a) - 1), lambda s: s.isNotNull()
        )
        return let(
            let(found, lambda a: F.struct(a.alias("all"), children(a).alias("children"))),
            lambda f: F.when(F.size(f["children"]) > 0, f["children"]).otherwise(
                F.filter(F.slice(f["all"], F.lit(-1), F.lit(1)), lambda s: s.isNotNull())
            ),
        )

    judged = (
        staged.withColumn("objects", members)
        .withColumn("segments", F.flatten(F.transform("objects", chosen)))
        .withColumn(
            "rejected_reason",
            F.when(F.col("doc").isNull(), "invalid_json")
            .when(F.size("segments") == 0, "no_segments"),
        )
    )
    ordered = F.array_sort(
        F.transform(
            "segments",
            lambda s, i: F.struct(
                s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), i.alias("i"), s.alias("s")
            ),
        )
    )
    segments = (
        judged.filter("rejected_reason IS NULL")
        .select(*keys, F.posexplode(ordered).alias("seg_index", "o"))
        .select(
            *keys,
            F.col("seg_index").cast("bigint").alias("seg_index"),
            "o.start_ms",
            "o.end_ms",
            "o.s.text",
            "o.s.confidence",
        )
    )
    return segments, judged.filter("rejected_reason IS NOT NULL").select(*keys, "rejected_reason")


# --- segment checks ------------------------------------------------------------------------------


def index_segments(
    segments: DataFrame, keys: Sequence[str] = ("run_id", "sample_id"), raw_position: str = "raw_pos"
) -> DataFrame:
    """``seg_index`` by (start, end, raw position) inside each sample, without one task per sample."""
    order = [F.col("start_ms"), F.col("end_ms"), F.col(raw_position)]
    return number_in_groups(segments, keys, order, "_n").withColumn("seg_index", F.col("_n") - 1).drop("_n")


def reject_segments(
    segments: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("run_id", "sample_id", "engine")
) -> DataFrame:
    """Segments that no output can answer for, with ``rejected_reason``: ``no_output`` or ``no_index``."""
    known = outputs.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_known", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys])
    reason = F.when(F.col("_known").isNull(), "no_output").when(F.col("seg_index").isNull(), "no_index")
    found = segments.join(known, same, "left").withColumn("rejected_reason", reason)
    return found.filter("rejected_reason IS NOT NULL").select(*segments.columns, "rejected_reason")


def validate_segments(
    segments: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("run_id", "sample_id", "engine")
) -> DataFrame:
    """Per engine output: ``segment_count, first_bad_index, invalid_reason`` (null when valid).

    ``outputs`` lists the outputs with their ``duration_seconds``; one without segments is invalid, and so is one with a
    segment that has no index, as its place in the order is unknown. Segments of no listed output are in none of the
    rows; :func:`reject_segments` gives those. The end limit reaches the segments by way of the block table, never for a whole sample in one task.
    """
    limit = (F.ceil(F.col("duration_seconds") * 1000.0) + 5000).alias("_limit")
    limits = outputs.select(*keys, limit)
    lagged = lag_in_blocks(
        segments.filter("seg_index IS NOT NULL").select(
            *keys, "seg_index", "start_ms", "end_ms", is_blank(F.col("text")).alias("_blank")
        ),
        keys,
        F.floor(F.col("seg_index") / INDEX_BLOCK),
        ["seg_index"],
        ["start_ms"],
        per_key=limits,
    )
    bad = (
        (F.col("start_ms") < 0)
        | (F.col("end_ms") <= F.col("start_ms"))
        | (F.col("start_ms") < F.coalesce(F.col("previous.start_ms"), F.lit(-1)))
        | F.col("_blank")
    )
    late = F.col("end_ms") > F.col("_limit")
    checked = lagged.groupBy(*keys).agg(
        F.count("*").alias("segment_count"),
        F.min(F.when(bad | late, F.col("seg_index"))).alias("first_bad_index"),
    )
    loose = segments.filter("seg_index IS NULL").groupBy(*keys).agg(F.count("*").alias("_loose"))
    return (
        outputs.select(*keys)
        .join(checked, list(keys), "left")
        .join(loose, list(keys), "left")
        .withColumn("segment_count", F.coalesce("segment_count", F.lit(0)) + F.coalesce("_loose", F.lit(0)))
        .withColumn(
            "invalid_reason",
            F.when(F.col("segment_count") == 0, "no_segments")
            .when(F.col("first_bad_index").isNotNull(), "invalid_segment")
            .when(F.col("_loose").isNotNull(), "unindexed_segment"),
        )
        .drop("_loose")
    )
