"""Captions: rendering to timed blocks and parts, validation, metrics.

A caption is cut into parts of one hour of media. Parts concatenate to the exact file, no row grows
with the length of a recording, and sizes add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.functions.text import by_need, normalize_text
from capsieve.functions.timecode import format_seconds, format_timestamp, parse_timestamp
from capsieve.operators.ordering import lag_in_blocks
from capsieve.session import materialize

KEYS = ("run_id", "sample_id")
PART_MS = 3_600_000
GAP_BLOCK_MS = 600_000
CRLF = "\r\n"

FORMAT_RULES = (
    "encoding", "bare_newline", "no_final_newline", "incomplete_block", "invalid_block",
    "missing_blank_line", "not_monotonic",
)


def caption_blocks(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per caption block: segments whose normalised text is not empty.

    The empty ones are dropped by the generator: a filter would be pushed down and repeat the rules.
    """

    def blocks(rows: DataFrame, stable: bool) -> DataFrame:
        solid = F.filter(F.array(normalize_text(F.col("text"), stable)), lambda caption: caption != "")
        return rows.select(
            *keys,
            "start_ms",
            "end_ms",
            "seg_index",
            format_timestamp(F.col("start_ms")).alias("timecode"),
            F.explode(solid).alias("caption"),
        )

    return by_need(segments, blocks)


def caption_parts(segments: DataFrame, keys: Sequence[str] = KEYS, part_ms: int = PART_MS) -> DataFrame:
    """``keys, part_no, caption``: parts of at most ``part_ms`` of media; in order they make the file."""
    blocks = caption_blocks(segments, keys)
    text = F.concat("timecode", F.lit(CRLF), "caption", F.lit(CRLF))
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "seg_index", text.alias("t"))))
    # Written out, as the text rules would run once more for the first parts.
    grouped = materialize(
        blocks.groupBy(*keys, F.floor(F.col("start_ms") / part_ms).alias("part_no")).agg(
            F.array_join(F.transform(listed, lambda b: b["t"]), CRLF).alias("_text")
        )
    )
    first = grouped.groupBy(*keys).agg(F.min("part_no").alias("_first"))
    lead = F.when(F.col("part_no") == F.col("_first"), "").otherwise(CRLF)
    return grouped.join(first, list(keys)).select(
        *keys, "part_no", F.encode(F.concat(lead, "_text"), "UTF-8").alias("caption")
    )


def _stream_digests(keys: Sequence[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Digests of the captions of a partition, whose parts come in order; only a running hash is held."""
    columns = [*keys, "part_count", "caption_size", "caption_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, count, size, digest = None, 0, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, part in batch[[*keys, "caption"]].itertuples(index=False):
                if at != key:
                    if at is not None:
                        done.append((*at, count, size, digest.hexdigest()))
                    at, count, size, digest = key, 0, 0, hashlib.sha256()
                digest.update(part)
                count, size = count + 1, size + len(part)
            yield pd.DataFrame(done, columns=columns)
        if at is not None:
            yield pd.DataFrame([(*at, count, size, digest.hexdigest())], columns=columns)

    return run


def caption_digests(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, part_count, caption_size, caption_sha256`` of whole captions, hashed part by part in order.

    A window asks for a caption's parts side by side and in order, whatever adaptive execution makes of what is below;
    a repartition goes where a join has dealt the rows alike, and with that join's plan their place may change.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("part_no")).alias("_place")
    ordered = parts.select(*keys, "part_no", "caption", place)
    return ordered.mapInPandas(_stream_digests(keys), f"{fields}, part_count bigint, caption_size bigint, caption_sha256 string")


def whole_captions(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per caption file, for targets that take whole files (each bounded by its file size)."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", F.col("caption").cast("string").alias("t"))))
    text = F.array_join(F.transform(ordered, lambda p: p["t"]), "")
    return parts.groupBy(*keys).agg(F.encode(text, "UTF-8").alias("caption"))


def block_metrics(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Caption metrics straight from the segments, without assembling files.

    Equal to :func:`validate_captions` over the rendered captions: rendering guarantees the format, so
    only a sample without any block is missing here.
    """
    blocks = caption_blocks(segments, keys).select(
        *keys,
        "start_ms",
        "end_ms",
        "seg_index",
        F.char_length("caption").alias("chars"),
        F.greatest(F.lit(0), F.floor(F.col("start_ms") / 1000)).alias("second"),
    )
    lagged = lag_in_blocks(
        blocks, keys, F.floor(F.col("start_ms") / GAP_BLOCK_MS), ["start_ms", "end_ms", "seg_index"], ["second"]
    )
    return lagged.groupBy(*keys).agg(
        F.count("*").alias("segment_count"),
        F.percentile("chars", 0.5).alias("median_text_chars"),
        F.max("chars").cast("bigint").alias("max_text_chars"),
        F.coalesce(F.percentile(F.col("second") - F.col("previous.second"), 0.5), F.lit(0.0)).alias(
            "median_gap_seconds"
        ),
        format_seconds(F.min("second")).alias("first_timestamp"),
        format_seconds(F.max("second")).alias("last_timestamp"),
    )


def _median(values: Column) -> Column:
    """Exact median of an array."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, ((n - 1) / 2).cast("int"))
    high = F.get(ordered, (n / 2).cast("int"))
    return (low + high) / 2.0


def validate_captions(captions: DataFrame, content: str = "caption") -> DataFrame:
    """Adds ``format_code`` (null when valid) and the caption metrics to rows with caption bytes.

    Each file is one row, so the checks run inside the row: no explode, no shuffle.
    """
    payload = F.col(content)
    utf8 = F.is_valid_utf8(payload.cast("string")) & ~F.hex(F.substring(payload, 1, 3)).rlike(
        "^(EFBBBF|FFFE|FEFF)"
    )
    staged = captions.withColumn("_utf8", F.coalesce(utf8, F.lit(False))).withColumn(
        "_text", F.when(F.col("_utf8"), payload.cast("string")).otherwise("")
    )
    split = F.split("_text", CRLF)
    staged = staged.withColumn("_lines", F.slice(split, F.lit(1), F.size(split) - 1))
    total = F.size("_lines")
    line = lambda i: F.get("_lines", i)
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(3)))
    block = lambda i: F.struct(
        parse_timestamp(line(i)).alias("second"),
        F.char_length(line(i + 1)).alias("chars"),
        F.when(i + 1 >= total, "incomplete_block")
        .when(parse_timestamp(line(i)).isNull() | (line(i + 1) == ""), "invalid_block")
        .when((i + 2 < total) & (line(i + 2) != ""), "missing_blank_line")
        .alias("code"),
    )
    staged = staged.withColumn("_blocks", F.transform(starts, block))
    staged = staged.withColumn("_seconds", F.transform("_blocks", lambda b: b["second"]))
    broken = F.get(F.filter(F.transform("_blocks", lambda b: b["code"]), lambda c: c.isNotNull()), F.lit(0))
    code = (
        F.when(~F.col("_utf8"), "encoding")
        .when(F.col("_text").rlike(r"(?<!\r)\n"), "bare_newline")
        .when(~F.col("_text").endswith(CRLF), "no_final_newline")
        .otherwise(
            F.coalesce(broken, F.when(F.array_sort("_seconds") != F.col("_seconds"), "not_monotonic"))
        )
    )
    chars = F.transform("_blocks", lambda b: b["chars"])
    gaps = F.transform(
        F.slice("_seconds", F.lit(2), F.greatest(F.size("_seconds") - 1, F.lit(0))),
        lambda s, i: s - F.get("_seconds", i),
    )
    when_valid = lambda c: F.when(F.col("format_code").isNull(), c)
    zero = lambda c: F.coalesce(when_valid(c), F.lit(0))
    return (
        staged.withColumn("format_code", code)
        .withColumns(
            {
                "segment_count": zero(F.size("_blocks").cast("bigint")),
                "median_text_chars": zero(_median(chars)).cast("double"),
                "max_text_chars": zero(F.array_max(chars).cast("bigint")),
                "median_gap_seconds": zero(F.when(F.size(gaps) > 0, _median(gaps))).cast("double"),
                "first_timestamp": F.coalesce(when_valid(format_seconds(F.get("_seconds", F.lit(0)))), F.lit("")),
                "last_timestamp": F.coalesce(when_valid(format_seconds(F.element_at("_seconds", -1))), F.lit("")),
            }
        )
        .drop("_utf8", "_text", "_lines", "_blocks", "_seconds")
    )
