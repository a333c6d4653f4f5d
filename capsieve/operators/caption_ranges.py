"""Caption rules over byte ranges of a file: no row ever holds a whole file.

A caption file is a sequence of lines whose meaning depends on their number only: time code, text, blank, and again. The
number of line ends in a range is what a range does to that state, and it adds up, so ranges are cut into lines on their
own, and a running sum over one row for each range gives every line its number. Lines cut by a border are put together
by their number; all else is a matter of single lines, of blocks of three, and of neighbouring blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsieve.functions.timecode import format_seconds, parse_timestamp
from capsieve.operators.ordering import lag_in_blocks

KEYS = ("run_id", "sample_id")
CRLF = "\r\n"
#: Blocks whose times are compared in one window.
NEAR = 512
BYTES = "ISO-8859-1"  # a character for each byte, so that a cut inside a character does no harm


def numbered_pieces(ranges: DataFrame, keys: Sequence[str] = KEYS, order: str = "part_no", content: str = "caption") -> DataFrame:
    """``keys, line_no, at, cut, last, piece``: what each range holds of each line, as one character for each byte.

    ``cut`` says that the line may go on in another range. A return at the end of a range belongs to the next one.
    ``last`` marks the open line behind the last line end.
    """
    found = ranges.filter(F.octet_length(content) > 0).select(*keys, F.col(order).alias("at"), F.decode(content, BYTES).alias("text"))
    of_file = Window.partitionBy(*keys).orderBy("at")
    ends = found.select(*keys, "at", F.endswith("text", F.lit("\r")).alias("_cr"))  # one short row for each range
    ends = ends.select(
        *keys, "at", F.coalesce(F.lag("_cr").over(of_file), F.lit(False)).alias("_takes"),
        (F.col("_cr") & F.lead("at").over(of_file).isNotNull()).alias("_gives"), F.lead("at").over(of_file).isNull().alias("_end"),
    )
    text = F.concat(F.when(F.col("_takes"), "\r").otherwise(""), F.when(F.col("_gives"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    cut = found.join(ends, [*keys, "at"]).select(*keys, "at", "_end", F.split(text, CRLF).alias("pieces"))
    counts = cut.select(*keys, "at", (F.size("pieces") - 1).cast("bigint").alias("_n"))
    before = counts.select(*keys, "at", F.coalesce(F.sum("_n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = (F.col("_before") + F.col("place")).alias("line_no")
    return (
        cut.join(before, [*keys, "at"])
        .select(*keys, "at", "_before", "_end", (F.size("pieces") - 1).alias("_last"), F.posexplode("pieces").alias("place", "piece"))
        .select(*keys, number, "at", (F.col("place") == 0) | (F.col("place") == F.col("_last")), (F.col("_end") & (F.col("place") == F.col("_last"))).alias("last"), "piece")
        .toDF(*keys, "line_no", "at", "cut", "last", "piece")
    )


def whole_lines(pieces: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, line_no, last, line`` (bytes); a line that no border cuts isn't moved."""
    inside = pieces.filter("NOT cut").select(*keys, "line_no", "last", "piece")
    listed = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = pieces.filter("cut").groupBy(*keys, "line_no").agg(F.bool_or("last").alias("last"), F.array_join(F.transform(listed, lambda p: p["piece"]), "").alias("piece"))
    return inside.unionByName(joined).select(*keys, "line_no", "last", F.encode("piece", BYTES).alias("line"))


def validate_ranges(ranges: DataFrame, keys: Sequence[str] = KEYS, order: str = "part_no", content: str = "caption") -> DataFrame:
    """``format_code`` and the metrics of whole files, one row for each file, as ``captions.validate_captions`` has them.

    ``ranges`` hold the bytes of the files in the order of ``order``, cut anywhere; empty ranges are allowed.
    """
    lines = whole_lines(numbered_pieces(ranges, keys, order, content), keys)
    valid = F.is_valid_utf8(F.col("line").cast("string"))
    first = F.hex(F.substring("line", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)") & (F.col("line_no") == 0)
    looked = lines.select(
        *keys, "line_no", "last", (~valid | first).alias("_bad"), F.decode("line", BYTES).contains("\n").alias("_feed"),
        F.when(valid, F.col("line").cast("string")).otherwise("").alias("t"),
    )
    files = looked.groupBy(*keys).agg(
        F.bool_or("_bad").alias("_encoding"), F.bool_or("_feed").alias("_bare"),
        F.bool_or(F.col("last") & (F.col("t") != "")).alias("_open"), F.max("line_no").alias("_lines"),
    )
    role = F.col("line_no") % 3
    of = lambda k, c: F.max(F.when(role == k, c))
    blocks = (
        looked.filter("NOT last")
        .groupBy(*keys, F.floor(F.col("line_no") / 3).alias("block"))
        .agg(
            of(0, parse_timestamp(F.col("t"))).alias("second"), of(1, F.char_length("t")).alias("chars"),
            F.coalesce(of(2, F.col("t") != ""), F.lit(False)).alias("_crowded"),
        )
        .withColumn(
            "code",
            F.when(F.col("chars").isNull(), "incomplete_block")
            .when(F.col("second").isNull() | (F.col("chars") == 0), "invalid_block")
            .when(F.col("_crowded"), "missing_blank_line"),
        )
    )
    timed = lag_in_blocks(blocks.select(*keys, "block", "second", "chars", "code"), keys, F.floor(F.col("block") / NEAR), ["block"], ["second"])
    gap = F.col("second") - F.col("previous.second")
    folded = timed.withColumn("_gap", gap).groupBy(*keys).agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("block"))).alias("_code"), F.coalesce(F.bool_or(F.col("_gap") < 0), F.lit(False)).alias("_back"),
        F.count("*").alias("_n"), F.percentile("chars", 0.5).alias("_median"), F.max("chars").cast("bigint").alias("_max"),
        F.percentile("_gap", 0.5).alias("_gap"), F.min_by("second", "block").alias("_first"), F.max_by("second", "block").alias("_last"),
    )
    every = ranges.select(*keys).distinct()
    none = lambda c: F.coalesce(c, F.lit(False))
    code = (
        F.when(none("_encoding"), "encoding")
        .when(none("_bare"), "bare_newline")
        .when(F.col("_lines").isNull() | none("_open") | (F.col("_lines") == 0), "no_final_newline")
        .otherwise(F.coalesce("_code", F.when(F.col("_back"), "not_monotonic")))
    )
    good = lambda c, other: F.coalesce(F.when(F.col("format_code").isNull(), c), F.lit(other))
    joined = reduce(lambda a, b: a.join(b, list(keys), "left"), [every, files, folded]).withColumn("format_code", code)
    return joined.select(
        *keys, "format_code", good(F.col("_n"), 0).alias("segment_count"), good(F.col("_median"), 0.0).alias("median_text_chars"),
        good(F.col("_max"), 0).alias("max_text_chars"), good(F.col("_gap"), 0.0).alias("median_gap_seconds"),
        good(format_seconds(F.col("_first")), "").alias("first_timestamp"), good(format_seconds(F.col("_last")), "").alias("last_timestamp"),
    )
