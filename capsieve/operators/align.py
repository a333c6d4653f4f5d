"""Alignment of two transcripts: interval overlap, agreement and risk.

Overlapping segments are found in blocks of time, so one long sample spreads over many tasks, with one shuffle. Samples
with long segments or crowded blocks go by a dyadic index of time (:mod:`capsieve.operators.intervals`) instead, where a
segment of any length costs few rows and a popular time spreads. What is matched and what isn't, on both sides, comes from
one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capsieve.functions.text import comparison_text, needs_unicode, nfkc, tokens_of
from capsieve.operators.intervals import NEAR, WIDTH_MS, floor_div, overlaps
from capsieve.session import materialize

KEYS = ("run_id", "sample_id")
RISK_RATIO = 0.60  # fixed value

REVIEW = "keep_primary_review_secondary"
MISSING = "keep_primary_missing_secondary"


SEGMENT = ("seg_index", "start_ms", "end_ms", "text")


def _pairs(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int, *columns: str) -> DataFrame:
    side = lambda rows: rows.select(*keys, *columns)
    return overlaps(side(secondary), side(primary), keys, width=width)


def _overlap() -> Column:
    return F.least("p_end", "s_end") - F.greatest("p_start", "s_start")


def overlap_pairs(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS, width: int = WIDTH_MS
) -> DataFrame:
    """Every (secondary, primary) segment pair of a sample that shares time, with the shared length."""
    return _pairs(primary, secondary, keys, width, *SEGMENT[:3]).select(
        *keys,
        F.col("l.seg_index").alias("secondary_index"),
        F.col("r.seg_index").alias("primary_index"),
        (F.least("l.end_ms", "r.end_ms") - F.greatest("l.start_ms", "r.start_ms")).alias("overlap_ms"),
    )


def overlap_pairs_plain(primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same pairs by one join on the sample; for checks, as one sample means one task."""
    p = primary.select(*keys, F.col("seg_index").alias("primary_index"), F.col("start_ms").alias("p_start"), F.col("end_ms").alias("p_end"))
    s = secondary.select(*keys, F.col("seg_index").alias("secondary_index"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"))
    return s.join(p, list(keys)).filter(_overlap() > 0).select(
        *keys, "secondary_index", "primary_index", _overlap().alias("overlap_ms")
    )


@F.pandas_udf(T.DoubleType())
def _ratcliff(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio, left before right as the measure is not symmetric.

    Empty and equal texts are settled natively and reach the UDF as nulls; so are texts of which one holds the other, as
    that is then the longest match and leaves nothing beside it. From 200 letters on the measure passes over frequent ones.
    """
    m, n = F.char_length(left), F.char_length(right)
    inner = (n < 200) & (F.contains(left, right) | F.contains(right, left))
    hard = (left != "") & (right != "") & (left != right) & ~inner
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(inner, F.lit(2.0) * F.least(m, n) / (m + n))
        .otherwise(_ratcliff(F.when(hard, left), F.when(hard, right)))
    )


def token_mismatch(left: Column, right: Column) -> Column:
    """Sorted symmetric difference of two token sets."""
    return F.sort_array(F.array_union(F.array_except(left, right), F.array_except(right, left)))


#: A block is so many cells of the index. Segments that are placed by arithmetic reach into the next one at most.
BLOCK = 24
#: More segments that start in one block are left to the index.
CROWD = 1_024


def _cells(rows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The rows with ``_at``, ``_to`` (start and end), ``_cell`` (the start's) and ``_timed``: whether they can have a partner."""
    at, to = (F.col(c).cast("bigint") for c in ("start_ms", "end_ms"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    timed = known & F.coalesce(to > at, F.lit(False))
    cell = F.when(timed, F.expr(floor_div("CAST(start_ms AS BIGINT)", width)))
    return rows.withColumns({"_at": at, "_to": to, "_cell": cell, "_timed": timed})


def _kinds(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``keys`` of the samples that need the index: with segments of many cells or many segments in a block."""
    last = F.expr(floor_div("(_to - 1)", width))
    one = [
        _cells(rows.select(*keys, "start_ms", "end_ms"), keys, width).where("_timed").select(
            *keys, F.expr(floor_div("_cell", BLOCK)).alias("_block"), (last - F.col("_cell") >= NEAR).alias("_far")
        )
        for rows in (primary, secondary)
    ]
    blocks = one[0].unionByName(one[1]).groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.bool_or("_far").alias("_far"))
    return materialize(blocks.where((F.col("_n") > CROWD) | F.col("_far")).select(*keys).distinct())


def _folded(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """One row per secondary segment and per primary one without partner: ``side`` (``s`` or ``p``), the segment, and
    ``hits``, the partners' (index, text).

    Segments without index or times stay. Segments that are equal in all columns count as one. Samples whose segments are
    short and spread, as most are, are folded in blocks of time; the index takes the others, after a look at all.
    """
    crowded = _kinds(primary, secondary, keys, width)
    if crowded.isEmpty():
        return _folded_in_blocks(primary, secondary, keys, width)
    rest, some = ([rows.join(crowded, list(keys), how) for rows in (primary, secondary)] for how in ("left_anti", "left_semi"))
    return _folded_in_blocks(*rest, keys, width).unionByName(_folded_by_index(*some, keys, width))


def _folded_in_blocks(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """:func:`_folded` of samples without long segments and crowded blocks, with one shuffle.

    A segment is at home in the block of its start. It is copied to the next one if it reaches there, and to the one
    before if a segment that is at home there may reach its start, so all partners of a segment are found at its home.
    """
    own = F.expr(floor_div("_cell", BLOCK))
    over = F.expr(floor_div(floor_div("(_to - 1)", width), BLOCK)) > own
    early = F.expr(f"pmod(_cell, {BLOCK}L)") < NEAR - 1
    place = lambda block, home: F.struct(block.alias("block"), F.lit(home).alias("home"))
    copies = F.array(
        place(own, True), F.when(F.col("_timed") & over, place(own + 1, False)), F.when(F.col("_timed") & early, place(own - 1, False))
    )
    names = list(SEGMENT)
    sides = [
        _cells(rows.select(*keys, *SEGMENT), keys, width).select(*keys, F.lit(side).alias("side"), *SEGMENT, "_at", "_to", F.inline(copies))
        for side, rows in (("p", primary), ("s", secondary))
    ]
    both = sides[0].unionByName(sides[1]).where("home IS NOT NULL")
    # Segments are dealt by one number, that of their block, so that rows are sorted by it and not by the keys; those
    # without times have one of their own.
    number = F.when(F.col("block").isNotNull(), F.xxhash64(*keys, "block")).otherwise(F.xxhash64(*keys, "side", *SEGMENT))
    first = F.col("side") == "p"
    dealt = both.withColumn("segment_no", number).repartition("segment_no").groupBy("segment_no", *keys, "block").agg(
        F.collect_set(F.when(~first & F.col("home"), F.struct(*names, "_at", "_to"))).alias("own"),
        F.collect_list(F.when(~first & ~F.col("home"), F.struct("_at", "_to"))).alias("near"),
        F.collect_set(F.when(first & F.col("home"), F.struct(*names, "_at", "_to"))).alias("lone"),
        F.collect_list(F.when(first, F.struct(F.col("seg_index").cast("bigint").alias("i"), F.col("text").alias("t"), "_at", "_to"))).alias("held"),
    )
    timed = F.col("block").isNotNull()
    meet = lambda a, b: timed & (a["_at"] < b["_to"]) & (b["_at"] < a["_to"])
    hit = lambda h: F.struct(h["i"].alias("i"), h["t"].alias("t"))
    found = lambda x: F.sort_array(F.transform(F.filter("held", lambda h: meet(x, h)), hit))
    row = lambda side, x, hits: F.struct(F.lit(side).alias("side"), *[x[c].alias(c) for c in names], hits.alias("hits"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<i: BIGINT, t: STRING>>)")
    free = F.filter("lone", lambda x: ~F.exists("own", lambda y: meet(x, y)) & ~F.exists("near", lambda y: meet(x, y)))
    out = F.concat(F.transform("own", lambda x: row("s", x, found(x))), F.transform(free, lambda x: row("p", x, none)))
    return dealt.select(*keys, F.inline(out))


def _folded_by_index(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """:func:`_folded` of any samples. Segments and pairs meet in one aggregation, so the pairs are computed once; of a
    primary segment's partners only the number counts.
    """
    mark = F.xxhash64("text")
    secondary = secondary.select(*keys, *SEGMENT).distinct()
    own = ["seg_index", "start_ms", "end_ms", "mark"]
    marked = {side: rows.select(*keys, *SEGMENT, mark.alias("mark")) for side, rows in (("s", secondary), ("p", primary))}
    none = "CAST(NULL AS STRUCT<i: BIGINT, t: STRING>)"
    lone = [
        rows.select(*keys, F.lit(side).alias("side"), *own, "text", F.expr(none).alias("hit"), F.lit(0).alias("partners"))
        for side, rows in marked.items()
    ]
    pairs = overlaps(marked["s"].drop("text"), marked["p"], keys, width=width)
    met = lambda side, of, hit: F.struct(
        F.lit(side).alias("side"), *[F.col(f"{of}.{c}") for c in own], F.lit(None).cast("string").alias("text"), hit.alias("hit"), F.lit(1).alias("partners")
    )
    hit = F.struct(F.col("r.seg_index").cast("bigint").alias("i"), F.col("r.text").alias("t"))
    both = pairs.select(*keys, F.inline(F.array(met("s", "l", hit), met("p", "r", F.expr(none)))))
    # A number for the segment comes first in the grouping, so that rows are sorted by it and not by the keys. Dealt by it
    # before, as lists are built once then, behind the shuffle.
    found = lone[0].unionByName(lone[1]).unionByName(both).withColumn("segment_no", F.xxhash64(*keys, "side", *own))
    return (
        found.repartition("segment_no")
        .groupBy("segment_no", *keys, "side", *own)
        .agg(F.any_value("text", True).alias("text"), F.sort_array(F.collect_list("hit")).alias("hits"), F.sum("partners").alias("partners"))
        .where("side = 's' OR partners = 0")
        .select(*keys, "side", *SEGMENT, "hits")
    )


def _texts(folded: DataFrame) -> DataFrame:
    return folded.withColumn("primary_indexes", F.transform("hits", lambda h: h["i"])).withColumn(
        "primary_text", F.array_join(F.transform("hits", lambda h: h["t"]), "")
    )


def matched_text(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS, width: int = WIDTH_MS
) -> DataFrame:
    """One row per secondary segment with the joined text and indexes of the primary ones it overlaps."""
    return _texts(_folded(primary, secondary, keys, width).filter("side = 's'")).select(
        *keys, F.col("seg_index").alias("secondary_index"), "start_ms", "end_ms", F.col("text").alias("secondary_text"),
        "primary_indexes", "primary_text",
    )


def unmatched_primary(
    primary: DataFrame, secondary: DataFrame, keys: Sequence[str] = KEYS, width: int = WIDTH_MS
) -> DataFrame:
    """Primary segments that overlap no secondary one."""
    span = ["seg_index", "start_ms", "end_ms"]
    hit = _pairs(primary, secondary, keys, width, *span).select(*[F.col(f"r.{c}").alias(f"_{c}") for c in [*keys, *span]])
    same = F.lit(True)
    for c in [*keys, "start_ms", "end_ms"]:
        same &= F.col(c) == F.col(f"_{c}")
    return primary.join(hit, same & F.col("seg_index").eqNullSafe(F.col("_seg_index")), "left_anti")


def align(
    primary: DataFrame,
    secondary: DataFrame,
    keys: Sequence[str] = KEYS,
    width: int = WIDTH_MS,
    with_ratio: bool = True,
) -> DataFrame:
    """Alignment rows: one per secondary segment, and one per primary segment without a partner.

    Without the ratio, risk rests on missing partners and token differences alone and every step
    stays native. Segments without index or times have no partner but keep their row. Python workers see the samples whose
    texts need Unicode's rules, after a look at all, and with the ratio the texts it can't be told for.
    """
    build = lambda one, two, stable: _aligned(one, two, keys, width, with_ratio, stable)
    found = [rows.where(needs_unicode(F.col("text"))).select(*keys) for rows in (primary, secondary)]
    some = materialize(found[0].unionByName(found[1]).distinct())
    if some.isEmpty():
        return build(primary, secondary, True)
    # Null keys are samples here, as they are where rows are grouped.
    said = some.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    rest, hard = ([rows.join(said, same, how) for rows in (primary, secondary)] for how in ("left_anti", "left_semi"))
    return build(*rest, True).unionByName(build(*hard, False))


def _aligned(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], width: int, with_ratio: bool, stable: bool) -> DataFrame:
    """:func:`align` of samples whose texts are ``stable`` (see :func:`capsieve.functions.text.by_need`), or of any."""
    tokens = lambda c: tokens_of(nfkc(F.col(c), stable)).alias(f"_{c}")
    lone = F.col("side") == "p"
    rows = _texts(_folded(primary, secondary, keys, width)).withColumns(
        {
            "secondary_index": F.when(~lone, F.col("seg_index")),
            "primary_indexes": F.when(lone, F.array(F.col("seg_index").cast("bigint"))).otherwise(F.col("primary_indexes")),
            "primary_text": F.when(lone, F.col("text")).otherwise(F.col("primary_text")),
            "secondary_text": F.when(lone, F.lit("")).otherwise(F.col("text")),
        }
    )
    # Generated, so that each text is split once; as columns both would be repeated wherever they are named.
    rows = rows.select("*", F.inline(F.array(F.struct(tokens("primary_text"), tokens("secondary_text")))))
    mismatch = F.array(token_mismatch(F.col("_primary_text"), F.col("_secondary_text")))
    rows = rows.select("*", F.explode(mismatch).alias("token_mismatch")).drop("_primary_text", "_secondary_text")
    risky = lone | (F.size("primary_indexes") == 0) | (F.size("token_mismatch") > 0)
    ratio = F.lit(None).cast("double")
    if with_ratio:
        # Generated too, as the measure names both often.
        compared = [comparison_text(F.col(c), stable).alias(f"_{c}") for c in ("primary_text", "secondary_text")]
        rows = rows.select("*", F.inline(F.array(F.struct(*compared))))
        ratio = similarity(F.col("_primary_text"), F.col("_secondary_text"))
        risky = risky | (F.col("_ratio") < RISK_RATIO)
    return rows.withColumn("_ratio", ratio).select(
        *keys, "secondary_index", "primary_indexes", "start_ms", "end_ms", "primary_text", "secondary_text",
        F.bround("_ratio", 6).alias("similarity_ratio"), "token_mismatch", risky.alias("high_risk"),
        F.when(lone, MISSING).otherwise(REVIEW).alias("decision"),
    )


def alignment_order(keys: Sequence[str] = KEYS) -> list[Column]:
    """Report order: time, matched rows before unmatched ones, then index."""
    return [
        *[F.col(k) for k in keys],
        F.col("start_ms"),
        F.col("end_ms"),
        F.col("secondary_index").asc_nulls_last(),
        F.get("primary_indexes", F.lit(0)),
    ]


def alignment_summary(alignments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, risky rows and the exact median ratio per sample.

    Ratios have six places, so the median's value table is bounded by a million entries.
    """
    return alignments.groupBy(*keys).agg(
        F.count("*").alias("alignment_count"),
        F.count_if("high_risk").alias("high_risk_count"),
        F.coalesce(F.percentile("similarity_ratio", 0.5), F.lit(0.0)).alias("median_similarity_ratio"),
    )
