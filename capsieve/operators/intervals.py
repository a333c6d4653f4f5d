"""Interval join by a dyadic index.

Time is cut into cells of one width, and 2^k neighbouring cells form a cell of level k. An interval is stored under the
dyadic cells that partition it, at most two a level, so under some 2 log2(length / width) rows however long it is. Two
intervals overlap just when the start of the one that starts later lies in the other. So each start is looked up in the
cells of the other side that may hold it, one for each level that the other side uses under the same key, and each
overlapping pair is met exactly once: no duplicate removal, no row count that grows with a length.

Intervals of a few cells, as most segments are, are stored under those cells of level 0 instead. Starts are always looked
up there, so the levels in use have to be known only where longer intervals exist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.session import materialize

WIDTH_MS = 5_000
NEAR = 4  # cells


def floor_div(name: str, width: int) -> str:
    return f"(({name} - pmod({name}, {width}L)) div {width}L)"


def cover(width: int, start: str = "start", end: str = "end") -> Column:
    """Dyadic cells (``level``, ``cell``) that partition the cells of ``start`` to ``end`` (exclusive); exact for all longs."""
    low, high = floor_div(start, width), f"({floor_div(f'({end} - 1)', width)} + 1)"
    first, last = f"(-shiftright(-{low}, k))", f"shiftright({high}, k)"
    cell = lambda at: f"named_struct('level', k, 'cell', {at})"
    odd = lambda x: f"{first} < {last} AND ({x}) & 1 = 1"
    both = f"array_compact(array(CASE WHEN {odd(first)} THEN {cell(first)} END, CASE WHEN {odd(last)} THEN {cell(f'{last} - 1')} END))"
    levels = f"sequence(0, CAST(floor(log2({high} - {low})) AS INT) + 1)"
    return F.expr(f"CASE WHEN {end} > {start} THEN flatten(transform({levels}, k -> {both})) END")


def ancestors(width: int, levels: str, start: str = "start") -> Column:
    """The cells that hold ``start``, at each level that the array ``levels`` names."""
    return F.expr(f"transform({levels}, k -> named_struct('level', k, 'cell', shiftright({floor_div(start, width)}, k)))")


def _stored(rows: DataFrame, keys: Sequence[str], start: str, end: str, width: int, side: str) -> DataFrame:
    """The rows under names of their side, keys as ``l_k``, other columns as ``l__c``, with their first and last cell."""
    named = rows.select(
        *[F.col(k).alias(f"{side}_{k}") for k in keys], *[F.col(c).alias(f"{side}__{c}") for c in rows.columns if c not in keys]
    )
    at, to = (f"CAST(`{side}__{c}` AS BIGINT)" for c in (start, end))
    return named.where(f"{to} > {at}").withColumns(
        {"_first": F.expr(floor_div(at, width)), "_last": F.expr(floor_div(f"({to} - 1)", width))}
    )


def _far_levels(far: dict[str, DataFrame], keys: Sequence[str], cells: dict[str, Column]) -> DataFrame:
    """``of, keys, levels``: the levels above 0 that the far intervals of a side use under a key; written out, as it's small."""
    used = lambda of: F.aggregate(cells[of], F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c["level"])))
    one = {
        of: rows.select(F.lit(of).alias("of"), *[F.col(f"{of}_{k}").alias(k) for k in keys], used(of).alias("bits")) for of, rows in far.items()
    }
    bits = one["l"].unionByName(one["r"]).groupBy("of", *keys).agg(F.bit_or("bits").alias("bits"))
    return materialize(bits.select("of", *keys, F.expr("filter(sequence(1, 62), k -> shiftright(bits, k) & 1 = 1)").alias("levels")))


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", width: int = WIDTH_MS
) -> DataFrame:
    """Pairs of rows with equal keys whose intervals [start, end) share time: the structs ``l`` and ``r``, and ``keys``.

    Rows with a null key or border, or an end that isn't after the start, have no pair. Intervals may have any length
    and sign that a long holds. Intervals of up to ``NEAR`` cells are stored under these, and each start is looked up
    among them, by plain arithmetic; only where longer ones exist, after a look at the intervals, the index comes in.
    """
    places = ("of", "level", "cell")
    sides = {side: _stored(rows, keys, start, end, width, side) for side, rows in (("l", left), ("r", right))}
    spread = F.col("_last") - F.col("_first")
    far = {side: rows.where(spread >= NEAR) for side, rows in sides.items()}
    border = lambda side, c: f"CAST(`{side}__{c}` AS BIGINT)"
    cells = {side: cover(width, border(side, start), border(side, end)) for side in sides}
    levels = _far_levels(far, keys, cells)
    some = not levels.isEmpty()
    rows = {}
    for side, other in (("l", "r"), ("r", "l")):
        place = lambda of, level, cell: F.struct(F.lit(of).alias("of"), level.alias("level"), cell.alias("cell"))
        put = lambda df, at: df.select("*", F.inline(at).alias(*places)).drop("_first", "_last", "levels")
        own = [F.when((spread < NEAR) & (spread >= i), F.col("_first") + i) for i in range(NEAR)]
        near = F.array(*[place(of, F.lit(0), cell) for of, cell in (*[(side, c) for c in own], (other, F.col("_first")))])
        parts = [put(sides[side], near).where("cell IS NOT NULL")]
        if some:
            tagged = lambda found, of: F.transform(found, lambda c: place(of, c["level"], c["cell"]))
            known = levels.where(F.col("of") == other).select(*[F.col(k).alias(f"{side}_{k}") for k in keys], "levels")
            looked = sides[side].join(known, [f"{side}_{k}" for k in keys])
            parts += [put(far[side], tagged(cells[side], side)), put(looked, tagged(ancestors(width, "levels", border(side, start)), other))]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        # One number for the place comes first, so that rows are sorted by it and not by the keys.
        place_no = F.xxhash64(*[f"{side}_{k}" for k in keys], *places).alias(f"{side}_place")
        rows[side] = whole.select(place_no, *[c for c in whole.columns if c not in places], *[F.col(c).alias(f"{side}_{c}") for c in places])
    met = F.lit(True)
    for c in ["place", *keys, *places]:
        met &= F.col(f"l_{c}") == F.col(f"r_{c}")
    at = {c: F.expr(border(*c)) for c in ((side, name) for side in "lr" for name in (start, end))}
    shared = F.least(at["l", end], at["r", end]) > F.greatest(at["l", start], at["r", start])
    # A start is looked up where the other side's interval is stored: the left one's if it is the later, or both are equal.
    later = F.when(F.col("l_of") == "r", at["l", start] >= at["r", start]).otherwise(at["r", start] > at["l", start])
    # The structs are made of the pairs, so that columns nobody asks for aren't carried to them.
    held = lambda side, df: F.struct(*[F.col(f"{side}_{c}" if c in keys else f"{side}__{c}").alias(c) for c in df.columns]).alias(side)
    pairs = rows["l"].join(rows["r"], met & shared & later)
    return pairs.select(*[F.col(f"l_{k}").alias(k) for k in keys], held("l", left), held("r", right))
