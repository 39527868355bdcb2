"""Exact, linearly interpolated quantiles of many columns at any size, in two or three scans.

A sketch, made inside whatever aggregate the caller runs first, proposes two values around each wanted
rank. One pass for all columns then counts exactly what lies below, on and between these values, and
brings along the few values between them. Where those would be too many, the pass sketches them
instead, and the next one looks closer. The sketch only steers: results rest on exact counts, hot
values are counted and never listed, and one formula interpolates at every size.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalars import finite_or_null, quoted

GATHER_ROWS = 4_000  # values listed for one rank
SKETCH_ACCURACY = 5_000
GRID = 128  # parts in which a later sketch divides an interval
GRID_SHARES = [i / GRID for i in range(1, GRID)]
COLUMNS_PER_PASS = 64
SPREAD = 3.0 / SKETCH_ACCURACY  # share of the rows by which a sketched value may miss its rank, with room to spare


def ranked(name: str, infinite: bool = False) -> Column:
    """The finite values of a column as doubles; with ``infinite`` all but NaN."""
    value = quoted(name).cast("double")
    return F.when(~F.isnan(value), value) if infinite else finite_or_null(value)


def sketch_shares(probabilities: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.0, p + side)) for p in probabilities for side in (-SPREAD, SPREAD)})


def quantile_sketch(value: Column, probabilities: list[float]) -> Column:
    """An aggregate for the caller's first pass: values around the wanted quantiles."""
    return F.percentile_approx(value, sketch_shares(probabilities), SKETCH_ACCURACY)


@dataclass
class _Gap:
    """An open interval known to hold a rank: its ends, the rows up to its low end, the rows inside."""

    low: float | None
    high: float | None
    below: int
    inside: int
    pivots: list[float] | None = None  # sketched values inside, evenly spread


def exact_quantiles(
    df: DataFrame,
    counts: dict[str, int],
    probabilities: list[float],
    gather_rows: int = GATHER_ROWS,
    infinite: bool = False,
    sketches: dict[str, list[float]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of the finite values per column; ``counts`` holds their exact numbers. With
    ``infinite`` infinities are ranked and counted too, and a quantile may be infinite or NaN.
    ``sketches`` holds what ``quantile_sketch`` found; columns without one are sketched first."""
    found, _ = quantiles_and_neighbours(df, counts, probabilities, gather_rows, infinite, sketches)
    return found


def quantiles_and_neighbours(
    df: DataFrame,
    counts: dict[str, int],
    probabilities: list[float],
    gather_rows: int = GATHER_ROWS,
    infinite: bool = False,
    sketches: dict[str, list[float]] | None = None,
    shares_of: list[float] | None = None,
) -> tuple[dict[str, list[float | None]], dict[str, list[tuple]]]:
    """The quantiles, and for each of them the two values it lies between with the exact number of rows
    below the first, on the first and on the second. ``shares_of`` are the quantiles that the sketches
    were made for, if not these."""
    found = {c: [None] * len(probabilities) for c, rows in counts.items() if not rows}
    around = {c: [None] * len(probabilities) for c in found}
    filled = [c for c, rows in counts.items() if rows]
    values = df.select(*[ranked(c, infinite).alias(c) for c in filled])
    for start in range(0, len(filled), COLUMNS_PER_PASS):
        chunk = {c: counts[c] for c in filled[start:start + COLUMNS_PER_PASS]}
        picked = _ranks(values, chunk, probabilities, gather_rows, sketches or {}, shares_of or probabilities)
        for column, rows in chunk.items():
            found[column], around[column] = [], []
            for p in probabilities:
                position = p * (rows - 1)
                share = position - math.floor(position)
                low, high = picked[column, math.floor(position)], picked[column, math.ceil(position)]
                same = not share or low[0] == high[0]
                found[column].append(low[0] if same else low[0] + (high[0] - low[0]) * share)
                around[column].append((low[0], high[0], low[1], low[2], high[2]))
    return found, around


def _ranks(
    values: DataFrame, counts: dict, probabilities: list[float], gather_rows: int, sketches: dict, shares_of: list[float]
) -> dict:
    """{(column, rank): (value, rows below it, rows on it)}."""
    open_ranks: dict[tuple[str, int], _Gap] = {}
    for column, rows in counts.items():
        for p in probabilities:
            for rank in (math.floor(p * (rows - 1)), math.ceil(p * (rows - 1))):
                open_ranks[column, rank] = _Gap(None, None, 0, rows)
    wide = [c for c, rows in counts.items() if rows > gather_rows and c not in sketches]
    if wide:
        row = values.agg(*[quantile_sketch(quoted(c), shares_of).alias(str(i)) for i, c in enumerate(wide)]).first()
        sketches = {**sketches, **{c: row[str(i)] for i, c in enumerate(wide)}}
    first = {c: sketches[c] for c, rows in counts.items() if rows > gather_rows}
    picked: dict[tuple[str, int], tuple] = {}
    while open_ranks:
        plan = _plan(open_ranks, first, sketch_shares(shares_of), gather_rows)
        first = {}
        rows = _pass(values, plan)
        for (column, rank), _ in list(open_ranks.items()):
            answer = _locate(rank, plan[column], rows[column])
            if isinstance(answer, _Gap):
                open_ranks[column, rank] = answer
            else:
                picked[column, rank] = answer
                del open_ranks[column, rank]
    return picked


@dataclass
class _Cuts:
    """How a pass looks at a column: cut values, and of the gaps between them those it lists or sketches."""

    values: list[float]
    listed: set[int]
    sketched: set[int]


def _plan(open_ranks: dict, first: dict, shares: list[float], gather_rows: int) -> dict[str, _Cuts]:
    wanted: dict[str, list[tuple[float | None, float | None, float]]] = {}
    cuts: dict[str, set[float]] = {}
    for (column, rank), gap in open_ranks.items():
        own = cuts.setdefault(column, set())
        own.update(v for v in (gap.low, gap.high) if v is not None)
        low, high, expected = gap.low, gap.high, float(gap.inside)
        if gap.inside > gather_rows:
            if column in first:
                low, high, expected = _narrowed(rank, gap, first[column], shares, SPREAD / 2)
            elif gap.pivots:
                low, high, expected = _narrowed(rank, gap, gap.pivots, GRID_SHARES, 1 / GRID)
            own.update(v for v in (low, high) if v is not None)
        wanted.setdefault(column, []).append((low, high, expected))
    plan = {}
    for column, spans in wanted.items():
        values = sorted(cuts[column])
        listed, sketched = set(), set()
        for low, high, expected in spans:
            gaps = range(0 if low is None else bisect_left(values, low) + 1, len(values) + 1 if high is None else bisect_left(values, high) + 1)
            (listed if expected <= gather_rows else sketched).update(gaps)
        plan[column] = _Cuts(values, listed - sketched, sketched)
    return plan


def _narrowed(rank: int, gap: _Gap, pivots: list[float], shares: list[float], margin: float) -> tuple[float | None, float | None, float]:
    """The part of a gap in which a rank should be, by the sketched values at ``shares`` of it, and the
    rows to expect there."""
    share = (rank - gap.below + 0.5) / gap.inside
    low, high = bisect_right(shares, share - margin) - 1, bisect_left(shares, share + margin)
    expected = (shares[high] if high < len(shares) else 1.0) - (shares[low] if low >= 0 else 0.0) + margin
    return pivots[low] if low >= 0 else gap.low, pivots[high] if high < len(pivots) else gap.high, gap.inside * expected


def _pass(values: DataFrame, plan: dict[str, _Cuts]) -> dict[str, tuple[dict, dict, dict]]:
    """For each column: rows by slot, listed (value, rows) by slot, sketched values by slot.

    Slot 2 j is the gap below cut j, slot 2 j + 1 the cut itself. Rows are grouped by slot, and where
    a gap is listed by value too, with partial sums in every task.
    """
    cells, listed, sketched, owner, start = [], [], [], [], 0
    for column, cuts in plan.items():
        value, slot = quoted(column), F
        for j, cut in enumerate(cuts.values):
            slot = slot.when(value < cut, start + 2 * j).when(value == cut, start + 2 * j + 1)
        last = start + 2 * len(cuts.values)
        place = slot.when(value.isNotNull(), last) if cuts.values else F.when(value.isNotNull(), last)
        cells.append(F.struct(place.cast("int").alias("slot"), value.alias("value")))
        listed += [start + 2 * j for j in cuts.listed]
        sketched += [start + 2 * j for j in cuts.sketched]
        owner += [(column, s) for s in range(2 * len(cuts.values) + 1)]
        start = last + 1
    rows = values.select(F.inline(F.array(*cells))).filter(F.col("slot").isNotNull())
    shown = F.when(F.col("slot").isin(listed), F.col("value")) if listed else F.lit(None).cast("double")
    measures = [F.count("*").alias("n")]
    if sketched:
        inner = F.when(F.col("slot").isin(sketched), F.col("value"))
        measures.append(F.percentile_approx(inner, GRID_SHARES, 20 * GRID).alias("pivots"))
    table = rows.groupBy("slot", shown.alias("shown")).agg(*measures).toArrow()
    result = {column: ({}, {}, {}) for column in plan}
    slots, counts = table.column("slot").to_numpy(), table.column("n").to_numpy()
    shown_values = table.column("shown").to_numpy(zero_copy_only=False)
    pivots = table.column("pivots").to_pylist() if sketched else [None] * len(slots)
    is_listed = np.isin(slots, listed)
    for i, (s, n) in enumerate(zip(slots.tolist(), counts.tolist())):
        column, own = owner[s]
        by_slot, lists, sketches = result[column]
        by_slot[own] = by_slot.get(own, 0) + n
        if is_listed[i]:
            lists.setdefault(own, []).append((float(shown_values[i]), n))
        if pivots[i]:
            sketches[own] = pivots[i]
    return result


def _locate(rank: int, cuts: _Cuts, found: tuple[dict, dict, dict]) -> tuple | _Gap:
    """The value of a rank with the rows below and on it, or the gap that holds it."""
    by_slot, lists, sketches = found
    below = 0
    for slot in range(2 * len(cuts.values) + 1):
        rows = by_slot.get(slot, 0)
        if rank < below + rows:
            break
        below += rows
    if slot % 2:
        return cuts.values[slot // 2], below, rows
    if slot in lists:
        for value, n in sorted(lists[slot]):
            if rank < below + n:
                return value, below, n
            below += n
    place = slot // 2
    low, high = cuts.values[place - 1] if place else None, cuts.values[place] if place < len(cuts.values) else None
    return _Gap(low, high, below, rows, sketches.get(slot))
