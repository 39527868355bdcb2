"""Flag unusual rows by quartile range, standard score and isolation forest; rank and page them.

Bounds are a handful of numbers per field, found by two or three aggregates. They enter the row
pass as literals, so flags, votes and signals are one codegen projection over the table.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import constants as K
from plumbline.functions.names import is_identifier
from plumbline.functions.scalars import (
    cancellation_marker,
    finite_or_null,
    is_finite,
    quoted,
    to_number,
)
from plumbline.operators.forest import RAW_SCORE, Forest, ForestGate, fit_forest, forest_gate
from plumbline.operators.quantiles import exact_quantiles, quantile_sketch
from plumbline.sources.rows import ROW_NUMBER, data_columns, stored_by
from plumbline.sources.storage import store

METHODS = ("iqr", "z_score")
FOREST = "isolation_forest"
POSITION = "__position"
STATS_FIELDS_PER_PASS = 32
QUARTILES = [0.25, 0.75]


@dataclass(frozen=True)
class Bound:
    method: str
    field: str
    evaluated_rows: int | None = None
    lower: float | None = None
    upper: float | None = None
    reason: str | None = None

    @property
    def evaluated(self) -> bool:
        return self.reason is None

    @property
    def signal(self) -> str:
        return f"{self.method}:{self.field}"


@dataclass(frozen=True)
class FieldStats:
    rows: int
    low: float | None
    high: float | None
    mean: float | None
    deviation: float | None
    sketch: list[float] | None = None

    @property
    def varies(self) -> bool:
        return self.rows > 0 and self.low < self.high


def numeric_fields(df: DataFrame) -> list[str]:
    """Number columns that are not identifiers by name; booleans do not count as numbers."""
    return [
        name for name in data_columns(df)
        if isinstance(df.schema[name].dataType, T.NumericType) and not is_identifier(name)
    ]


def _number(name: str) -> Column:
    return finite_or_null(quoted(name).cast("double"))


def field_stats(df: DataFrame, fields: list[str]) -> dict[str, FieldStats]:
    """Counts, extremes, moments and a sketch of the finite values; one aggregate per 32 fields."""
    stats = {}
    for start in range(0, len(fields), STATS_FIELDS_PER_PASS):
        chunk = fields[start:start + STATS_FIELDS_PER_PASS]
        row = df.agg(*[
            F.struct(F.count(v), F.min(v), F.max(v), F.avg(v), F.stddev_pop(v), quantile_sketch(v, QUARTILES)).alias(str(i))
            for i, v in enumerate(map(_number, chunk))
        ]).first()
        stats.update({f: FieldStats(*row[str(i)]) for i, f in enumerate(chunk)})
    return stats


def _bound(method: str, name: str, stats: FieldStats, quartiles: list[float | None]) -> Bound:
    if stats.rows < 4 or not stats.varies:
        return Bound(method, name, reason=K.TOO_FEW_VALUES_REASON)
    if method == "iqr":
        spread = quartiles[1] - quartiles[0]
        if spread == 0:
            return Bound(method, name, reason=K.ZERO_IQR_REASON)
        lower = quartiles[0] - K.IQR_MULTIPLIER * spread
        upper = quartiles[1] + K.IQR_MULTIPLIER * spread
    else:
        if stats.deviation == 0 or not math.isfinite(stats.deviation):
            return Bound(method, name, reason=K.ZERO_DEVIATION_REASON)
        lower = stats.mean - K.Z_THRESHOLD * stats.deviation
        upper = stats.mean + K.Z_THRESHOLD * stats.deviation
    if not (math.isfinite(lower) and math.isfinite(upper)):
        return Bound(method, name, reason=K.NONFINITE_BOUNDS_REASON)
    return Bound(method, name, stats.rows, lower, upper)


def anomaly_bounds(df: DataFrame, stats: dict[str, FieldStats]) -> list[Bound]:
    """Bounds, or the reason there are none, per method and field."""
    usable = {f: s.rows for f, s in stats.items() if s.rows >= 4 and s.varies}
    quartiles = exact_quantiles(df, usable, QUARTILES, sketches={f: stats[f].sketch for f in usable})
    return [
        _bound(method, name, stats[name], quartiles.get(name, [None, None]))
        for method in METHODS for name in stats
    ]


@dataclass(frozen=True)
class Review:
    """A table with forest score, signals and votes per row, and what produced them."""

    source: DataFrame
    rows: DataFrame
    flagged: DataFrame
    bounds: list[Bound]
    fields: list[str]
    gate: ForestGate | None = None
    forest: Forest | None = None
    source_columns: list[str] = field(default_factory=list)
    _queue: list[DataFrame] = field(default_factory=list)

    @property
    def queue(self) -> DataFrame:
        """The flagged rows numbered once in review order (``position`` from 1); pages are ranges of it."""
        if not self._queue:
            self._queue.append(stored_by(self.flagged, review_order(), "queue", name=POSITION))
        return self._queue[0]

    @property
    def scored(self) -> DataFrame:
        """``rows``, read off the table that was stored with its scores: for what needs every row."""
        return flagged_rows(self.forest.scored, self.bounds, self.forest) if self.forest else self.rows

    def row(self, number: int) -> DataFrame:
        """One row by its number; no other is scored."""
        return flagged_rows(self.source.filter(F.col(ROW_NUMBER) == number), self.bounds, self.forest)

    @property
    def evaluated(self) -> bool:
        return self.forest is not None or any(b.evaluated for b in self.bounds)


def outside(df: DataFrame, bound: Bound) -> Column:
    """Strictly outside the bounds; missing and non-finite values never are."""
    value = quoted(bound.field).cast("double")
    hit = (value < bound.lower) | (value > bound.upper)
    if isinstance(df.schema[bound.field].dataType, (T.FloatType, T.DoubleType)):
        hit = hit & is_finite(value)
    return F.coalesce(hit, F.lit(False))


def review(df: DataFrame, with_forest: bool = True) -> Review:
    """Detect anomalies in a numbered table.

    Every row is scored in one pass without a join and stored with its score. With the forest the flagged
    rows, read off that table, are stored too: counts, pages and evidence then read those few rows.
    """
    fields = numeric_fields(df)
    stats = field_stats(df, fields)
    gate = forest = None
    with ThreadPoolExecutor(1) as pool:  # bounds and forest need the stats alone
        bounding = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: anomaly_bounds(df, stats)))
        if with_forest:
            gate = forest_gate(df, {f: (s.rows, s.varies) for f, s in stats.items()})
            forest = fit_forest(df, gate)
        bounds = bounding.result()
    rows = flagged_rows(df, bounds, forest)
    flagged = rows.filter(F.col("votes") > 0)
    if forest:
        flagged = store(flagged_rows(forest.scored, bounds, forest).filter(F.col("votes") > 0), "flagged")
    return Review(df, rows, flagged, bounds, fields, gate, forest, data_columns(df))


def flagged_rows(df: DataFrame, bounds: list[Bound], forest: Forest | None) -> DataFrame:
    """Rows with forest score, votes and signals, in one pass over them."""
    rows = df.withColumn("forest_score", forest.score(df) if forest else F.lit(None).cast("double")).drop(RAW_SCORE)
    flags = [(b.signal, outside(df, b)) for b in bounds if b.evaluated]
    if forest:
        flags.append((FOREST, F.coalesce(F.col("forest_score") < 0, F.lit(False))))
    # Votes are counted apart from the names, so that the filter on them stays in generated code.
    return rows.withColumns({
        "votes": reduce(lambda a, b: a + b, [hit.cast("bigint") for _, hit in flags], F.lit(0).cast("bigint")),
        "signals": F.array_compact(F.array(*[F.when(hit, name) for name, hit in flags]))
        if flags else F.array().cast("array<string>"),
    })


def bounds_table(df: DataFrame, bounds: list[Bound]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(b.method, b.field, "evaluated" if b.evaluated else "not_evaluated", b.reason,
          b.evaluated_rows, b.lower, b.upper) for b in bounds],
        "method string, field string, status string, reason string, evaluated_rows bigint, "
        "lower_bound double, upper_bound double",
    )


def method_counts(found: Review) -> DataFrame:
    """(ordinal, method, fields, status, reason, evaluated, flagged) and, for the forest, the rows its trees
    were grown from and its contamination: one aggregate over the flags."""
    entries = [
        (b.method, b.field, b.evaluated, b.reason, b.evaluated_rows, b.signal) for b in found.bounds
    ]
    if not found.fields:
        entries = [(method, "", False, K.NO_FIELDS_REASON, None, method) for method in METHODS]
    if found.gate is not None:
        ready = found.forest is not None
        entries.append((
            FOREST, ", ".join(found.forest.fields) if ready else "", ready,
            None if ready else K.FOREST_GATE_REASON,
            found.forest.evaluated_rows if ready else None, FOREST,
        ))
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(method).alias("method"), F.lit(name).alias("field"),
            F.lit("evaluated" if ok else "not_evaluated").alias("status"),
            F.lit(reason).cast("string").alias("reason"),
            F.lit(evaluated).cast("bigint").alias("evaluated_rows"),
            (F.col(f"n{i}") if ok else F.lit(None).cast("bigint")).alias("flagged_rows"),
            F.lit(found.forest.training_rows if ok and method == FOREST else None).cast("bigint").alias("training_rows"),
            F.lit(found.forest.contamination if ok and method == FOREST else None).cast("double").alias("contamination"),
        )
        for i, (method, name, ok, reason, evaluated, _) in enumerate(entries, 1)
    ])
    counted = found.flagged.agg(*[
        F.count_if(F.array_contains("signals", signal)).alias(f"n{i}")
        for i, (_, _, _, _, _, signal) in enumerate(entries, 1)
    ])
    return counted.select(F.inline(rows))


def method_status(counts: DataFrame) -> DataFrame:
    """A method counts as evaluated when any of its fields is."""
    return counts.groupBy("method").agg(
        F.when(F.bool_or(F.col("status") == "evaluated"), "evaluated")
        .otherwise("not_evaluated").alias("status")
    )


def review_order() -> list[Column]:
    """More signals first, then the more unusual forest score, then source order."""
    return [F.col("votes").desc(), F.coalesce("forest_score", F.lit(0.0)).asc(), F.col(ROW_NUMBER).asc()]


def anomaly_queue(found: Review) -> DataFrame:
    """All flagged rows in review order (a range-partitioned sort)."""
    return found.flagged.orderBy(*review_order())


def anomaly_page(found: Review, offset: int = 0, limit: int = K.DEFAULT_PAGE) -> DataFrame:
    """One page of the queue, with the offset of the next page or NULL.

    The queue is sorted, stored and numbered once a review; a page is a range of positions.
    """
    if offset < 0 or not 1 <= limit <= K.MAX_PAGE:
        raise ValueError(f"The offset must not be negative and the limit must be 1 to {K.MAX_PAGE}.")
    total = found.flagged.count()
    following = offset + limit if offset + limit < total else None
    inside = (F.col(POSITION) > offset) & (F.col(POSITION) <= offset + limit)
    page = found.queue.filter(inside).orderBy(POSITION).drop(POSITION)
    return page.withColumn("next_offset", F.lit(following).cast("bigint"))


def anomaly_summary(found: Review) -> DataFrame:
    """Rows and distinct flagged rows: the two counts folded into one row, without a join."""
    counted = found.source.agg(F.count("*").alias("rows_count")).unionByName(
        found.flagged.agg(F.count("*").alias("anomaly_rows_count")), allowMissingColumns=True
    )
    return counted.agg(
        F.max("rows_count").alias("rows_count"), F.max("anomaly_rows_count").alias("anomaly_rows_count")
    ).select(
        F.lit("evaluated" if found.evaluated else "not_evaluated").alias("status"),
        "rows_count",
        (F.col("anomaly_rows_count") if found.evaluated else F.lit(None).cast("bigint"))
        .alias("anomaly_rows_count"),
        F.lit(K.ANOMALY_MESSAGE).alias("message"),
    )


def retail_context(found: Review) -> DataFrame | None:
    """Flagged negative quantities with and without a cancellation marker, where both headers exist."""
    if not {K.INVOICE_HEADER, K.QUANTITY_HEADER} <= set(found.source_columns) or not found.evaluated:
        return None
    negative = F.coalesce(to_number(found.flagged, K.QUANTITY_HEADER) < 0, F.lit(False))
    marked = cancellation_marker(quoted(K.INVOICE_HEADER))
    return found.flagged.agg(
        F.count_if(negative & marked).alias("flagged_negative_quantity_with_cancellation"),
        F.count_if(negative & ~marked).alias("flagged_negative_quantity_without_cancellation"),
    )
