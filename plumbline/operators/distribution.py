"""Bounded summaries of one column: discrete counts, histograms, date buckets, categories."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as K
from plumbline.functions.scalars import INFINITY, finite_or_null, quoted, six_digits
from plumbline.operators.profile import as_date, logical_types, present, value_text
from plumbline.operators.frequent import top_counts
from plumbline.operators.quantiles import quantile_sketch, quantiles_and_neighbours
from plumbline.sources.rows import ROW_NUMBER
from plumbline.sources.storage import pin

CENTRAL = [0.01, 0.99]  # quantiles that bound the typical range
EVEN = [i / 16 for i in range(1, 16)]  # further ranks whose values tell whether there are many


def require_column(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"Column {column!r} is not in the table.")


def _value(column: str) -> Column:
    return quoted(column).cast("double")


def numeric_usability(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, missing, usable, infinite) of numeric columns, one aggregate."""
    for column in columns:
        require_column(df, column)
    counted = df.agg(
        F.count("*").alias("rows_count"),
        *[F.count_if(present(df, c)).alias(f"p{i}") for i, c in enumerate(columns)],
        *[F.count(finite_or_null(_value(c))).alias(f"f{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.abs(_value(c)) == F.lit(INFINITY)).alias(f"i{i}") for i, c in enumerate(columns)],
    )
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows_count"),
            (F.col("rows_count") - F.col(f"p{i}")).alias("missing_count"),
            F.col(f"f{i}").alias("usable_count"),
            F.col(f"i{i}").alias("excluded_nonfinite_count"),
        )
        for i, c in enumerate(columns)
    ])))


@dataclass(frozen=True)
class NumericFacts:
    """The finite values of a column: how many, the extremes, and values that stand in it at even ranks."""

    rows: int
    low: float | None
    high: float | None
    sketch: list[float]


def numeric_facts(df: DataFrame, column: str) -> NumericFacts:
    """One aggregate. The sketched values are real ones, so many different ones prove many values."""
    require_column(df, column)
    value = finite_or_null(_value(column))
    row = df.agg(F.count(value), F.min(value), F.max(value), quantile_sketch(value, CENTRAL + EVEN)).first()
    return NumericFacts(row[0], row[1], row[2], row[3] or [])


def is_discrete(df: DataFrame, column: str, facts: NumericFacts | None = None) -> bool:
    """At least 20 finite values and at most 12 distinct ones, over the whole column.

    A sketch with more than 12 different values settles it without another scan. Else values are
    counted with partial sums; one count more than 12 is enough.
    """
    facts = facts or numeric_facts(df, column)
    if facts.rows < K.MIN_DISCRETE_ROWS or len(set(facts.sketch)) > K.MAX_DISCRETE_VALUES:
        return False
    values = df.select(finite_or_null(_value(column)).alias("value")).dropna()
    return len(values.distinct().limit(K.MAX_DISCRETE_VALUES + 1).collect()) <= K.MAX_DISCRETE_VALUES


def discrete_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, label, count) in value order."""
    return (
        df.select(finite_or_null(_value(column)).alias("value")).dropna()
        .groupBy("value").agg(F.count("*").alias("value_count"))
        .withColumn("label", six_digits(F.col("value")))
        .orderBy("value")
    )


def _edges(low: float, high: float) -> list[float]:
    step = (high - low) / K.HISTOGRAM_BINS
    return [i * step + low for i in range(K.HISTOGRAM_BINS)] + [high]


@dataclass(frozen=True)
class Bins:
    """A closed range of values in 24 equal bins, the last one closed, or in one bin if it is a point.

    Values are scaled by the largest magnitude first, so that the range of extreme doubles stays finite.
    """

    low: float
    high: float

    @property
    def scale(self) -> float:
        return max(abs(self.low), abs(self.high))

    def edges(self) -> list[tuple[float, float]]:
        if self.low == self.high:
            width = max(abs(self.low) * 0.01, 0.5)
            return [(self.low - width, self.low) if self.low > 0 else (self.low, self.low + width)]
        edges = [e * self.scale for e in _edges(self.low / self.scale, self.high / self.scale)]
        return list(zip(edges, edges[1:]))

    def guess(self, value: Column) -> Column:
        """The bin of a value from 0, by arithmetic; NULL outside the range."""
        inside = value.between(self.low, self.high)
        if self.low == self.high:
            return F.when(inside, F.lit(0))
        first, last = F.lit(self.low / self.scale), F.lit(self.high / self.scale)
        place = F.floor((value / F.lit(self.scale) - first) / (last - first) * K.HISTOGRAM_BINS)
        return F.when(inside, F.least(place, F.lit(K.HISTOGRAM_BINS - 1)).cast("int"))

    def bin(self, value: Column, guess: Column) -> Column:
        """The bin from 1. Rounding may put a value that sits on an edge into the neighbouring bin: the
        edge itself is asked."""
        if self.low == self.high:
            return guess + 1
        table = F.array(*[F.lit(e) for e in _edges(self.low / self.scale, self.high / self.scale)])
        scaled = value / F.lit(self.scale)
        return (
            F.when(scaled < F.get(table, guess), guess)
            .when((scaled >= F.get(table, guess + 1)) & (guess < K.HISTOGRAM_BINS - 1), guess + 2)
            .otherwise(guess + 1)
        )


def histograms(df: DataFrame, column: str, ranges: list[Bins]) -> list[DataFrame]:
    """(bin, lower edge, upper edge, count) of the finite values in each range, all from one pass.

    The counters, a few dozen, are summed in every task and collected.
    """
    value = finite_or_null(_value(column))
    guessed = df.select(value.alias("value")).dropna().select(
        "value", *[r.guess(F.col("value")).alias(f"g{i}") for i, r in enumerate(ranges)]
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("range"), r.bin(F.col("value"), F.col(f"g{i}")).alias("bin")) for i, r in enumerate(ranges)
    ])
    placed = guessed.select(F.inline(cells)).filter(F.col("bin").isNotNull())
    counts = {(r["range"], r["bin"]): r["count"] for r in placed.groupBy("range", "bin").count().collect()}
    schema = "bin bigint, lower_edge double, upper_edge double, value_count bigint"
    return [
        df.sparkSession.createDataFrame([(b, *edge, counts.get((i, b), 0)) for b, edge in enumerate(r.edges(), 1)], schema)
        for i, r in enumerate(ranges)
    ]


def histogram(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return histograms(df, column, [Bins(low, high)])[0]


def _some(df: DataFrame, column: str, facts: NumericFacts | None) -> NumericFacts:
    facts = facts or numeric_facts(df, column)
    if not facts.rows:
        raise ValueError(K.NO_FINITE_REASON)
    return facts


def full_histogram(df: DataFrame, column: str, facts: NumericFacts | None = None) -> DataFrame:
    facts = _some(df, column, facts)
    return histogram(df, column, facts.low, facts.high)


@dataclass(frozen=True)
class Central:
    """The values between the 1 % and 99 % quantiles, both included: their extremes and number."""

    low: float
    high: float
    rows: int


def central_range(df: DataFrame, column: str, facts: NumericFacts) -> Central:
    """Quantiles are those of the values over their largest magnitude, so that no difference overflows.
    The values next to each quantile and their counts come with it, so the range needs no scan of its
    own unless scaling has rounded a quantile past them."""
    scale = max(abs(facts.low), abs(facts.high))
    if not scale:
        return Central(0.0, 0.0, facts.rows)
    sketches = {column: facts.sketch} if facts.sketch else None
    _, around = quantiles_and_neighbours(df, {column: facts.rows}, CENTRAL, sketches=sketches, shares_of=CENTRAL + EVEN)

    def quantile(p: float, low: float, high: float) -> float:
        share = p * (facts.rows - 1) - math.floor(p * (facts.rows - 1))
        low, high = low / scale, high / scale
        return (low if not share or low == high else low + (high - low) * share) * scale

    low, high, below, on_low, _ = around[column][0]
    bottom = quantile(CENTRAL[0], low, high)
    first = (low, below) if low >= bottom else (high, below + on_low) if high >= bottom else None
    low, high, below, on_low, on_high = around[column][1]
    top = quantile(CENTRAL[1], low, high)
    through = below + on_low + (on_high if high != low else 0)
    last = (high, through) if high <= top else (low, below + on_low) if low <= top else None
    if first and last and first[0] <= last[0]:
        return Central(first[0], last[0], last[1] - first[1])
    value = finite_or_null(_value(column))
    inner = F.when(value.between(bottom, top), value)
    return Central(*df.agg(F.min(inner), F.max(inner), F.count(inner)).first())


def _with_extremes(bins: DataFrame, facts: NumericFacts, central: Central) -> DataFrame:
    return bins.select(
        "*", F.lit(facts.rows - central.rows).cast("bigint").alias("outside_central_count"),
        F.lit(facts.low).alias("minimum"), F.lit(facts.high).alias("maximum"),
    )


def central_histogram(df: DataFrame, column: str, facts: NumericFacts | None = None) -> DataFrame:
    """Histogram of the values between the 1 % and 99 % quantiles, both included, with the number
    of values outside and the extremes of the whole column."""
    facts = _some(df, column, facts)
    central = central_range(df, column, facts)
    return _with_extremes(histogram(df, column, central.low, central.high), facts, central)


def both_histograms(df: DataFrame, column: str, facts: NumericFacts | None = None) -> DataFrame:
    """The full and the central histogram, told apart by ``range``: both are counted in one pass, so the
    column is scanned three times in all, for its facts, its quantiles and its bins."""
    facts = _some(df, column, facts)
    central = central_range(df, column, facts)
    full, inner = histograms(df, column, [Bins(facts.low, facts.high), Bins(central.low, central.high)])
    parts = full.withColumn("range", F.lit("full")), _with_extremes(inner, facts, central).withColumn("range", F.lit("central"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def time_buckets(df: DataFrame, column: str) -> DataFrame:
    """(unit, period, count, usable, invalid) by month, or by year over more than three years.

    Empty periods are kept. The number of periods is bounded by the calendar.
    """
    require_column(df, column)
    moment = as_date(df, column)
    facts = df.select(moment.alias("moment"), quoted(column).isNotNull().alias("filled")).agg(
        F.count("moment").alias("usable"), F.count_if("filled").alias("filled"),
        F.min("moment").alias("first"), F.max("moment").alias("last"),
    ).first()
    if not facts["usable"]:
        raise ValueError(K.NO_DATES_REASON)
    unit = "year" if facts["last"].year - facts["first"].year > K.YEAR_BUCKET_SPAN else "month"
    counted = (
        df.select(F.trunc(moment.cast("date"), unit).alias("start")).dropna()
        .groupBy("start").agg(F.count("*").alias("value_count"))
    )
    first, last = (F.trunc(F.lit(facts[k].date()), unit) for k in ("first", "last"))
    periods = df.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr(f"interval 1 {unit}"))).alias("start")
    )
    return periods.join(counted, "start", "left").select(
        F.lit(unit).alias("time_unit"),
        F.date_format("start", "yyyy" if unit == "year" else "yyyy-MM").alias("period"),
        F.coalesce("value_count", F.lit(0)).alias("value_count"),
        F.lit(facts["usable"]).cast("bigint").alias("usable_count"),
        F.lit(facts["filled"] - facts["usable"]).cast("bigint").alias("invalid_date_count"),
    )


def category_top_other(df: DataFrame, column: str, top: int = K.TOP_CATEGORIES) -> DataFrame:
    """(position, value, count): the most common values and one "Other" row for the rest.

    The top comes from candidates (see ``frequent``), so rare values are neither shuffled nor ranked,
    and the remainder is a subtraction. It has position 0.
    """
    require_column(df, column)
    leading = pin(top_counts(df, {1: value_text(df, column)}, top).select("position", "value", "value_count"))
    filled = df.agg(F.count_if(present(df, column)).alias("signed"))
    other = (
        filled.unionAll(leading.agg(-F.sum("value_count")))
        .agg(F.sum("signed").alias("value_count"))
        .filter(F.col("value_count") > 0)
        .select(F.lit(0).cast("bigint").alias("position"), F.lit("Other").alias("value"), "value_count")
    )
    return leading.unionByName(other)


def category_share(df: DataFrame, column: str) -> DataFrame:
    """Share of each group, given only when there are at most six of them."""
    groups = category_top_other(df, column)
    whole = Window.partitionBy()  # over at most thirteen rows
    return (
        groups.withColumn("groups", F.count("*").over(whole))
        .withColumn("share", F.round(100.0 * F.col("value_count") / F.sum("value_count").over(whole), 4))
        .filter(F.col("groups") <= K.SHARE_MAX_GROUPS)
        .select("value", "value_count", "share")
    )


def column_type(df: DataFrame, column: str) -> str:
    """Logical type of one column; only that column is read."""
    require_column(df, column)
    keep = [ROW_NUMBER] if ROW_NUMBER in df.columns and column != ROW_NUMBER else []
    return logical_types(df.select(*keep, quoted(column)))[column]


def distribution_kind(
    df: DataFrame, column: str, logical_type: str | None = None, facts: NumericFacts | None = None
) -> str | None:
    """discrete, histogram, time or category; None where the column is not summarised."""
    kind = logical_type or column_type(df, column)
    if kind == "numeric":
        return "discrete" if is_discrete(df, column, facts) else "histogram"
    return {"datetime": "time", "categorical": "category"}.get(kind)


def distribution_status(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(column, type, usable, status, reason): what can be charted, for every column at once."""
    usable = {
        name: F.count(finite_or_null(_value(name))) if kind == "numeric"
        else F.count(as_date(df, name)) if kind == "datetime"
        else F.count(quoted(name))
        for name, kind in types.items()
    }
    empty = {"numeric": K.NO_FINITE_REASON, "datetime": K.NO_DATES_REASON,
             "categorical": K.NO_CATEGORIES_REASON}
    counted = df.agg(*[count.alias(f"u{i}") for i, count in enumerate(usable.values())])
    return counted.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("logical_type"),
            F.col(f"u{i}").alias("usable_count"),
            F.when(F.lit(kind in empty) & (F.col(f"u{i}") > 0), "evaluated")
            .otherwise("not_evaluated").alias("status"),
            F.when(F.lit(kind not in empty), K.NOT_SUMMARIZED_REASON)
            .when(F.col(f"u{i}") == 0, empty.get(kind)).alias("reason"),
        )
        for i, (name, kind) in enumerate(types.items())
    ])))


def summarize_column(df: DataFrame, column: str) -> tuple[str | None, DataFrame | None]:
    """The distribution that fits the column, or (None, None) with its status elsewhere."""
    logical = column_type(df, column)
    facts = numeric_facts(df, column) if logical == "numeric" else None
    kind = distribution_kind(df, column, logical, facts)
    if kind == "discrete":
        return kind, discrete_counts(df, column)
    if kind == "histogram":
        return kind, both_histograms(df, column, facts)
    if kind == "time":
        return kind, time_buckets(df, column)
    if kind == "category":
        return kind, category_top_other(df, column)
    return None, None


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def missing_ranking(missing: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with missing cells, most first, with a band; all of them unless a limit is given."""
    percent = F.col("missing_percentage")
    return (
        _first(missing.filter(F.col("missing_count") > 0).orderBy(F.col("missing_count").desc(), "ordinal"), limit)
        .select(
            "column_name", "missing_count", "missing_percentage",
            F.when(percent >= K.HIGH_SEVERITY_PERCENT, "high")
            .when(percent >= K.MEDIUM_SEVERITY_PERCENT, "medium").otherwise("low").alias("band"),
        )
    )


def signal_ranking(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """Evaluated method and field pairs with flags, most first; all of them unless a limit is given."""
    flagged = counts.filter((F.col("status") == "evaluated") & (F.col("flagged_rows") > 0))
    ranked = _first(flagged.orderBy(F.col("flagged_rows").desc(), "ordinal"), limit)
    return ranked.select("method", "field", "flagged_rows")
