"""Profile a table: counts, distinct values, samples, logical types, summaries.

Per-column results for any schema come from long (ordinal, value) frames, never from one job per
column, and values are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.constants import (
    CATEGORY_MAX_DISTINCT,
    CATEGORY_MAX_SHARE,
    DATE_PROBE_SHARE,
    SAMPLE_VALUES,
    TOP_VALUES,
)
from plumbline.functions.names import is_identifier
from plumbline.functions.scalars import finite_or_null, iso_text, parse_date, quoted
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.frequent import top_counts
from plumbline.operators.quantiles import exact_quantiles, quantile_sketch
from plumbline.operators.uniqueness import duplicate_count
from plumbline.sources.rows import ROW_NUMBER, data_columns
from plumbline.sources.storage import pin


QUARTILES = [0.25, 0.5, 0.75]


def round_half_up(value: float, places: int) -> Decimal:
    return Decimal(repr(value)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def value_text(df: DataFrame, name: str) -> Column:
    """A cell as report text: ISO timestamps, no text for missing or NaN."""
    kind = df.schema[name].dataType
    value = quoted(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso_text(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value).cast("string")
    return value.cast("string")


def present(df: DataFrame, name: str) -> Column:
    value = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def column_missing(df: DataFrame) -> DataFrame:
    """(ordinal, column, type, rows, missing, percentage), one scan and one aggregate."""
    names = data_columns(df)
    counted = df.agg(
        F.count("*").alias("rows_count"),
        *[F.count_if(present(df, name)).alias(f"c{i}") for i, name in enumerate(names)],
    )
    facts = F.array(*[
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(name).alias("column_name"),
            F.lit(df.schema[name].dataType.simpleString()).alias("data_type"),
            F.col("rows_count"),
            (F.col("rows_count") - F.col(f"c{i}")).alias("missing_count"),
        )
        for i, name in enumerate(names)
    ])
    share = F.try_divide(F.lit(100.0) * F.col("missing_count"), F.col("rows_count"))
    return counted.select(F.inline(facts)).withColumn(
        "missing_percentage", F.coalesce(F.round(share, 2), F.lit(0.0))
    )


def profile_summary(df: DataFrame) -> DataFrame:
    names = data_columns(df)
    totals = column_missing(df).agg(
        F.max("rows_count").alias("rows_count"),
        F.sum("missing_count").alias("total_missing_values"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing_values"),
    )
    # Two one-row facts folded into one row by their maximum: no join is needed.
    return (
        totals.unionByName(duplicate_count(df, names), allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in (
            "rows_count", "total_missing_values", "columns_with_missing_values", "duplicate_rows")])
        .select(
            "rows_count",
            F.lit(len(names)).cast("bigint").alias("columns_count"),
            F.col("duplicate_rows").alias("duplicate_rows_count"),
            "total_missing_values",
            "columns_with_missing_values",
        )
    )


def _long(df: DataFrame, names: list[str], keep: list[str], value: Column | None = None) -> DataFrame:
    """(kept columns, ordinal, value text) rows of the named columns, without missing cells."""
    every = data_columns(df)
    cells = F.array(*[
        F.struct(F.lit(every.index(n) + 1).alias("ordinal"), value_text(df, n).alias("value"))
        for n in names
    ])
    return df.select(*keep, F.inline(cells)).filter(F.col("value").isNotNull())


def _distinct_text(df: DataFrame, name: str) -> Column:
    """Text that differs exactly where the values do; both zeros are one value."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(quoted(name)), quoted(name) + F.lit(0.0)).cast("string")
    return quoted(name).cast("string")


def _distinct_cells(df: DataFrame, names: list[str]) -> DataFrame:
    every = data_columns(df)
    cells = F.array(*[
        F.struct(F.lit(every.index(n) + 1).alias("ordinal"), _distinct_text(df, n).alias("value")) for n in names
    ])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def column_unique(
    df: DataFrame, names: list[str] | None = None, relative_error: float | None = None
) -> DataFrame:
    """(ordinal, column, unique count) of all columns; see ``distinct``.

    A hot value collapses in its own task before the shuffle. With a relative error the counts are
    sketched instead, and only the sketches are shuffled.
    """
    names = data_columns(df) if names is None else names
    every = data_columns(df)
    if relative_error is None:
        counted = distinct_counts(df, {n: every.index(n) + 1 for n in names})
    else:
        counted = _distinct_cells(df, names).groupBy("ordinal").agg(
            F.approx_count_distinct("value", relative_error).alias("unique_count")
        )
    # One row per column: it keeps all-missing columns in the result.
    listed = df.sparkSession.createDataFrame(
        [(every.index(n) + 1, n) for n in names], "ordinal int, column_name string"
    )
    return listed.join(counted, "ordinal", "left").select(
        "ordinal", "column_name", F.coalesce("unique_count", F.lit(0)).alias("unique_count")
    )


def first_values(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """(ordinal, position, row number, value): the first k non-missing values per column.

    Rows are read from the front of the numbered table (a pushed-down ``row_number`` bound) and
    the front is widened only until every column has k values or has been read whole.
    """
    rows = df.agg(F.max(ROW_NUMBER)).first()[0] or 0
    front = max(4 * k, 4_096)
    pending, parts = list(names), []
    while pending:
        whole = front >= rows
        head = df if whole else df.filter(F.col(ROW_NUMBER) <= front)
        if whole:
            full = pending
        else:
            filled = head.agg(*[F.count_if(present(df, n)).alias(str(i)) for i, n in enumerate(pending)]).first()
            full = [n for i, n in enumerate(pending) if filled[str(i)] >= k]
        if full:
            parts.append(_long(head, full, [ROW_NUMBER]))
        pending = [n for n in pending if n not in full]
        front *= 32
    ranked = Window.partitionBy("ordinal").orderBy(ROW_NUMBER)
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= k)
    )


def column_samples(df: DataFrame) -> DataFrame:
    """(ordinal, position, value): the first five non-missing values of every column."""
    return first_values(df, data_columns(df), SAMPLE_VALUES).select(
        "ordinal", F.col("position").cast("bigint").alias("position"), "value"
    )


def text_columns(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if isinstance(df.schema[n].dataType, T.StringType)]


def date_parse_ratio(df: DataFrame) -> DataFrame:
    """(ordinal, values, parsed, ratio) over all values of every text column, in one aggregate."""
    every, names = data_columns(df), text_columns(df)
    schema = "ordinal int, probed_values bigint, parsed_values bigint, parse_ratio double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    counted = df.agg(*[
        F.struct(F.count(quoted(n)).alias("values"), F.count(parse_date(quoted(n))).alias("parsed")).alias(f"c{i}")
        for i, n in enumerate(names)
    ])
    facts = F.array(*[
        F.struct(
            F.lit(every.index(n) + 1).alias("ordinal"),
            F.col(f"c{i}.values").alias("probed_values"),
            F.col(f"c{i}.parsed").alias("parsed_values"),
        )
        for i, n in enumerate(names)
    ])
    return counted.select(F.inline(facts)).filter(F.col("probed_values") > 0).withColumn(
        "parse_ratio", F.round(F.col("parsed_values") / F.col("probed_values"), 6)
    )


def _known_type(df: DataFrame, name: str) -> str | None:
    """The logical type that header and column type settle, or None where values must be read."""
    kind = df.schema[name].dataType
    if is_identifier(name):
        return "identifier"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return "numeric"
    return None


def _dated_columns(df: DataFrame, names: list[str]) -> set[str]:
    """Text columns whose values are nearly all dates."""
    if not names:
        return set()
    ratios = date_parse_ratio(df.select(*[quoted(n) for n in names])).collect()
    return {
        names[r["ordinal"] - 1] for r in ratios
        if r["parsed_values"] / r["probed_values"] >= DATE_PROBE_SHARE
    }


def _by_distinct(unique: int, rows: int) -> str:
    few = unique <= CATEGORY_MAX_DISTINCT or (rows and unique / rows <= CATEGORY_MAX_SHARE)
    return "categorical" if few else "text"


def logical_types(df: DataFrame) -> dict[str, str]:
    """Logical type per column. Only unsettled text columns are read."""
    names = data_columns(df)
    types = {n: _known_type(df, n) for n in names}
    unsettled = [n for n in names if types[n] is None]
    types.update(dict.fromkeys(_dated_columns(df, unsettled), "datetime"))
    unsettled = [n for n in unsettled if types[n] is None]
    if unsettled:
        rows = df.count()
        for r in column_unique(df, unsettled).collect():
            types[r["column_name"]] = _by_distinct(r["unique_count"], rows)
    return types


def logical_type_table(types: dict[str, str], df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, n, types[n]) for i, n in enumerate(data_columns(df), 1)],
        "ordinal int, column_name string, logical_type string",
    )


def _ordered(df: DataFrame, name: str) -> Column:
    """A number with infinities, without NaN."""
    return F.when(present(df, name), quoted(name).cast("double"))


def _moments(df: DataFrame, name: str) -> Column:
    value = _ordered(df, name)
    return F.struct(
        F.count(value), F.avg(value), F.stddev_samp(value), F.min(value), F.max(value), quantile_sketch(value, QUARTILES)
    )


def is_boolean(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.BooleanType)


def numeric_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per number column; non-finite results become NULL.

    Infinities are values and are ranked as such. Boolean columns have ``boolean_summary``.
    """
    names = [n for n in names if not is_boolean(df, n)]
    facts = df.agg(*[_moments(df, n).alias(str(i)) for i, n in enumerate(names)]).first() if names else []
    return _summary_rows(df, {n: tuple(facts[i]) for i, n in enumerate(names)})


def _summary_rows(df: DataFrame, facts: dict[str, tuple]) -> DataFrame:
    counts, sketches = {n: f[0] for n, f in facts.items()}, {n: f[5] for n, f in facts.items()}
    quartiles = exact_quantiles(df, counts, QUARTILES, infinite=True, sketches=sketches)
    every = data_columns(df)
    rows = [
        (every.index(n) + 1, n, count, mean, deviation, low, *quartiles[n], high)
        for n, (count, mean, deviation, low, high, _) in facts.items()
    ]
    measures = ("mean", "std", "minimum", "q25", "q50", "q75", "maximum")
    frame = df.sparkSession.createDataFrame(
        rows,
        "ordinal int, column_name string, value_count bigint, "
        + ", ".join(f"{m} double" for m in measures),
    )
    return frame.select(
        "ordinal", "column_name", "value_count", *[finite_or_null(F.col(m)).alias(m) for m in measures]
    )


def boolean_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """(ordinal, column, count, unique, top, frequency) of boolean columns; a tie goes to false."""
    names = [n for n in names if is_boolean(df, n)]
    schema = "ordinal int, column_name string, value_count bigint, unique_count bigint, top_value string, frequency bigint"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    every = data_columns(df)
    counted = df.agg(*[
        F.struct(F.count_if(quoted(n)).alias("yes"), F.count_if(~quoted(n)).alias("no")).alias(f"c{i}")
        for i, n in enumerate(names)
    ])
    facts = []
    for i, n in enumerate(names):
        yes, no = F.col(f"c{i}.yes"), F.col(f"c{i}.no")
        facts.append(F.struct(
            F.lit(every.index(n) + 1).alias("ordinal"), F.lit(n).alias("column_name"), (yes + no).alias("value_count"),
            ((yes > 0).cast("bigint") + (no > 0).cast("bigint")).alias("unique_count"),
            F.when(yes > no, "true").when(no > 0, "false").alias("top_value"), F.greatest(yes, no).alias("frequency"),
        ))
    return counted.select(F.inline(F.array(*facts)))


def as_date(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date(quoted(name))
    return quoted(name).cast("timestamp_ntz")


def date_range(df: DataFrame, names: list[str]) -> DataFrame:
    """Earliest and latest date per date column, as ISO text."""
    every = data_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column_name string, minimum string, maximum string")
    found = df.agg(*[
        bound(as_date(df, n)).alias(f"{kind}{i}")
        for i, n in enumerate(names) for kind, bound in (("l", F.min), ("h", F.max))
    ])
    return found.select(F.inline(F.array(*[
        F.struct(
            F.lit(every.index(n) + 1).alias("ordinal"),
            F.lit(n).alias("column_name"),
            iso_text(F.col(f"l{i}")).alias("minimum"),
            iso_text(F.col(f"h{i}")).alias("maximum"),
        )
        for i, n in enumerate(names)
    ])))


def top_values(df: DataFrame, names: list[str], k: int = TOP_VALUES, distinct: dict[str, int] | None = None) -> DataFrame:
    """(ordinal, position, value, count): the k most common values, ties by value; see ``frequent``.
    Distinct counts that are known already spare a scan."""
    places = {n: i for i, n in enumerate(data_columns(df), 1) if n in names}
    known = {places[n]: count for n, count in (distinct or {}).items() if n in places}
    return top_counts(df, {i: value_text(df, n) for n, i in places.items()}, k, known)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type names, missing and distinct counts."""
    return profile_table(df).columns


@dataclass(frozen=True)
class Profile:
    """All parts of a profile: each column is summarised as its logical type asks."""

    source: DataFrame
    rows_count: int
    types: dict[str, str]
    columns: DataFrame
    dates: DataFrame
    moments: dict[str, tuple]

    def of(self, kind: str) -> list[str]:
        return [n for n, t in self.types.items() if t == kind]

    @property
    def numbers(self) -> DataFrame:
        """Moments are known; the quartiles are sought when asked for."""
        return _summary_rows(self.source, self.moments)

    @property
    def booleans(self) -> DataFrame:
        return boolean_summary(self.source, self.of("numeric"))

    @property
    def common(self) -> DataFrame:
        """The most common values of the categorical columns, sought when asked for."""
        return top_values(self.source, self.of("categorical"), distinct={r["column_name"]: r["unique_count"] for r in self.columns.collect()})

    @property
    def summary(self) -> DataFrame:
        """The row of ``profile_summary``; only the duplicates are still to be counted."""
        return self.summary_with(duplicate_count(self.source, data_columns(self.source)))

    def summary_with(self, repeats: DataFrame) -> DataFrame:
        missing = self.columns.agg(
            F.sum("missing_count").alias("total_missing_values"),
            F.count_if(F.col("missing_count") > 0).alias("columns_with_missing_values"),
        ).first()
        return repeats.select(
            F.lit(self.rows_count).cast("bigint").alias("rows_count"), F.lit(len(self.types)).cast("bigint").alias("columns_count"),
            F.col("duplicate_rows").alias("duplicate_rows_count"), F.lit(missing[0]).cast("bigint").alias("total_missing_values"),
            F.lit(missing[1]).cast("bigint").alias("columns_with_missing_values"),
        )

    @property
    def samples(self) -> DataFrame:
        return column_samples(self.source)


def profile_table(df: DataFrame) -> Profile:
    """The whole profile from one wide aggregate and the distinct counts.

    The aggregate has counts, moments, quantile sketches and date bounds of every column. One row per
    column is collected; quartiles, most common values and samples are sought when asked for.
    """
    names, spark = data_columns(df), df.sparkSession
    known = {n: _known_type(df, n) for n in names}
    numbers = [n for n in names if known[n] == "numeric" and not is_boolean(df, n)]
    dated = [n for n in names if known[n] == "datetime" or (known[n] is None and n in text_columns(df))]
    wide = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(present(df, n)).alias(f"p{i}") for i, n in enumerate(names)],
        *[_moments(df, n).alias(f"m{i}") for i, n in enumerate(numbers)],
        *[F.struct(F.count(d), iso_text(F.min(d)), iso_text(F.max(d))).alias(f"d{i}")
          for i, d in enumerate(as_date(df, n) for n in dated)],
    )
    distinct = distinct_counts(df, {n: i for i, n in enumerate(names, 1)})
    with ThreadPoolExecutor(2) as pool:  # neither needs the other
        counted = pool.submit(inheritable_thread_target(spark)(distinct.collect))
        facts = wide.first()
        unique = {r["ordinal"]: r["unique_count"] for r in counted.result()}
    rows, dates = facts["rows"], {n: tuple(facts[f"d{i}"]) for i, n in enumerate(dated)}
    types, columns = {}, []
    for i, name in enumerate(names):
        filled, kind = facts[f"p{i}"], known[name]
        if kind is None and name in dates and filled and dates[name][0] / filled >= DATE_PROBE_SHARE:
            kind = "datetime"
        types[name] = kind or _by_distinct(unique.get(i + 1, 0), rows)
        columns.append((i + 1, name, df.schema[name].dataType.simpleString(), types[name], rows - filled,
                        float(round_half_up(100.0 * (rows - filled) / rows, 2)) if rows else 0.0, unique.get(i + 1, 0)))
    return Profile(
        df,
        rows,
        types,
        spark.createDataFrame(
            columns,
            "ordinal int, column_name string, data_type string, logical_type string, missing_count bigint, "
            "missing_percentage double, unique_count bigint"),
        spark.createDataFrame(
            [(names.index(n) + 1, n, low, high) for n, (_, low, high) in dates.items() if types[n] == "datetime"],
            "ordinal int, column_name string, minimum string, maximum string"),
        {n: tuple(facts[f"m{i}"]) for i, n in enumerate(numbers) if types[n] == "numeric"},
    )


def complete_profile(df: DataFrame) -> dict[str, DataFrame]:
    """All parts of a profile, computed and kept: summary, columns, samples, numbers, booleans, dates, common.

    Parts that do not need each other's results run side by side, so that one is planned and compiled
    while another one computes.
    """
    run = inheritable_thread_target(df.sparkSession)
    with ThreadPoolExecutor(6) as pool:
        repeats = pool.submit(run(lambda: pin(duplicate_count(df, data_columns(df)))))
        samples = pool.submit(run(lambda: pin(column_samples(df))))
        found = profile_table(df)
        later = {
            part: pool.submit(run(lambda part=part: pin(getattr(found, part)))) for part in ("numbers", "booleans", "common")
        }
        return {
            "summary": pin(found.summary_with(repeats.result())), "columns": found.columns, "dates": found.dates,
            "samples": samples.result(), **{part: job.result() for part, job in later.items()},
        }
