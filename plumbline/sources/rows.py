"""Dense 1-based row numbers without a single-task window.

A row number is given once, when a table is stored, and is then an ordinary column. The stored
table is ordered by it, so ``row_number <= n`` prunes row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.sources.storage import discard, store

ROW_NUMBER = "row_number"
_SEQUENCE = "__sequence"
_PART = "__part"
_START = "__start"
_COMPRESSION = "zstd"  # numbered tables hold every row: written twice, they are what is written most
_LOW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _dense(staged: DataFrame, name: str) -> DataFrame:
    """Replace stored (partition, position) identifiers by dense numbers."""
    part = F.shiftright(F.col(_SEQUENCE), _LOW_BITS)
    position = F.col(_SEQUENCE).bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    sizes = staged.groupBy(part.alias(_PART)).agg(F.count("*").alias("__rows"))
    # One row per written partition, so the global window stays small, and so does the broadcast: without it
    # the whole table would be exchanged and sorted by its few partition numbers.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(_START))
    return (
        staged.withColumn(_PART, part)
        .join(F.broadcast(starts), _PART)
        .withColumn(name, (F.col(_START) + position + 1).cast("bigint"))
        .drop(_PART, _START, _SEQUENCE)
    )


def number_by(
    df: DataFrame, keys: list[str | Column], label: str, name: str = ROW_NUMBER
) -> DataFrame:
    """Row numbers in key order.

    The sorted rows are stored before they are counted: a lost executor may not re-draw the sort
    boundaries between the two reads.
    """
    return _dense(
        store(df.orderBy(*keys).withColumn(_SEQUENCE, F.monotonically_increasing_id()), label, _COMPRESSION), name
    )


def stored_by(
    df: DataFrame, keys: list[str | Column], label: str, name: str = ROW_NUMBER, columns: list[Column] | None = None
) -> DataFrame:
    """The numbered table, stored; the sorted copy it was numbered from is deleted.

    ``columns`` are worked out after the sort, beside the number: what they are made of is often narrower.
    """
    staged = store(df.orderBy(*keys).withColumn(_SEQUENCE, F.monotonically_increasing_id()), f"{label}-sorted", _COMPRESSION)
    numbered = _dense(staged, name)
    stored = store(numbered if columns is None else numbered.select(*columns, name), label, _COMPRESSION)
    discard(staged)
    return stored


def number_files(df: DataFrame) -> DataFrame:
    """Row numbers in (file path, position in file) order for a Parquet source; nothing is shuffled
    but one count per file."""
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias(_PART),
        F.col("_metadata.row_index").alias(_SEQUENCE),
    )
    sizes = located.groupBy(_PART).agg(F.count("*").alias("__rows"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias(_START))
    return (
        located.join(F.broadcast(starts), _PART)
        .withColumn(ROW_NUMBER, (F.col(_START) + F.col(_SEQUENCE) + 1).cast("bigint"))
        .drop(_PART, _START, _SEQUENCE)
    )


def data_columns(df: DataFrame) -> list[str]:
    """The source columns, without the row number."""
    return [name for name in df.columns if name != ROW_NUMBER]
