"""Exact numbers of distinct values of many columns, without a text for every cell.

Whole numbers, dates, times and truth values are bits: a value is one bit of the 64-bit word that it
falls into, words are or-ed in every task before they travel, and the bits are counted. A column of
dense keys sends a 64th of its values, and one of scattered values a row of two numbers for each.
Other doubles travel as doubles, texts as themselves up to 15 bytes and as 16 bytes of their MD5 beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.scalars import quoted

WORD_BITS = 6  # 64 values a word
SHORT_TEXT = 15  # a longer text travels as 16 bytes of its MD5, which no shorter one equals


def as_whole(df: DataFrame, name: str) -> Column | None:
    """A bigint that differs exactly where the values do, or None where there is no such number."""
    kind, value = df.schema[name].dataType, quoted(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value.cast("bigint")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        minutes = F.unix_date(value.cast("date")).cast("bigint") * 1440 + F.hour(value) * 60 + F.minute(value)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
    return None


def _bits(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """(ordinal, word, bits): the values of each column that fall into a word, as its bits."""
    cells = F.array(*[
        F.struct(F.lit(place).alias("ordinal"), as_whole(df, name).alias("value")) for name, place in places.items()
    ])
    long = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("value").bitwiseAND(F.lit(63)).cast("int"))
    return long.groupBy("ordinal", F.shiftright("value", WORD_BITS).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _keys(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """(ordinal, number, text): the distinct values of columns that are no whole numbers."""
    cells = []
    for name, place in places.items():
        value = quoted(name)
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            number, text = F.when(~F.isnan(value), value.cast("double") + F.lit(0.0)), F.lit(None).cast("binary")
        else:
            whole = value.cast("string")
            short = F.octet_length(whole) <= SHORT_TEXT
            number = F.lit(None).cast("double")
            text = F.when(short, whole.cast("binary")).otherwise(F.unhex(F.md5(whole.cast("binary"))))
        cells.append(F.struct(F.lit(place).alias("ordinal"), number.alias("number"), text.alias("text")))
    long = df.select(F.inline(F.array(*cells))).filter(F.col("number").isNotNull() | F.col("text").isNotNull())
    return long.distinct()


def distinct_counts(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """(ordinal, unique_count) of the named columns that have a value; ``places`` maps names to ordinals.

    NaN is missing and both zeros are one value.
    """
    whole = {n: i for n, i in places.items() if as_whole(df, n) is not None}
    other = {n: i for n, i in places.items() if n not in whole}
    parts = []
    if whole:
        parts.append(_bits(df, whole).groupBy("ordinal").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("unique_count")))
    if other:
        parts.append(_keys(df, other).groupBy("ordinal").agg(F.count("*").alias("unique_count")))
    if not parts:
        return df.sparkSession.createDataFrame([], "ordinal int, unique_count bigint")
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
