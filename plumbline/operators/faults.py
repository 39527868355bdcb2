"""Deliberate, auditable faults in a clean numbered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import quoted
from plumbline.sources.rows import ROW_NUMBER

# 0-based row ranges of each fault, the added amount, and the distance to the copied rows.
BLANK_ROWS = (0, 100)
NEGATED_ROWS = (120, 160)
RAISED_ROWS = (200, 280)
RAISED_AMOUNT = 25
COPIED_ROWS = (350, 380)
COPY_DISTANCE = 50


def _within(rows: tuple[int, int], shift: int = 0):
    return F.col(ROW_NUMBER).between(rows[0] + 1 + shift, rows[1] + shift)


def inject_faults(df: DataFrame, blank: str, price: str, total: str) -> DataFrame:
    """Blank one field, negate prices, raise totals and overwrite rows by copies of later ones.

    The copies come from a pushed-down range of row numbers, so only those rows are read twice,
    and the joinless union replaces them in place.
    """
    edited = df.select(*[
        F.when(~_within(BLANK_ROWS), quoted(n)).alias(n) if n == blank
        else F.when(_within(NEGATED_ROWS), -quoted(n)).otherwise(quoted(n)).alias(n) if n == price
        else F.when(_within(RAISED_ROWS), quoted(n) + F.lit(RAISED_AMOUNT).cast(df.schema[n].dataType))
        .otherwise(quoted(n)).alias(n) if n == total
        else quoted(n)
        for n in df.columns
    ])
    copies = df.filter(_within(COPIED_ROWS, COPY_DISTANCE)).withColumn(
        ROW_NUMBER, F.col(ROW_NUMBER) - COPY_DISTANCE
    )
    last = df.agg(F.max(ROW_NUMBER)).first()[0] or 0
    replaced = _within(COPIED_ROWS) & (F.col(ROW_NUMBER) + COPY_DISTANCE <= last)
    return edited.filter(~replaced).unionByName(copies)
