"""Evidence per signal and a cautious reading per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.names import Roles, resolve_roles
from plumbline.functions.scalars import cancellation_marker, finite_or_null, never, quoted, to_number
from plumbline.operators.anomaly import FOREST, Review, outside
from plumbline.sources.rows import ROW_NUMBER

EVIDENCE_TYPE = (
    "array<struct<method:string,field:string,observed_value:double,direction:string,"
    "boundary:double,distance_from_boundary:double,message:string>>"
)


def evidence_entries(found: Review) -> Column:
    """Array of evidence structs, one per signal, in signal order."""
    crossed = F.array_compact(F.array(*[
        F.when(outside(found.rows, b), F.struct(
            F.lit(b.method).alias("method"), F.lit(b.field).alias("field"),
            F.lit(K.METHOD_LABELS[b.method]).alias("label"), quoted(b.field).cast("double").alias("value"),
            F.lit(b.lower).alias("lower"), F.lit(b.upper).alias("upper"),
        ))
        for b in found.bounds if b.evaluated
    ]))

    def evidence(e: Column) -> Column:
        below = e["value"] < e["lower"]
        boundary = F.when(below, e["lower"]).otherwise(e["upper"])
        direction = F.when(below, "below").otherwise("above")
        return F.struct(
            e["method"].alias("method"), e["field"].alias("field"), e["value"].alias("observed_value"),
            direction.alias("direction"), boundary.alias("boundary"),
            F.round(F.abs(e["value"] - boundary), 6).alias("distance_from_boundary"),
            F.concat(e["field"], F.lit(" is "), direction, F.lit(" the "), e["label"], F.lit(" boundary."))
            .alias("message"),
        )

    entries = (
        F.transform(crossed, evidence) if any(b.evaluated for b in found.bounds)
        else F.array().cast(EVIDENCE_TYPE)
    )
    if found.forest:
        score = F.round("forest_score", 6)
        unusual = F.when(F.col("forest_score") < 0, F.struct(
            F.lit(FOREST).alias("method"),
            F.lit(", ".join(found.forest.fields)).alias("field"),
            score.alias("observed_value"),
            F.lit("below").alias("direction"),
            F.lit(0.0).alias("boundary"),
            F.abs(score).alias("distance_from_boundary"),
            F.lit(K.FOREST_EVIDENCE).alias("message"),
        ))
        entries = F.concat(entries, F.array_compact(F.array(unusual)))
    return entries


def anomaly_evidence(found: Review) -> DataFrame:
    """(row number, position, evidence) rows of every flagged row. Bounds are literals: no join."""
    return (
        found.flagged
        .select(ROW_NUMBER, F.posexplode(evidence_entries(found)).alias("at", "evidence"))
        .select(ROW_NUMBER, (F.col("at") + 1).cast("bigint").alias("position"), "evidence.*")
    )


def _reading(values: tuple) -> Column:
    category, business_rule, message, next_step = values
    return F.struct(
        F.lit(category).alias("category"), F.lit(business_rule).alias("business_rule"),
        F.lit(message).alias("message"), F.lit(next_step).alias("next_step"),
    )


def interpretation(found: Review, roles: Roles | None = None) -> Column:
    """The first reading that applies: business rules, then the signals, then the absence of both."""
    df = found.rows
    roles = roles or resolve_roles(found.source_columns)

    def number(role: str) -> Column:
        return finite_or_null(to_number(df, roles.matches[role])) if roles.has(role) else F.lit(None).cast("double")

    quantity, price = number("quantity"), number("unit_price")
    returned = F.coalesce(quantity < 0, never())
    has_invoice = K.INVOICE_HEADER in found.source_columns
    marked = cancellation_marker(quoted(K.INVOICE_HEADER)) if has_invoice else never()
    return (
        F.when(F.coalesce(price < 0, never()), _reading(K.NEGATIVE_PRICE_READING))
        .when(returned & marked, _reading(K.RETURN_READING))
        .when(returned & F.lit(has_invoice), _reading(K.NEGATIVE_QUANTITY_READING))
        .when(F.coalesce(price == 0, never()), _reading(K.ZERO_PRICE_READING))
        .when(F.col("votes") > 0, _reading(K.FLAGGED_READING))
        .otherwise(_reading(K.NO_SIGNAL_READING if found.evaluated else K.NOT_EVALUATED_READING))
    )


def row_interpretation(found: Review) -> DataFrame:
    """Every row with its reading."""
    return found.scored.select(ROW_NUMBER, interpretation(found).alias("reading")).select(
        ROW_NUMBER, "reading.*"
    )


def explain_rows(found: Review, rows: DataFrame | None = None) -> DataFrame:
    """Status, values, signals, evidence and reading of the given rows of a review."""
    rows = found.scored if rows is None else rows
    missed = "not_flagged" if found.evaluated else "not_evaluated"
    values = F.map_from_arrays(
        F.array(*[F.lit(f) for f in found.fields]).cast("array<string>"),
        F.array(*[finite_or_null(quoted(f).cast("double")) for f in found.fields]).cast("array<double>"),
    )
    invoice = (
        quoted(K.INVOICE_HEADER).cast("string") if K.INVOICE_HEADER in found.source_columns
        else F.lit(None).cast("string")
    )
    return rows.select(
        ROW_NUMBER,
        F.when(F.col("votes") > 0, "flagged").otherwise(missed).alias("status"),
        "votes", "forest_score", "signals",
        values.alias("values"),
        invoice.alias("invoice_number"),
        evidence_entries(found).alias("evidence"),
        interpretation(found).alias("interpretation"),
    ).withColumn(
        "business_context",
        F.when(F.col("interpretation.business_rule"), F.col("interpretation.message")),
    )


def explain_row(found: Review, row_number: int) -> DataFrame:
    """One row by its number, flagged or not."""
    last = found.source.agg(F.max(ROW_NUMBER)).first()[0] or 0
    if not 1 <= row_number <= last:
        raise ValueError(f"Row {row_number} is not in the table.")
    return explain_rows(found, found.row(row_number))
