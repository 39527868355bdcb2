"""Row-level expressions. All of them stay inside the JVM and inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.constants import (
    CANCELLATION_PREFIX,
    DATE_FORMATS,
    GRADES,
    HIGH_SEVERITY_PERCENT,
    LOWEST_GRADE,
    MEDIUM_SEVERITY_PERCENT,
    METHOD_LABELS,
    NO_DISCOUNT_TEXTS,
    REPORT_NAME_DEFAULT,
    REPORT_NAME_ILLEGAL_PATTERN,
    REPORT_NAME_LENGTH,
    REPORT_NAME_PREFIX,
    REPORT_NAME_SUFFIX,
    REPORT_NAME_SUFFIX_PATTERN,
)

# The texts that count as numbers. Spark's own cast also takes '1d' and '0x1p3'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

INFINITY = float("inf")


def quoted(name: str) -> Column:
    """A column by its exact header, which may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def never() -> Column:
    return F.lit(False)


def text_number(text: Column) -> Column:
    """Text to double; malformed text becomes NULL instead of an error."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """Any column to double under the lenient rules, chosen by its type."""
    kind = df.schema[name].dataType
    value = quoted(name)
    if isinstance(kind, T.StringType):
        return text_number(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def is_finite(value: Column) -> Column:
    """Never NULL: false for missing, NaN and both infinities."""
    return F.coalesce(F.abs(value) < F.lit(INFINITY), F.lit(False))


def finite_or_null(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def cancellation_marker(value: Column) -> Column:
    """Missing invoice text carries no marker."""
    return F.coalesce(F.startswith(value.cast("string"), F.lit(CANCELLATION_PREFIX)), F.lit(False))


def says_no_discount(value: Column) -> Column:
    cleaned = F.lower(F.trim(value.cast("string")))
    return F.coalesce(cleaned.isin(*NO_DISCOUNT_TEXTS), F.lit(False))


def parse_date(text: Column) -> Column:
    """Text to timestamp over the documented formats; anything else becomes NULL."""
    # Every format begins with a digit and has eight characters or more: most other texts end here.
    possible = (F.length(text) >= 8) & F.ascii(F.trim(text)).between(ord("0"), ord("9"))
    cleaned = F.regexp_replace(F.trim(text), r"(?<=\d)T(?=\d)", " ")
    parsed = None
    for shape, pattern in DATE_FORMATS:
        hit = cleaned.rlike(shape)
        value = F.try_to_timestamp(cleaned, F.lit(pattern))
        parsed = F.when(hit, value) if parsed is None else parsed.when(hit, value)
    return F.when(possible, parsed.cast("timestamp_ntz"))


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def six_digits(value: Column) -> Column:
    """A number rounded to six significant digits, as short text ('30', '0.5', '1234.57')."""
    places = F.lit(5) - F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), places.cast("double"))
    rounded = F.round(value * scale) / scale
    integral = (rounded == F.floor(rounded)) & (F.abs(rounded) < 1e6)
    return (
        F.when(value == 0, F.lit("0"))
        .when(integral, rounded.cast("bigint").cast("string"))
        .otherwise(rounded.cast("string"))
    )


def report_text(value: Column, maximum: int | None = None) -> Column:
    """Printable, optionally shortened with an ellipsis, and escaped for markup."""
    text = F.coalesce(value.cast("string"), F.lit("Not available"))
    text = F.regexp_replace(text, r"[\p{C}\p{Z}]", " ")
    if maximum:
        text = F.when(
            F.length(text) > maximum, F.concat(F.left(text, F.lit(maximum - 3)), F.lit("..."))
        ).otherwise(text)
    # The five markup characters and their escapes.
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def number_text(value: Column, decimals: int = 0) -> Column:
    return F.coalesce(F.format_number(value, decimals), F.lit("Not evaluated"))


def report_name(file_name: Column) -> Column:
    """A safe download name from an uploaded file name."""
    base = F.substring_index(F.replace(file_name, F.lit("\\"), F.lit("/")), "/", -1)
    stem = F.regexp_replace(base, REPORT_NAME_SUFFIX_PATTERN, "")
    stem = F.regexp_replace(stem, REPORT_NAME_ILLEGAL_PATTERN, "_")
    stem = F.left(F.btrim(stem, F.lit(" .")), F.lit(REPORT_NAME_LENGTH))
    stem = F.when(stem == "", REPORT_NAME_DEFAULT).otherwise(stem)
    return F.concat(F.lit(REPORT_NAME_PREFIX), stem, F.lit(REPORT_NAME_SUFFIX))


def display_label(name: Column) -> Column:
    label = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for method, text in METHOD_LABELS.items():
        label = F.when(name == method, text).otherwise(label)
    return label


def severity(percent: Column) -> Column:
    return (
        F.when(percent >= HIGH_SEVERITY_PERCENT, "high")
        .when(percent >= MEDIUM_SEVERITY_PERCENT, "medium")
        .otherwise("low")
    )


def grade(score: Column) -> Column:
    label = F.when(score.isNull(), F.lit(None).cast("string"))
    for floor, name in GRADES:
        label = label.when(score >= floor, name)
    return label.otherwise(LOWEST_GRADE)


def percent_text(value: Column) -> Column:
    """A two-decimal percentage as shortest text: 25.0, 33.33."""
    return F.round(value, 2).cast("string")
