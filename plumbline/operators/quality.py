"""Score completeness, uniqueness, validity and consistency with counted evidence.

Every counter of the table scan is in one aggregate. Duplicate rows and the product rule need
their own grouping; the three one-row results are folded into one row of facts, and everything
else (scores, dimensions, issues, the overall score) is a projection of that row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as K
from plumbline.functions.names import Roles, resolve_roles
from plumbline.functions.scalars import (
    cancellation_marker,
    grade,
    is_finite,
    never,
    percent_text,
    quoted,
    says_no_discount,
    severity,
    to_number,
)
from plumbline.operators.profile import present
from plumbline.operators.uniqueness import duplicate_count
from plumbline.sources.rows import ROW_NUMBER, data_columns
from plumbline.sources.storage import pin

@dataclass(frozen=True)
class RowRules:
    """Row predicates of the validity and line-total rules; absent rules are constant false."""

    quantity: Column | None
    price: Column | None
    total: Column | None
    bad_quantity: Column
    bad_price: Column
    negative_quantity: Column
    negative_price: Column
    zero_price: Column
    complete: Column
    comparable: Column
    expected: Column | None
    mismatch: Column

    @property
    def invalid(self) -> Column:
        return self.negative_quantity | self.negative_price | self.bad_quantity | self.bad_price


def checks_cancellations(roles: Roles) -> bool:
    """Only this literal header is known to follow the C-invoice convention."""
    return roles.get("transaction_id") == K.INVOICE_HEADER


NUMBER_ROLES = ("quantity", "unit_price", "line_total", "tax_amount")


def with_numbers(df: DataFrame, roles: Roles) -> DataFrame:
    """The table with the number of each retail role beside it, so that text is parsed once a row."""
    return df.withColumns({
        f"__{role}": to_number(df, roles.matches[role]) for role in NUMBER_ROLES if roles.has(role)
    })


def row_rules(df: DataFrame, roles: Roles) -> RowRules:
    """Rules over a table that ``with_numbers`` has prepared."""

    def number(role: str) -> Column | None:
        return F.col(f"__{role}") if roles.has(role) else None

    quantity, price, total = number("quantity"), number("unit_price"), number("line_total")
    if quantity is None or price is None:
        return RowRules(quantity, price, total, *[never()] * 7, None, never())

    negative_quantity = never()
    if checks_cancellations(roles):
        negative_quantity = (
            is_finite(quantity) & F.coalesce(quantity < 0, never())
            & ~cancellation_marker(quoted(K.INVOICE_HEADER))
        )
    comparable, expected, mismatch = never(), None, never()
    if total is not None:
        comparable = is_finite(quantity) & is_finite(price) & is_finite(total)
        expected = quantity * price
        if roles.has("discount_applied"):
            comparable = comparable & says_no_discount(quoted(roles.matches["discount_applied"]))
        if roles.has("tax_amount"):
            tax = number("tax_amount")
            comparable = comparable & is_finite(tax)
            expected = expected + tax
        tolerance = F.greatest(F.lit(K.TOTAL_TOLERANCE), F.lit(K.TOTAL_TOLERANCE_SHARE) * F.abs(total))
        mismatch = comparable & F.coalesce(F.abs(total - expected) > tolerance, never())
    return RowRules(
        quantity, price, total,
        bad_quantity=present(df, roles.matches["quantity"]) & ~is_finite(quantity),
        bad_price=present(df, roles.matches["unit_price"]) & ~is_finite(price),
        negative_quantity=negative_quantity,
        negative_price=is_finite(price) & F.coalesce(price < 0, never()),
        zero_price=F.coalesce(price == 0, never()),
        complete=is_finite(quantity) & is_finite(price),
        comparable=comparable, expected=expected, mismatch=mismatch,
    )


def product_descriptions(df: DataFrame, roles: Roles) -> DataFrame:
    """One row: codes checked, and codes that carry more than one description.

    Grouping by the pair first collapses a hot code inside every task; after it a code holds one
    row per description.
    """
    code, name = (quoted(roles.matches[r]) for r in ("product_id", "product_name"))
    return (
        df.select(code.alias("code"), name.alias("name"))
        .filter(F.col("code").isNotNull() & F.col("name").isNotNull())
        .groupBy("code", "name").agg(F.lit(1).alias("one"))
        .groupBy("code").agg(F.count("*").alias("names"))
        .agg(
            F.count("*").alias("codes_checked"),
            F.count_if(F.col("names") > 1).alias("codes_affected"),
        )
    )


@dataclass(frozen=True)
class Assessment:
    """One row of counters and the scores derived from them, with the headers they belong to.

    ``counted`` is the same row for results that rest on the table scan's counters alone: reading it does
    not make Spark count duplicate rows, which it cannot leave out by itself.
    """

    scores: DataFrame
    names: list[str]
    roles: Roles
    counted: DataFrame

    def pinned(self) -> Assessment:
        """Evaluate that row once for several result tables."""
        row = pin(self.scores)
        return Assessment(row, self.names, self.roles, row)


def assess(df: DataFrame, roles: Roles | None = None) -> Assessment:
    names = data_columns(df)
    roles = roles or resolve_roles(names)
    numbered = with_numbers(df, roles)
    rules = row_rules(numbered, roles)
    counters = {
        **{f"missing_{i}": ~present(df, name) for i, name in enumerate(names)},
        "bad_quantity": rules.bad_quantity,
        "bad_price": rules.bad_price,
        "negative_quantity": rules.negative_quantity,
        "negative_price": rules.negative_price,
        "zero_price": rules.zero_price,
        "invalid_rows": rules.invalid,
        "complete_rows": rules.complete,
        "totals_checked": rules.comparable,
        "totals_affected": rules.mismatch,
    }
    scan = numbered.agg(F.count("*").alias("rows_count"),
                        *[F.count_if(test).alias(name) for name, test in counters.items()])
    parts = [scan, duplicate_count(df, names)]
    if roles.has("product_id", "product_name"):
        parts.append(product_descriptions(df, roles))
    wanted = ["rows_count", *counters, "duplicate_rows", "codes_checked", "codes_affected"]
    return Assessment(
        _scored(_one_row(parts, wanted), names, roles), names, roles, _scored(_one_row([scan], wanted), names, roles)
    )


def _one_row(parts: list[DataFrame], wanted: list[str]) -> DataFrame:
    """One-row facts folded into one row; what no part holds is 0."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name in wanted:
        if name not in union.columns:
            union = union.withColumn(name, F.lit(0).cast("bigint"))
    return union.agg(*[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in wanted])


def _percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / whole


def _kept(affected: Column, whole: Column) -> Column:
    """Score of a share of affected records, NULL when nothing could be compared."""
    return F.when(whole > 0, F.round(100 * (1 - affected / whole), 2))


def _scored(facts: DataFrame, names: list[str], roles: Roles) -> DataFrame:
    """The counters with every derived score beside them."""
    rows = F.col("rows_count")
    has_rows = rows > 0
    missing = [F.col(f"missing_{i}") for i in range(len(names))]
    worst = F.array_max(F.array(*[
        F.struct(count.alias("count"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (count, name) in enumerate(zip(missing, names))
    ]))
    frame = (
        facts
        .withColumn("missing_values", reduce(lambda a, b: a + b, missing, F.lit(0)).cast("bigint"))
        .withColumns({
            "coverage": F.when(has_rows, 100 * (1 - F.col("missing_values") / (rows * len(names)))),
            "worst": F.when(F.col("missing_values") > 0, worst),
            "uniqueness": _kept(F.col("duplicate_rows"), rows),
        })
        .withColumn("worst_percent", F.when(
            has_rows, F.when(F.col("missing_values") > 0, _percent(F.col("worst.count"), rows)).otherwise(0.0)))
        .withColumn("penalty", F.least(
            F.lit(K.CONCENTRATION_CAP),
            F.lit(K.CONCENTRATION_WEIGHT)
            * F.greatest(F.lit(0.0), F.col("worst_percent") - (100 - F.col("coverage")))))
    )
    completeness = F.when(has_rows, F.round(F.greatest(F.lit(0.0), F.col("coverage") - F.col("penalty")), 2))

    if roles.has("quantity", "unit_price"):
        quantity, price = (names.index(roles.matches[r]) for r in ("quantity", "unit_price"))
        filled = (F.col(f"missing_{quantity}") < rows) | (F.col(f"missing_{price}") < rows)
        validity = F.when(filled, _kept(F.col("invalid_rows"), rows))
        validity_reason = F.when(
            filled,
            K.VALIDITY_CANCELLATION_REASON if checks_cancellations(roles) else K.VALIDITY_GENERIC_REASON,
        ).otherwise(K.VALIDITY_EMPTY_REASON)
    else:
        absent = ", ".join(r for r in ("quantity", "unit_price") if not roles.has(r))
        validity = F.lit(None).cast("double")
        validity_reason = F.lit(K.VALIDITY_MISSING_REASON.format(absent))

    product = _kept(F.col("codes_affected"), F.col("codes_checked"))
    totals = _kept(F.col("totals_affected"), F.col("totals_checked"))
    both = F.array_compact(F.array(product, totals))
    mean = F.round(F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(both), F.lit(0)), 2)
    concentrated = F.when(F.col("penalty") > 0, K.CONCENTRATED_REASON).otherwise(K.NOT_CONCENTRATED_REASON)
    return frame.withColumns({
        "completeness": completeness,
        "validity": validity,
        "product_score": product,
        "totals_score": totals,
        "consistency": mean,
        "reasons": F.struct(
            concentrated.alias("completeness"),
            F.lit(None).cast("string").alias("uniqueness"),
            validity_reason.alias("validity"),
            F.when(mean.isNull(), K.CONSISTENCY_MISSING_REASON)
            .otherwise(K.CONSISTENCY_REASON).alias("consistency"),
        ),
    })


def completeness(assessment: Assessment) -> DataFrame:
    return assessment.counted.select(
        "missing_values",
        F.round("coverage", 2).alias("cell_coverage_score"),
        F.col("worst.name").alias("worst_column"),
        F.round("worst_percent", 2).alias("worst_column_missing_percentage"),
        F.round("penalty", 2).alias("concentration_penalty"),
        F.col("completeness").alias("score"),
        F.col("reasons.completeness").alias("reason"),
    )


def uniqueness(assessment: Assessment) -> DataFrame:
    return assessment.scores.select("duplicate_rows", F.col("uniqueness").alias("score"))


def validity(assessment: Assessment) -> DataFrame:
    return assessment.counted.select(
        F.col("validity").alias("score"),
        "invalid_rows",
        F.col("bad_quantity").alias("malformed_quantity"),
        F.col("bad_price").alias("malformed_price"),
        "negative_quantity", "negative_price", "zero_price",
        F.col("complete_rows").alias("complete_input_rows"),
        F.round(_percent(F.col("complete_rows"), F.col("rows_count")), 2).alias("coverage_percentage"),
        F.lit(checks_cancellations(assessment.roles)).alias("cancellation_rule_evaluated"),
        F.col("reasons.validity").alias("reason"),
    )


def consistency_checks(assessment: Assessment) -> DataFrame:
    """One row per evaluated rule. The line total says whether discounted rows are left out, and which
    column's tax is added."""
    roles = assessment.roles
    product_columns = [roles.get("product_id"), roles.get("product_name")]
    total_columns = [roles.get(r) for r in ("quantity", "unit_price", "line_total")]
    checks = F.array(
        F.struct(
            F.lit("product_description").alias("rule"),
            F.col("product_score").alias("score"),
            F.col("codes_checked").alias("checked"),
            F.col("codes_affected").alias("affected"),
            F.lit(None).cast("double").alias("coverage_percentage"),
            F.lit(", ".join(map(str, product_columns))).alias("columns"),
            F.lit(None).cast("boolean").alias("discounted_rows_excluded"),
            F.lit(None).cast("string").alias("tax_amount_column"),
        ),
        F.struct(
            F.lit("line_total").alias("rule"),
            F.col("totals_score").alias("score"),
            F.col("totals_checked").alias("checked"),
            F.col("totals_affected").alias("affected"),
            F.round(_percent(F.col("totals_checked"), F.col("rows_count")), 2).alias("coverage_percentage"),
            F.lit(", ".join(map(str, total_columns))).alias("columns"),
            F.lit(roles.has("discount_applied")).alias("discounted_rows_excluded"),
            F.lit(roles.get("tax_amount")).cast("string").alias("tax_amount_column"),
        ),
    )
    return (
        assessment.scores.filter(F.col("rows_count") > 0)
        .select(F.inline(checks)).filter(F.col("score").isNotNull())
    )


def consistency(assessment: Assessment) -> DataFrame:
    return assessment.scores.select(
        F.col("consistency").alias("score"),
        F.when(F.col("codes_checked") > 0, F.col("codes_checked")).alias("checked_stock_codes"),
        F.when(F.col("codes_checked") > 0, F.col("codes_affected")).alias("inconsistent_stock_codes"),
        F.col("reasons.consistency").alias("reason"),
    )


def quality_dimensions(assessment: Assessment) -> DataFrame:
    """(ordinal, dimension, weight, score, status, reason), always four rows."""
    empty = F.col("rows_count") == 0
    dimensions = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("dimension"),
            F.lit(K.DIMENSION_WEIGHTS[name]).alias("weight"),
            F.col(name).alias("score"),
            F.when(F.col(name).isNull(), "not_evaluated").alias("status"),
            F.when(empty, K.NO_ROWS_REASON).otherwise(F.col(f"reasons.{name}")).alias("reason"),
        )
        for i, name in enumerate(K.DIMENSIONS, 1)
    ])
    return assessment.scores.select(F.inline(dimensions)).withColumn(
        "dimension_grade", grade(F.col("score"))
    )


def overall_quality(assessment: Assessment) -> DataFrame:
    """Half the weighted mean of the evaluated dimensions, half the lowest of them."""
    scores = [(name, F.col(name), F.lit(K.DIMENSION_WEIGHTS[name])) for name in K.DIMENSIONS]
    weighted = reduce(lambda a, b: a + b, [F.coalesce(s * w, F.lit(0.0)) for _, s, w in scores])
    weight = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), w).otherwise(0.0) for _, s, w in scores])
    lowest = F.array_min(F.array_compact(F.array(*[
        F.when(s.isNotNull(), F.struct(s.alias("score"), F.lit(i).alias("order"), F.lit(n).alias("name")))
        for i, (n, s, _) in enumerate(scores)
    ])))
    return (
        assessment.scores
        .withColumn("mean", weighted / F.nullif(weight, F.lit(0.0)))
        .withColumn("lowest", lowest)
        .withColumn("overall_quality_score", F.round(
            K.MEAN_SHARE * F.col("mean") + (1 - K.MEAN_SHARE) * F.col("lowest.score"), 2))
        .select(
            "rows_count",
            "overall_quality_score",
            grade(F.col("overall_quality_score")).alias("quality_grade"),
            F.round("mean", 2).alias("weighted_mean"),
            F.col("lowest.name").alias("limiting_dimension"),
            F.col("lowest.score").alias("limiting_dimension_score"),
        )
    )


def quality_issues(assessment: Assessment) -> DataFrame:
    """(ordinal, dimension, severity, column, affected, message) in rule order.

    Every possible issue is listed with its counter, its base and the two halves of its message;
    severity and text are then worked out once for those that affect something.
    """
    roles = assessment.roles
    # dimension, column, affected, base, message before and after the figure, figure, fixed severity
    issues: list[tuple] = [
        ("completeness", name, f"missing_{i}", "rows_count", f"{name}{K.MISSING_ISSUE[0]}", K.MISSING_ISSUE[1], "percent", None)
        for i, name in enumerate(assessment.names)
    ]
    issues.append(("uniqueness", None, "duplicate_rows", "rows_count", "", K.DUPLICATES_ISSUE, "count", None))
    if roles.has("quantity", "unit_price"):
        quantity, price = roles.matches["quantity"], roles.matches["unit_price"]
        issues += [
            ("validity", quantity, "negative_quantity", "rows_count", K.NEGATIVE_QUANTITY_ISSUE, "", None, None),
            ("validity", price, "negative_price", "rows_count", K.NEGATIVE_PRICE_ISSUE, "", None, None),
            *[("validity", column, count, "rows_count", f"{column}{K.MALFORMED_ISSUE[0]}",
               K.MALFORMED_ISSUE[1], "count", None)
              for column, count in ((quantity, "bad_quantity"), (price, "bad_price"))],
            ("validity", price, "zero_price", "rows_count", K.ZERO_PRICE_ISSUE, "", None, "info"),
        ]
    if roles.has("product_id", "product_name"):
        code, name = roles.matches["product_id"], roles.matches["product_name"]
        issues.append(("consistency", None, "codes_affected", "codes_checked",
                       K.DESCRIPTIONS_ISSUE.format(code, name), "", None, None))
    if roles.has("quantity", "unit_price", "line_total"):
        quantity, price, total = (roles.matches[r] for r in ("quantity", "unit_price", "line_total"))
        formula = f"{quantity} × {price}" + (" + tax" if roles.has("tax_amount") else "")
        issues.append(("consistency", total, "totals_affected", "totals_checked", "",
                       K.TOTALS_ISSUE.format(total, formula), "count", None))

    listed = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(dimension).alias("dimension"),
            F.lit(column).cast("string").alias("column_name"),
            F.col(counter).cast("bigint").alias("affected_records"), F.col(base).alias("whole"),
            F.lit(lead).alias("lead"), F.lit(tail).alias("tail"),
            F.lit(figure or "none").alias("figure"), F.lit(fixed).cast("string").alias("fixed"),
        )
        for i, (dimension, column, counter, base, lead, tail, figure, fixed) in enumerate(issues, 1)
    ])
    found = assessment.scores.select(F.inline(listed)).filter(F.col("affected_records") > 0)
    percent = _percent(F.col("affected_records"), F.col("whole"))
    shown = F.round(percent, 2)  # missing cells are judged by the rounded share, as it is shown
    figure = (
        F.when(F.col("figure") == "percent", percent_text(percent))
        .when(F.col("figure") == "count", F.col("affected_records").cast("string")).otherwise("")
    )
    judged = F.when(F.col("figure") == "percent", severity(shown)).otherwise(severity(percent))
    return found.select(
        "ordinal", "dimension", F.coalesce("fixed", judged).alias("severity"), "column_name", "affected_records",
        F.concat("lead", figure, "tail").alias("message"),
    )


def severity_rank(level: Column) -> Column:
    rank = F
    for i, name in enumerate(K.SEVERITY_ORDER):
        rank = rank.when(level == name, i)
    return rank.otherwise(len(K.SEVERITY_ORDER))


def ranked_issues(issues: DataFrame) -> DataFrame:
    """Most severe first, then most affected, then rule order."""
    return issues.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "severity_rank", F.col("affected_records").desc(), "ordinal"
    )


def invalid_rows(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """The invalid rows with the rules they break."""
    roles = roles or resolve_roles(data_columns(df))
    numbered = with_numbers(df, roles)
    rules = row_rules(numbered, roles)
    broken = F.array_compact(F.array(
        F.when(rules.negative_quantity, "negative_quantity"),
        F.when(rules.negative_price, "negative_price"),
        F.when(rules.bad_quantity, "malformed_quantity"),
        F.when(rules.bad_price, "malformed_price"),
    ))
    keep = [ROW_NUMBER] if ROW_NUMBER in df.columns else []
    return numbered.filter(rules.invalid).select(
        *keep, *[quoted(n) for n in data_columns(df)], F.concat_ws(", ", broken).alias("rules_broken")
    )


def line_total_mismatches(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Comparable rows whose total differs from its inputs beyond the tolerance."""
    roles = roles or resolve_roles(data_columns(df))
    numbered = with_numbers(df, roles)
    rules = row_rules(numbered, roles)
    if rules.expected is None:
        raise ValueError("Line totals need quantity, unit price and line total columns.")
    keep = [ROW_NUMBER] if ROW_NUMBER in df.columns else []
    return numbered.filter(rules.mismatch).select(
        *keep,
        rules.quantity.alias("quantity"), rules.price.alias("unit_price"),
        rules.total.alias("line_total"),
        F.round(rules.expected, 4).alias("expected_total"),
        F.round(rules.total - rules.expected, 4).alias("difference"),
    )
