"""A second table with known faults: tax, discounts, infinities, a constant field, two headers for one role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import constants as K
from plumbline.functions.names import role_table
from plumbline.functions.scalars import says_no_discount
from plumbline.operators import anomaly, distribution, profile, quality
from plumbline.plans.retail import table
from plumbline.plans.sql import IDENTIFIER, NUMBER_KINDS, column_facts, roles_of
from plumbline.sources.rows import stored_by
from plumbline.sources.storage import store_once

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
READ = [*KEYS, "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
NUMBERS = ["Qty", "Unit price", "Tax 5%", "Total", "Rate", "Flat"]


def ledger_columns() -> list[Column]:
    """Order lines with their tax; some discounted, some with wrong totals, some rates not finite."""
    price, order = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_orderkey")
    tax = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax") * F.col("l_extendedprice"))
    return [
        order.alias("Order Key"), F.col("l_linenumber").alias("Line"), F.col("l_partkey").alias("Part Key"),
        F.concat(F.lit("L"), order.cast("string")).alias("Invoice ID"),
        F.when(order % 50 == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("Qty"),
        price.alias("Unit price"),
        tax.alias("Tax 5%"),
        F.when(F.col("l_discount") == 0, "No").when(F.col("l_discount") < 0.05, " FALSE ").otherwise("Yes").alias("Discount Applied"),
        (F.col("l_quantity") * price + F.coalesce(tax, F.lit(0.0)) + F.when(F.col("l_suppkey") % 50 == 3, 9.0).otherwise(0.0)).alias("Total"),
        F.when(order % 100 == 1, F.lit(float("inf"))).when(order % 100 == 2, F.lit(float("-inf")))
        .when(order % 100 != 3, F.col("l_discount")).alias("Rate"),
        F.lit(1.5).alias("Flat"),
        (F.col("l_returnflag") == "R").alias("Returned"),
        F.col("l_linestatus").alias("Status"),
    ]


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger without row numbers, worked out of the order lines where they are read: each pass over it
    reads the columns it asks for, and nothing is exchanged or stored first."""
    return table(spark, sf_dir, "lineitem").select(*ledger_columns())


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows numbered and stored, for what needs a row's number."""
    return store_once(spark, f"ledger{sf_dir}", lambda: stored_by(
        table(spark, sf_dir, "lineitem").select(*READ), KEYS, "ledger", columns=ledger_columns()))


def ledger_totals(spark, sf):
    """The total check with tax and discounts."""
    checks = quality.consistency_checks(quality.assess(ledger_table(spark, sf)))
    return checks.filter(F.col("rule") == "line_total")


def ledger_no_discount(spark, sf):
    return ledger_table(spark, sf).select(
        "Order Key", "Line", "Part Key", says_no_discount(F.col("Discount Applied")).alias("no_discount")
    )


def ledger_numbers(spark, sf):
    """Summaries of a column with infinities and of a constant one, beside ordinary ones."""
    found = profile.numeric_summary(ledger_table(spark, sf), NUMBERS)
    measures = ("mean", "std", "minimum", "q25", "q50", "q75", "maximum")
    return found.withColumns({m: F.round(m, 4) for m in measures})


def ledger_usability(spark, sf):
    return distribution.numeric_usability(ledger_table(spark, sf), NUMBERS)


def ledger_booleans(spark, sf):
    return profile.boolean_summary(ledger_table(spark, sf), ["Returned"])


def ledger_bounds(spark, sf):
    """Bounds, and the reasons where a field has none."""
    df = ledger_table(spark, sf)
    fields = anomaly.numeric_fields(df)
    found = anomaly.bounds_table(df, anomaly.anomaly_bounds(df, anomaly.field_stats(df, fields)))
    return found.select("method", "field", "status", "reason", "evaluated_rows")


def ledger_kinds(spark, sf):
    """Which distribution fits each column, over whole columns."""
    df = ledger_table(spark, sf)
    types = profile.logical_types(df)
    kinds = [(name, kind, distribution.distribution_kind(df, name, kind)) for name, kind in types.items()]
    return spark.createDataFrame(kinds, "column_name string, logical_type string, kind string")


def ledger_summary(spark, sf):
    """``summarize_column`` of a numeric column with few values, and of a categorical one."""
    df = ledger_table(spark, sf)
    parts = []
    for name in ("Qty", "Status"):
        kind, found = distribution.summarize_column(df, name)
        label = F.col("label") if kind == "discrete" else F.col("value").cast("string")
        if kind == "histogram":
            found, label = found.filter("range = 'full'"), F.col("bin").cast("string")
        parts.append(found.select(F.lit(name).alias("column_name"), F.lit(kind).alias("kind"), label.alias("label"), "value_count"))
    return reduce(DataFrame.unionByName, parts)


def ledger_roles(spark, sf):
    """Roles of the ledger's filled columns, and of the same with a second price column."""
    df = ledger_table(spark, sf)
    two_prices = df.withColumn("Price Per Unit", F.col("`Unit price`"))
    parts = [profile.column_missing(t).withColumn("table_name", F.lit(name)) for name, t in (("ledger", df), ("ledger_two_prices", two_prices))]
    filled = reduce(DataFrame.unionByName, parts).filter(F.col("missing_count") < F.col("rows_count"))
    return role_table(filled).select("table_name", "role", "status", F.array_join("columns", ", ").alias("columns"))


def texts_only_methods(spark, sf):
    """A table without number fields: no method is evaluated, and each says why."""
    df = stored_ledger(spark, sf).select("row_number", "Invoice ID", "Discount Applied", "Status")
    return anomaly.method_counts(anomaly.review(df))


def schema_probe(spark, sf):
    """Every header of three tables asked of each of them: refused, or scanned alone and counted."""
    tables = {"orders": table(spark, sf, "orders"), "documents": table(spark, sf, "documents"), "ledger": ledger_table(spark, sf)}
    asked = sorted({name for df in tables.values() for name in df.columns})
    parts = []
    for name, df in tables.items():
        for column in asked:
            try:
                distribution.require_column(df, column)
                counted = df.agg(F.count(F.col(f"`{column}`")).alias("value_count"))
            except ValueError:
                counted = df.limit(0).agg(F.lit(None).cast("bigint").alias("value_count"))
            parts.append(counted.select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                F.col("value_count").isNotNull().alias("accepted"), "value_count",
            ))
    return reduce(DataFrame.unionAll, parts)


QUERIES = [
    ledger_totals, ledger_no_discount, ledger_numbers, ledger_usability, ledger_booleans, ledger_bounds, ledger_kinds,
    ledger_summary, ledger_roles, texts_only_methods, schema_probe,
]

LEDGER = """
ledger AS (
  SELECT row_number() OVER (ORDER BY "Order Key", "Line", "Part Key") AS row_number, * FROM (
    SELECT l_orderkey AS "Order Key", l_linenumber AS "Line", l_partkey AS "Part Key", concat('L', l_orderkey) AS "Invoice ID",
      CASE WHEN l_orderkey % 50 = 7 THEN NULL ELSE l_quantity END AS "Qty", l_extendedprice / l_quantity AS "Unit price",
      CASE WHEN l_linenumber % 5 <> 0 THEN l_tax * l_extendedprice END AS "Tax 5%",
      CASE WHEN l_discount = 0 THEN 'No' WHEN l_discount < 0.05 THEN ' FALSE ' ELSE 'Yes' END AS "Discount Applied",
      l_quantity * (l_extendedprice / l_quantity) + coalesce(CASE WHEN l_linenumber % 5 <> 0 THEN l_tax * l_extendedprice END, 0.0)
        + CASE WHEN l_suppkey % 50 = 3 THEN CAST(9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS "Total",
      CASE WHEN l_orderkey % 100 = 1 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 100 = 2 THEN CAST('-inf' AS DOUBLE)
           WHEN l_orderkey % 100 <> 3 THEN l_discount END AS "Rate",
      CAST(1.5 AS DOUBLE) AS "Flat", l_returnflag = 'R' AS "Returned", l_linestatus AS "Status"
    FROM lineitem))
"""


LEDGER_DATA = "(SELECT * EXCLUDE (row_number) FROM ledger)"
LEDGER_HEADERS = ["Order Key", "Line", "Part Key", "Invoice ID", "Qty", "Unit price", "Tax 5%", "Discount Applied", "Total", "Rate",
                  "Flat", "Returned", "Status"]


def _ledger(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([LEDGER.strip(), *ctes]) + "\n" + body


def _each(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(name=n, v=f'try_cast("{n}" AS DOUBLE)') for n in names)


# An infinite quantile or moment is no figure: NULL. Ranks are taken over finite and infinite values alike.
_QUARTILE = (
    "(SELECT CASE WHEN isfinite(q) THEN round(q, 4) END FROM (SELECT CASE WHEN lo = hi OR share = 0 THEN lo ELSE lo + (hi - lo) * share END AS q FROM "
    "(SELECT s[CAST(floor(p) AS INT) + 1] AS lo, s[CAST(ceil(p) AS INT) + 1] AS hi, p - floor(p) AS share FROM "
    "(SELECT list_sort(list({{v}})) AS s, {share} * (count({{v}}) - 1) AS p FROM ledger WHERE {{v}} IS NOT NULL))))"
)
SQL = {
    "ledger_totals": _ledger(
        """SELECT 'line_total' AS rule, round(100 * (1 - affected / checked), 2) AS score, checked, affected,
  round(100.0 * checked / n + 1e-9, 2) AS coverage_percentage, 'Qty, Unit price, Total' AS columns,
  true AS discounted_rows_excluded, 'Tax 5%' AS tax_amount_column
FROM (SELECT count(*) AS n, count(*) FILTER (comparable) AS checked, count(*) FILTER (comparable AND
        abs("Total" - ("Qty" * "Unit price" + "Tax 5%")) > greatest(0.02, 0.001 * abs("Total"))) AS affected
      FROM (SELECT *, "Qty" IS NOT NULL AND "Tax 5%" IS NOT NULL AND lower(trim("Discount Applied")) IN ('false', '0', 'no') AS comparable FROM ledger))"""),
    "ledger_no_discount": _ledger("""SELECT "Order Key", "Line", "Part Key", lower(trim("Discount Applied")) IN ('false', '0', 'no') AS no_discount FROM ledger"""),
    "ledger_numbers": _ledger(_each(
        """SELECT o.ordinal, '{name}' AS column_name, n AS value_count, CASE WHEN infinite = 0 THEN round(mean, 4) END AS mean,
  CASE WHEN infinite = 0 THEN round(sqrt(squares / (n - 1)), 4) END AS std, CASE WHEN isfinite(low) THEN round(low, 4) END AS minimum, """
        + f"{_QUARTILE.format(share='0.25')} AS q25, {_QUARTILE.format(share='0.5')} AS q50, {_QUARTILE.format(share='0.75')} AS q75, "
        """CASE WHEN isfinite(high) THEN round(high, 4) END AS maximum
FROM (SELECT count({v}) AS n, count(*) FILTER (isinf({v})) AS infinite, min({v}) AS low, max({v}) AS high,
        avg(CASE WHEN isfinite({v}) THEN {v} END) AS mean FROM ledger) a,
  (SELECT sum(power(CASE WHEN isfinite({v}) THEN {v} END - (SELECT avg({v}) FROM ledger WHERE isfinite({v})), 2)) AS squares FROM ledger) b,
  (SELECT CAST(list_position(['Order Key', 'Line', 'Part Key', 'Invoice ID', 'Qty', 'Unit price', 'Tax 5%', 'Discount Applied', 'Total', 'Rate', 'Flat'], '{name}') AS INT) AS ordinal) o""",
        NUMBERS)),
    "ledger_usability": _ledger(_each(
        """SELECT '{name}' AS column_name, count(*) AS rows_count, count(*) - count({v}) AS missing_count,
  count(*) FILTER (isfinite({v})) AS usable_count, count(*) FILTER (isinf({v})) AS excluded_nonfinite_count FROM ledger""", NUMBERS)),
    "ledger_booleans": _ledger(
        """SELECT any_value(place) AS ordinal, 'Returned' AS column_name, count("Returned") AS value_count, count(DISTINCT "Returned") AS unique_count,
  CASE WHEN count(*) FILTER ("Returned") > count(*) FILTER (NOT "Returned") THEN 'true' ELSE 'false' END AS top_value,
  greatest(count(*) FILTER ("Returned"), count(*) FILTER (NOT "Returned")) AS frequency FROM ledger, ("""
        + f"SELECT ordinal AS place FROM ({column_facts('ledger', LEDGER_DATA)}) WHERE column_name = 'Returned')"),
    "ledger_bounds": _ledger(_each(
        """SELECT m.method, '{name}' AS field, CASE WHEN low < high THEN 'evaluated' ELSE 'not_evaluated' END AS status,
  CASE WHEN low < high THEN NULL ELSE 'At least four finite values and two distinct values are required.' END AS reason,
  CASE WHEN low < high THEN n END AS evaluated_rows
FROM (SELECT count(*) FILTER (isfinite({v})) AS n, min({v}) FILTER (isfinite({v})) AS low, max({v}) FILTER (isfinite({v})) AS high FROM ledger),
  (VALUES ('iqr'), ('z_score')) m(method)""", ["Order Key", "Line", "Part Key", *NUMBERS])),
    "ledger_kinds": _ledger("SELECT column_name, logical_type, CASE logical_type WHEN 'numeric' THEN CASE WHEN figures <= 12 AND finite >= 20 "
        "THEN 'discrete' ELSE 'histogram' END WHEN 'datetime' THEN 'time' WHEN 'categorical' THEN 'category' END AS kind FROM (SELECT *, "
        f"CASE WHEN {IDENTIFIER} THEN 'identifier' WHEN kind IN {NUMBER_KINDS} OR kind = 'BOOLEAN' THEN 'numeric' "
        "WHEN unique_count <= 50 OR unique_count / rows_count <= 0.05 THEN 'categorical' ELSE 'text' END AS logical_type FROM ("
        + _each("""SELECT '{name}' AS column_name, count(*) AS rows_count, any_value(typeof("{name}")) AS kind, count(DISTINCT "{name}") AS unique_count,
  count(DISTINCT CASE WHEN isfinite({v}) THEN {v} END) AS figures, count(*) FILTER (isfinite({v})) AS finite FROM ledger""", LEDGER_HEADERS)
        + "))"),
    "ledger_summary": _ledger(
        """SELECT 'Qty' AS column_name, 'histogram' AS kind, CAST(b.bin AS VARCHAR) AS label, count(x.bin) AS value_count
FROM range(1, 25) b(bin) LEFT JOIN (
  SELECT CASE WHEN s < e[g + 1] THEN g ELSE CASE WHEN g < 23 AND s >= e[g + 2] THEN g + 2 ELSE g + 1 END END AS bin FROM (
    SELECT "Qty" / high AS s, CAST(least(floor(("Qty" / high - low / high) / (1.0 - low / high) * 24), 23) AS INT) AS g,
      list_transform(range(0, 25), lambda i: CASE WHEN i = 24 THEN CAST(1.0 AS DOUBLE) ELSE i * ((1.0 - low / high) / 24) + low / high END) AS e
    FROM ledger, (SELECT min("Qty") AS low, max("Qty") AS high FROM ledger) WHERE "Qty" IS NOT NULL)) x ON x.bin = b.bin GROUP BY b.bin
UNION ALL SELECT 'Status', 'category', "Status", count(*) FROM ledger GROUP BY "Status" """),
    "ledger_roles": _ledger(roles_of("(" + column_facts("ledger", LEDGER_DATA) + " UNION ALL " + column_facts(
        "ledger_two_prices", """(SELECT * EXCLUDE (row_number), "Unit price" AS "Price Per Unit" FROM ledger)""") + ")")),
    "texts_only_methods": """
SELECT CAST(ordinal AS INT) AS ordinal, method, '' AS field, 'not_evaluated' AS status, reason, CAST(NULL AS BIGINT) AS evaluated_rows,
  CAST(NULL AS BIGINT) AS flagged_rows, CAST(NULL AS BIGINT) AS training_rows, CAST(NULL AS DOUBLE) AS contamination
FROM (VALUES (1, 'iqr', 'No usable fields'), (2, 'z_score', 'No usable fields'), (3, 'isolation_forest', 'GATE')) v(ordinal, method, reason)
""".replace("GATE", K.FOREST_GATE_REASON.replace("'", "''")),
    "schema_probe": _ledger("SELECT t.table_name, a.column_name, f.filled IS NOT NULL AS accepted, f.filled AS value_count FROM "
        "(SELECT DISTINCT column_name FROM facts) a CROSS JOIN (SELECT DISTINCT table_name FROM facts) t LEFT JOIN facts f "
        "ON f.table_name = t.table_name AND f.column_name = a.column_name", "facts AS (" + " UNION ALL ".join([
            column_facts("orders", "orders"), column_facts("documents", "documents"), column_facts("ledger", LEDGER_DATA)]) + ")"),
}
