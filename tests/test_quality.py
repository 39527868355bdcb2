"""Scores on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.names import Roles, is_identifier, resolve_roles, role_table
from plumbline.operators import quality as Q
from plumbline.operators import uniqueness as uniqueness_module
from plumbline.operators.uniqueness import duplicate_count, duplicate_rows, possible_repeats, row_hash

INF = float("inf")


def one(df):
    return df.first().asDict()


def issues(assessment):
    return [r.asDict() for r in Q.quality_issues(assessment).orderBy("ordinal").collect()]


def test_weights_are_renormalised(numbered):
    found = one(Q.overall_quality(Q.assess(numbered([(1.0,), (None,), (3.0,)], "Value double"))))
    assert found["weighted_mean"] == 81.82
    assert found["limiting_dimension"] == "completeness"
    assert found["overall_quality_score"] == 74.25


def test_nan_is_missing(numbered):
    found = one(Q.overall_quality(Q.assess(numbered([(1.0,), (float("nan"),), (3.0,)], "Value double"))))
    assert found["overall_quality_score"] == 74.25


def test_concentrated_missing(numbered):
    table = numbered([(1, 10), (2, 11), (3, 12), (4, None)], "`Order` bigint, CustomerID bigint")
    assessment = Q.assess(table)
    found = one(Q.completeness(assessment))
    assert (found["cell_coverage_score"], found["worst_column"], found["worst_column_missing_percentage"],
            found["concentration_penalty"], found["score"]) == (87.5, "CustomerID", 25.0, 7.5, 80.0)
    overall = one(Q.overall_quality(assessment))
    assert (overall["weighted_mean"], overall["overall_quality_score"]) == (89.09, 84.55)
    assert issues(assessment)[0]["message"] == "CustomerID is missing in 25.0% of records."


def test_penalty_is_capped(numbered):
    table = numbered([(i, None) for i in range(4)], "`Order` bigint, OptionalField double")
    found = one(Q.completeness(Q.assess(table)))
    assert (found["cell_coverage_score"], found["concentration_penalty"], found["score"]) == (50.0, 15.0, 35.0)


def test_weak_uniqueness(numbered):
    found = one(Q.overall_quality(Q.assess(numbered([(1,), (1,), (1,), (2,)], "Value bigint"))))
    assert (found["weighted_mean"], found["limiting_dimension_score"], found["overall_quality_score"]) == (
        77.27, 50.0, 63.64)


def test_malformed_numbers(numbered):
    table = numbered([("A1", "bad", "x"), ("A2", "1", "2")], "InvoiceNo string, Quantity string, UnitPrice string")
    assessment = Q.assess(table)
    found = one(Q.validity(assessment))
    assert (found["invalid_rows"], found["score"]) == (1, 50.0)
    assert {i["column_name"] for i in issues(assessment) if i["dimension"] == "validity"} == {"Quantity", "UnitPrice"}


def test_infinite_numbers_are_invalid(numbered):
    table = numbered([("A1", INF, 2), ("A2", 1.0, 2)], "InvoiceNo string, Quantity double, UnitPrice bigint")
    assert one(Q.validity(Q.assess(table)))["score"] == 50.0


def test_missing_invoice_carries_no_marker(numbered):
    table = numbered([(None, -1, 2), ("C1", -1, 2), ("1", 1, 2)], "InvoiceNo string, Quantity bigint, UnitPrice bigint")
    assert one(Q.validity(Q.assess(table)))["negative_quantity"] == 1


def test_negative_quantity_needs_the_literal_header(numbered):
    table = numbered([("A", -1, 2)], "`Invoice Number` string, Quantity bigint, UnitPrice bigint")
    found = one(Q.validity(Q.assess(table)))
    assert (found["negative_quantity"], found["cancellation_rule_evaluated"], found["score"]) == (0, False, 100.0)


def test_nothing_to_compare_is_not_evaluated(numbered):
    table = numbered([(None, None)], "StockCode string, Description string")
    rows = {r["dimension"]: r for r in Q.quality_dimensions(Q.assess(table)).collect()}
    assert rows["consistency"]["score"] is None and rows["consistency"]["status"] == "not_evaluated"


def test_empty_quantity_and_price(numbered):
    table = numbered([(None, None), (None, None)], "Quantity double, UnitPrice double")
    rows = {r["dimension"]: r for r in Q.quality_dimensions(Q.assess(table)).collect()}
    assert rows["validity"]["reason"] == "Quantity and unit price contain no values to validate."


def test_header_only_table(numbered):
    assessment = Q.assess(numbered([], "Quantity double, UnitPrice double"))
    rows = Q.quality_dimensions(assessment).collect()
    assert len(rows) == 4
    assert all(r["score"] is None and r["reason"] == "The dataset has no data rows." for r in rows)
    assert one(Q.overall_quality(assessment))["overall_quality_score"] is None
    assert issues(assessment) == []


def test_ambiguous_headers():
    roles = resolve_roles(["Price Per Unit", "Unit Price", "Qty", "Total Spent"])
    assert roles.get("quantity") == "Qty"
    assert "unit_price" not in roles.matches
    assert roles.ambiguous["unit_price"] == ["Price Per Unit", "Unit Price"]


def test_role_table_matches_the_driver_rules(spark):
    headers = ["Price Per Unit", "Unit Price", "Qty", "Total Spent", "Snowfall", "InvoiceNo"]
    frame = spark.createDataFrame([("t", i, h) for i, h in enumerate(headers)],
                                  "table_name string, ordinal int, column_name string")
    found = {r["role"]: (r["status"], list(r["columns"])) for r in role_table(frame).collect()}
    roles = resolve_roles(headers)
    assert found == {**{r: ("matched", [c]) for r, c in roles.matches.items()},
                     **{r: ("ambiguous", c) for r, c in roles.ambiguous.items()}}


def test_alternate_headers(numbered):
    table = numbered(
        [("1", 10, 2, 20, False), ("2", -2, 1, -2, False), ("3", 3, -1, 4, False)],
        "`Transaction ID` string, `Price Per Unit` bigint, Quantity bigint, `Total Spent` bigint, "
        "`Discount Applied` boolean")
    assessment = Q.assess(table)
    found = one(Q.validity(assessment))
    assert (found["invalid_rows"], found["complete_input_rows"], found["coverage_percentage"]) == (1, 3, 100.0)
    check = one(Q.consistency_checks(assessment))
    assert (check["rule"], check["checked"], check["affected"]) == ("line_total", 3, 1)
    assert (check["discounted_rows_excluded"], check["tax_amount_column"]) == (True, None)


def test_tax_and_discount(numbered):
    table = numbered(
        [("1", 10, 2, 1, 21, False), ("2", 10, 2, 1, 18, True)],
        "`Invoice ID` string, `Unit price` bigint, Quantity bigint, `Tax 5%` bigint, Total bigint, "
        "`Discount Applied` boolean")
    check = one(Q.consistency_checks(Q.assess(table)))
    assert (check["checked"], check["affected"], check["coverage_percentage"]) == (1, 0, 50.0)
    assert (check["discounted_rows_excluded"], check["tax_amount_column"]) == (True, "Tax 5%")


def test_float_discount_flags_exclude_every_row(numbered):
    table = numbered([(10, 2, 20, 0.0)], "UnitPrice bigint, Quantity bigint, Total bigint, `Is Discounted` double")
    assert Q.consistency_checks(Q.assess(table)).count() == 0


def test_identifier_words():
    assert [n for n in ("Snowfall", "CustomerID", "IDNumber", "o_orderkey", "user_id", "Order No", "Invoice-Code")
            if is_identifier(n)] == ["CustomerID", "user_id", "Order No", "Invoice-Code"]


def test_severity_ranking(numbered):
    rows = [("1", "-1", "0"), ("2", "x", "-3"), ("3", None, "4"), ("4", "1", "5")]
    ranked = Q.ranked_issues(Q.quality_issues(Q.assess(numbered(
        rows, "InvoiceNo string, Quantity string, UnitPrice string")))).collect()
    keys = [(r["severity_rank"], -r["affected_records"], r["ordinal"]) for r in ranked]
    assert keys == sorted(keys)
    assert ranked[-1]["severity"] == "info"


def test_duplicates_with_missing_cells(numbered):
    rows = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("a", None, float("nan")), ("a", None, None),
            ("a", None, 1.0)]
    table = numbered(rows, "x string, y string, z double")
    assert duplicate_count(table).first()[0] == 3
    assert sorted(r["row_number"] for r in duplicate_rows(table).collect()) == [3, 5, 6]


@pytest.mark.parametrize("partitions", [1, 7])
def test_hot_group_of_copies(numbered, partitions):
    rows = [("hot", 1)] * 500 + [(f"v{i}", i) for i in range(700)]
    table = numbered(rows, "name string, n bigint", partitions)
    assert duplicate_count(table).first()[0] == 499
    assert duplicate_rows(table).count() == 499
    assert duplicate_rows(table).agg({"row_number": "min"}).first()[0] == 2


def test_roles_need_exactly_one_header():
    assert Roles().has("quantity") is False


def test_duplicates_leave_the_scan_through_a_filter(numbered):
    rng = random.Random(4)
    rows = [(rng.randrange(10**9), rng.choice([None, "a", "b"]), rng.choice([0.0, -0.0, float("nan"), None])) for _ in range(4_000)]
    rows += [rng.choice(rows) for _ in range(300)] + [rows[0]] * 200
    table = numbered(rows, "N bigint, S string, X double", 7)
    wanted, seen = [], set()
    for i, (n, s, x) in enumerate(rows, 1):
        key = (n, s, None if x is None or x != x else abs(x))
        wanted += [i] if key in seen else []
        seen.add(key)
    assert sorted(r["row_number"] for r in duplicate_rows(table).collect()) == wanted
    assert duplicate_count(table).first()[0] == len(wanted)
    possible = possible_repeats(table)
    copied = table.select(row_hash(table, ["N", "S", "X"]).alias("h")).groupBy("h").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert copied <= possible.count() <= copied + 0.02 * len(rows)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (possible, table)]
    assert plans[0].count("Exchange hashpartitioning") == plans[1].count("Exchange hashpartitioning")
    assert "BroadcastNestedLoopJoin" in plans[0]


@pytest.mark.parametrize("words", [1, 2])
def test_a_filter_that_is_too_small_loses_nothing(numbered, monkeypatch, words):
    monkeypatch.setattr(uniqueness_module, "MOST_WORDS", words)
    rows = [(i % 700, "x") for i in range(1_500)]
    table = numbered(rows, "N bigint, S string", 4)
    assert sorted(r["row_number"] for r in duplicate_rows(table).collect()) == list(range(701, 1_501))


def test_tables_without_repeats(numbered):
    assert duplicate_rows(numbered([(i,) for i in range(50)], "N bigint")).count() == 0
    assert duplicate_rows(numbered([], "N bigint")).count() == 0


def test_results_of_the_scan_do_not_count_duplicates(numbered, capsys):
    """Duplicate rows are counted in Python tasks, which Spark does not leave out by itself."""
    df = numbered([("1", "A", "2", 1.0), ("1", "A", "2", 1.0), ("2", None, "x", -1.0)],
                  "InvoiceNo string, StockCode string, Quantity string, UnitPrice double")
    assessment = Q.assess(df)
    for result in (Q.validity, Q.completeness):
        capsys.readouterr()
        result(assessment).explain()
        assert "MapInArrow" not in capsys.readouterr().out
        assert result(assessment).collect() == result(assessment.pinned()).collect()
    assert Q.uniqueness(assessment).first()["duplicate_rows"] == 1
