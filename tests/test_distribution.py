"""Counts are conserved, periods are filled, extremes stay finite."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import distribution as D
from plumbline.operators.profile import column_missing


def total(df):
    return df.agg(F.sum("value_count")).first()[0]


def test_tails_are_conserved(numbered):
    rows = [(float(i),) for i in range(1, 101)] + [(1000.0,), (float("inf"),), (None,)]
    table = numbered(rows, "Amount double")
    usable = D.numeric_usability(table, ["Amount"]).first()
    assert (usable["rows_count"], usable["missing_count"], usable["usable_count"],
            usable["excluded_nonfinite_count"]) == (103, 1, 101, 1)
    full, central = D.full_histogram(table, "Amount"), D.central_histogram(table, "Amount")
    assert total(full) == 101 and full.count() == 24
    assert total(central) + central.first()["outside_central_count"] == 101
    assert central.first()["maximum"] == 1000.0


def test_extreme_doubles(numbered):
    table = numbered([(-1e308,), (-1e307,), (1e307,), (1e308,)], "Amount double")
    bins = D.full_histogram(table, "Amount").orderBy("bin").collect()
    assert bins[0]["lower_edge"] == -1e308 and bins[-1]["upper_edge"] == 1e308
    assert sum(b["value_count"] for b in bins) == 4


@pytest.mark.parametrize("value, edges", [(10.0, (9.5, 10.0)), (200.0, (198.0, 200.0)), (0.0, (0.0, 0.5)),
                                          (-4.0, (-4.0, -3.5))])
def test_constant_column(numbered, value, edges):
    only = D.full_histogram(numbered([(value,)] * 3, "Amount double"), "Amount").collect()
    assert [(r["lower_edge"], r["upper_edge"], r["value_count"]) for r in only] == [(*edges, 3)]


def test_values_on_edges_go_right(numbered):
    table = numbered([(float(i),) for i in range(25)], "Amount double")
    bins = D.full_histogram(table, "Amount").orderBy("bin").collect()
    assert [b["value_count"] for b in bins] == [1] * 23 + [2]


def test_top_and_other(numbered):
    table = numbered([(f"g{i:02d}",) for i in range(14) for _ in range(10)], "Grp string")
    found = D.category_top_other(table, "Grp").collect()
    groups = [r for r in found if r["position"]]
    assert len(groups) == 12 and sum(r["value_count"] for r in groups) == 120
    assert [r["value_count"] for r in found if not r["position"]] == [20]
    assert D.category_share(table, "Grp").count() == 0


def test_share(numbered):
    table = numbered([("a",), ("a",), ("b",), ("c",)], "Grp string")
    found = {r["value"]: r["share"] for r in D.category_share(table, "Grp").collect()}
    assert found == {"a": 50.0, "b": 25.0, "c": 25.0}


def test_binary_is_discrete(numbered):
    table = numbered([(i % 5 // 3,) for i in range(50)], "Survived bigint")
    kind, found = D.summarize_column(table, "Survived")
    assert kind == "discrete"
    assert [(r["label"], r["value_count"]) for r in found.collect()] == [("0", 30), ("1", 20)]


def test_few_rows_are_a_histogram(numbered):
    assert D.distribution_kind(numbered([(i % 2,) for i in range(19)], "V bigint"), "V") == "histogram"


def test_empty_month_is_zero(numbered):
    table = numbered([("2025-01-01",), ("2025-03-01",)], "RecordedAt string")
    kind, found = D.summarize_column(table, "RecordedAt")
    assert kind == "time"
    assert [(r["period"], r["value_count"]) for r in found.orderBy("period").collect()] == [
        ("2025-01", 1), ("2025-02", 0), ("2025-03", 1)]


def test_long_spans_are_years(numbered):
    table = numbered([("2019-05-01",), ("2023-01-01",), ("2023-02-01",)], "Day string")
    found = D.time_buckets(table, "Day").orderBy("period").collect()
    assert [(r["period"], r["value_count"]) for r in found] == [
        ("2019", 1), ("2020", 0), ("2021", 0), ("2022", 0), ("2023", 2)]


def test_text_and_unknown_columns(numbered):
    table = numbered([(f"word {i}", i) for i in range(200)], "Note string, UserID bigint")
    assert D.summarize_column(table, "Note") == (None, None)
    status = {r["column_name"]: r["reason"] for r in
              D.distribution_status(table, {"Note": "text", "UserID": "identifier"}).collect()}
    assert set(status.values()) == {"Identifier and free-text fields are not summarized as distributions."}
    with pytest.raises(ValueError):
        D.full_histogram(table, "Nothing")


def test_missing_ranking(numbered):
    table = numbered([(None, 1, None)] + [(1, 1, None)] * 9, "a bigint, b bigint, c bigint")
    found = D.missing_ranking(column_missing(table)).collect()
    assert [(r["column_name"], r["missing_percentage"], r["band"]) for r in found] == [
        ("c", 100.0, "high"), ("a", 10.0, "medium")]
