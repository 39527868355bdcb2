"""Flags, votes, queue, pages, readings and the forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomaly as A, explain as E, forest as FR


@pytest.fixture
def planted(numbered):
    rows = [(f"{i}", 1000 + i, 10 + i % 3, 5 + i % 2) for i in range(1, 30)] + [("C30", 1030, -1000, 500)]
    return numbered(rows, "InvoiceNo string, CustomerID bigint, Quantity bigint, UnitPrice bigint")


def test_planted_outlier(planted):
    found = A.review(planted)
    assert found.fields == ["Quantity", "UnitPrice"]
    first = A.anomaly_queue(found).first()
    assert first["row_number"] == 30 and "iqr:Quantity" in first["signals"] and "isolation_forest" in first["signals"]
    assert first["votes"] == len(first["signals"])
    explained = E.explain_row(found, 30).first()
    assert explained["status"] == "flagged" and explained["invoice_number"] == "C30"
    assert explained["interpretation"]["category"] == "possible_legitimate_return"
    assert len(explained["evidence"]) == len(first["signals"])
    context = A.retail_context(found).first()
    assert tuple(context) == (1, 0)


def test_pages_partition_the_queue(numbered):
    rows = [(10 + i % 3, 20 + i % 4) for i in range(28)] + [(500, 1), (600, 900), (-400, 800)]
    found = A.review(numbered(rows, "Quantity bigint, UnitPrice bigint"))
    queue = [r["row_number"] for r in A.anomaly_queue(found).collect()]
    first = A.anomaly_page(found, 0, 2).collect()
    second = A.anomaly_page(found, 2, 100).collect()
    assert [r["row_number"] for r in first + second] == queue
    assert first[0]["next_offset"] == 2 and second[0]["next_offset"] is None
    with pytest.raises(ValueError):
        A.anomaly_page(found, 0, 101)


def test_pages_are_ranges_of_the_queue(numbered):
    rows = [(10 + i % 3, 20 + i % 4) for i in range(40)] + [(500 + i, 900 - i) for i in range(6)]
    found = A.review(numbered(rows, "Quantity bigint, UnitPrice bigint"))
    whole = [r["row_number"] for r in A.anomaly_queue(found).collect()]
    page = A.anomaly_page(found, 2, 3).collect()
    assert [r["row_number"] for r in page] == whole[2:5] and A.POSITION not in page[0]


def test_readings(numbered):
    rows = [("C1", -10, 2), ("A2", -10, 2), ("A3", 1, -1), ("A4", 1, 0)]
    found = A.review(numbered(rows, "InvoiceNo string, Quantity bigint, UnitPrice bigint"))
    readings = [r["category"] for r in E.row_interpretation(found).orderBy("row_number").collect()]
    assert readings == ["possible_legitimate_return", "possible_data_quality_issue", "possible_data_quality_issue",
                        "needs_business_review"]


def test_one_field_has_no_forest(numbered):
    found = A.review(numbered([(i,) for i in range(30)], "Snowfall bigint"))
    counts = {r["method"]: r for r in A.method_counts(found).collect()}
    assert found.forest is None and counts["isolation_forest"]["status"] == "not_evaluated"
    assert counts["iqr"]["status"] == "evaluated"


def test_no_numeric_field(numbered):
    found = A.review(numbered([("a",), ("b",), ("c",)], "Category string"))
    assert not found.evaluated
    assert A.anomaly_summary(found).first()["anomaly_rows_count"] is None
    counts = {r["method"]: (r["status"], r["field"], r["reason"]) for r in A.method_counts(found).collect()}
    assert set(counts) == {"iqr", "z_score", "isolation_forest"}
    assert counts["iqr"] == ("not_evaluated", "", "No usable fields")
    explained = E.explain_row(found, 2).first()
    assert explained["status"] == "not_evaluated" and explained["interpretation"]["category"] == "not_evaluated"
    with pytest.raises(ValueError):
        E.explain_row(found, 4)


def test_constant_and_zero_range_fields(numbered):
    rows = [(5, 1, 1.0)] * 9 + [(5, 100, float("inf"))]
    table = numbered(rows, "Same bigint, Nearly bigint, Open double")
    reasons = {(b.method, b.field): b.reason for b in A.review(table, with_forest=False).bounds}
    assert reasons["iqr", "Same"].startswith("At least four")
    assert reasons["iqr", "Nearly"] == "The interquartile range is zero."
    assert reasons["z_score", "Nearly"] is None


def test_booleans_and_identifiers_are_not_fields(numbered):
    table = numbered([(1, True, 2.0)], "CustomerID bigint, Flag boolean, Amount double")
    assert A.numeric_fields(table) == ["Amount"]


def test_generic_table_flags_one_row(numbered):
    found = A.review(numbered([(10, "a"), (11, "a"), (12, "b"), (100, "b")], "Amount bigint, Grp string"))
    assert A.anomaly_summary(found).first()["anomaly_rows_count"] == 1
    assert A.retail_context(found) is None


def test_signals_do_not_depend_on_partitions(planted):
    def votes(frame):
        rows = A.review(frame).rows.select("row_number", "votes", F.round("forest_score", 9)).collect()
        return sorted(map(tuple, rows))

    assert votes(planted) == votes(planted.repartition(11))


def test_forest_sample_is_bounded_and_exact(numbered):
    table = numbered([(float(i), float(i * 7 % 101)) for i in range(3_000)], "a double, b double")
    gate = FR.ForestGate(["a", "b"], 3_000)
    bounded = [r[0] for r in FR.forest_sample(table, gate, 2).orderBy("rank").select("row_number").collect()]
    keys = table.select("row_number", F.md5(F.concat(F.col("row_number").cast("string"), F.lit("-42"))).alias("k"))
    expected = [r[0] for r in keys.orderBy("k").limit(512).collect()]
    assert bounded == expected


def test_rows_are_scored_in_place(numbered, spark, tmp_path):
    rows = [(float(i % 50), float(i * 13 % 47)) for i in range(300)]
    numbered(rows, "a double, b double").write.parquet(str(tmp_path / "t"))
    found = A.review(spark.read.parquet(str(tmp_path / "t")))

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    for frame, times in ((found.rows, 1), (found.rows.filter("votes > 0"), 1), (found.flagged, 0)):
        assert plan(frame).count("ArrowEvalPython") == times
        assert "Join" not in plan(frame) and "Exchange" not in plan(frame)
    assert "EqualTo(row_number,7)" in plan(found.row(7))  # no other row is read, so none is scored
    assert found.row(7).collect() == found.rows.filter("row_number = 7").collect()


def test_method_table_tells_how_the_forest_was_fitted(numbered):
    rows = [(float(i % 50), float(i * 13 % 47)) for i in range(300)]
    counts = {r["method"]: (r["training_rows"], r["contamination"]) for r in A.method_counts(A.review(numbered(rows, "a double, b double"))).collect()}
    assert counts == {"iqr": (None, None), "z_score": (None, None), "isolation_forest": (300, 0.01)}
    closed = A.method_counts(A.review(numbered(rows[:10], "a double, b double"))).filter("method = 'isolation_forest'").first()
    assert (closed["training_rows"], closed["contamination"]) == (None, None)


def test_forest_finds_the_far_point(numbered):
    rows = [(float(i % 50), float(i * 13 % 47)) for i in range(2_000)] + [(5_000.0, -5_000.0)]
    table = numbered(rows, "a double, b double")
    fitted = FR.fit_forest(table, FR.ForestGate(["a", "b"], len(rows)))
    scored = table.select("row_number", fitted.score(table).alias("s"))
    assert scored.orderBy("s").first()["row_number"] == len(rows)
    share = scored.filter("s < 0").count() / len(rows)
    assert 0.002 < share <= 0.0105
    assert fitted.training_rows == len(rows)


def test_incomplete_rows_are_not_scored(numbered):
    rows = [(float(i), float(i % 5)) for i in range(30)] + [(None, 1.0), (float("inf"), 1.0)]
    table = numbered(rows, "a double, b double")
    found = A.review(table)
    assert found.forest.evaluated_rows == 30
    assert found.rows.filter(F.col("forest_score").isNull()).count() == 2
