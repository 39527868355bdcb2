"""Profiles, quantiles, row numbers and readers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import profile as P
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources import readers
from plumbline.sources.rows import number_by, number_files


def test_profile_of_mixed_columns(numbered):
    rows = [(i, f"2025-01-{i % 28 + 1:02d}", "ab"[i % 2], float(i) if i % 4 else None, True) for i in range(1, 41)]
    table = numbered(rows, "UserID bigint, Day string, Kind string, Amount double, Flag boolean")
    types = P.logical_types(table)
    assert types == {"UserID": "identifier", "Day": "datetime", "Kind": "categorical", "Amount": "numeric",
                     "Flag": "numeric"}
    assert types == {r["column_name"]: r["logical_type"] for r in P.column_profile(table).collect()}
    facts = {r["column_name"]: r for r in P.column_profile(table).collect()}
    assert facts["Amount"]["missing_count"] == 10 and facts["Amount"]["missing_percentage"] == 25.0
    assert facts["Kind"]["unique_count"] == 2 and facts["UserID"]["unique_count"] == 40
    samples = [r["value"] for r in P.column_samples(table).filter("ordinal = 4").orderBy("position").collect()]
    assert samples == ["1.0", "2.0", "3.0", "5.0", "6.0"]
    top = P.top_values(table, ["Kind"]).orderBy("position").collect()
    assert [(r["value"], r["value_count"]) for r in top] == [("a", 20), ("b", 20)]
    dates = P.date_range(table, ["Day"]).first()
    assert (dates["minimum"], dates["maximum"]) == ("2025-01-01T00:00:00", "2025-01-28T00:00:00")


def test_numeric_summary_hides_non_finite(numbered):
    found = P.numeric_summary(numbered([(1.0,), (2.0,), (float("inf"),)], "Amount double"), ["Amount"]).first()
    assert found["value_count"] == 3 and found["mean"] is None and found["maximum"] is None
    assert found["minimum"] == 1.0
    found = P.numeric_summary(numbered([(1.0,), (2.0,), (3.0,), (float("inf"),)], "Amount double"), ["Amount"]).first()
    assert (found["q25"], found["q50"], found["q75"]) == (1.75, 2.5, None)


def test_booleans_and_empty_lists(numbered):
    table = numbered([(True, 1), (False, 2), (True, 3), (None, 4)], "Flag boolean, N bigint")
    assert [tuple(r) for r in P.boolean_summary(table, ["Flag", "N"]).collect()] == [(1, "Flag", 3, 2, "true", 2)]
    assert [r["column_name"] for r in P.numeric_summary(table, ["Flag", "N"]).collect()] == ["N"]
    assert P.numeric_summary(table, []).count() == P.date_parse_ratio(table).count() == P.date_range(table, []).count() == 0
    assert P.top_values(table, []).count() == P.boolean_summary(table, ["N"]).count() == 0


def test_dates_that_turn_to_junk_late_are_text(numbered):
    rows = [(f"2025-01-{i % 28 + 1:02d}",) for i in range(1_000)] + [(f"junk {i}",) for i in range(1_000)]
    table = numbered(rows, "Day string")
    assert P.logical_types(table) == {"Day": "text"}
    assert P.date_parse_ratio(table).first()["parse_ratio"] == 0.5


def test_assembled_profile_picks_what_each_column_needs(numbered):
    rows = [(i, f"2025-01-{i % 28 + 1:02d}", "ab"[i % 2], float(i) if i % 4 else None, i % 3 == 0) for i in range(1, 41)]
    table = numbered(rows, "UserID bigint, Day string, Kind string, Amount double, Flag boolean")
    found = P.profile_table(table)
    assert found.types == P.logical_types(table)
    assert [r["column_name"] for r in found.numbers.collect()] == ["Amount"]
    assert [r["column_name"] for r in found.booleans.collect()] == ["Flag"]
    assert [(r["column_name"], r["maximum"]) for r in found.dates.collect()] == [("Day", "2025-01-28T00:00:00")]
    assert {(r["ordinal"], r["value"], r["value_count"]) for r in found.common.collect()} == {(3, "a", 20), (3, "b", 20)}
    assert found.samples.count() == 25


def test_text_by_distinct_share(numbered):
    table = numbered([(f"word {i}",) for i in range(200)], "Note string")
    assert P.logical_types(table) == {"Note": "text"}


def test_all_missing_column_has_no_values(numbered):
    table = numbered([(None, 1)], "Empty string, Value bigint")
    counts = {r["column_name"]: r["unique_count"] for r in P.column_unique(table).collect()}
    assert counts == {"Empty": 0, "Value": 1}


def test_sketched_distinct_counts(numbered):
    table = numbered([(i, "x") for i in range(2_000)], "N bigint, S string")
    counts = {r["column_name"]: r["unique_count"] for r in P.column_unique(table, relative_error=0.02).collect()}
    assert abs(counts["N"] - 2_000) < 200 and counts["S"] == 1


def test_first_values_widen_to_late_cells(numbered):
    rows = [(None if i < 5_000 else f"v{i}", i) for i in range(6_000)]
    table = numbered(rows, "Late string, N bigint")
    found = P.first_values(table, ["Late", "N"], 5).orderBy("ordinal", "position").collect()
    assert [r["value"] for r in found] == [f"v{i}" for i in range(5_000, 5_005)] + [str(i) for i in range(5)]


@pytest.mark.parametrize("gather", [1, 10, 10_000])
def test_narrowed_quantiles_equal_numpy(spark, gather):
    draw = random.Random(7)
    spread = [draw.choice([0.0, 1.0, -3.5, draw.gauss(0, 1e6), draw.random()]) for _ in range(3_000)]
    hot = [5.0] * 2_000 + [float(i) for i in range(1_000)]
    extreme = [draw.choice([1e308, -1e308, 1e-300, 2.0, draw.random()]) for _ in range(3_000)]
    rows = list(zip(spread, hot, extreme))
    table = spark.createDataFrame(rows, "spread double, hot double, extreme double").repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    counts = dict.fromkeys(table.columns, len(rows))
    direct = exact_quantiles(table, counts, shares)
    narrow = exact_quantiles(table, counts, shares, gather_rows=gather)
    assert direct == narrow
    for name, values in (("spread", spread), ("hot", hot)):
        expected = np.quantile(values, shares)
        assert np.allclose(direct[name], expected, rtol=1e-12)
        assert np.allclose(narrow[name], expected, rtol=1e-12)
    ordered = sorted(extreme)
    assert narrow["extreme"][0] == ordered[0] and narrow["extreme"][-1] == ordered[-1]


def test_row_numbers_follow_the_key(spark):
    values = list(range(5_000))
    random.Random(3).shuffle(values)
    table = spark.createDataFrame([(v,) for v in values], "k bigint").repartition(9)
    found = number_by(table, ["k"], "test")
    assert found.filter(F.col("row_number") != F.col("k") + 1).count() == 0
    assert found.count() == 5_000


def test_row_numbers_of_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1_000).repartitionByRange(4, "id").write.parquet(path)
    found = number_files(spark.read.parquet(path))
    stats = found.agg(F.min("row_number"), F.max("row_number"), F.count_distinct("row_number")).first()
    assert tuple(stats) == (1, 1_000, 1_000)


def test_lenient_numbers(spark):
    texts = ["1", " -2.5 ", "1e3", ".5", "5.", "1d", "0x1p3", "inf", "nan", "", "abc", "1,000", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(S.text_number(F.col("t"))).collect()]
    assert found == [1.0, -2.5, 1000.0, 0.5, 5.0, None, None, float("inf"), None, None, None, None, None]


def test_dates(spark):
    texts = ["2025-01-31", "2025-01-31T10:20:30", "1/2/2025", "12/1/2010 8:26", "31-12-2024", "2025", "soon",
             "2025-13-01", "3 Mar 2024", "2025-01-31 10:20:30.5", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(S.iso_text(S.parse_date(F.col("t")))).collect()]
    assert found == ["2025-01-31T00:00:00", "2025-01-31T10:20:30", "2025-01-02T00:00:00", "2010-12-01T08:26:00",
                     "2024-12-31T00:00:00", None, None, None, "2024-03-03T00:00:00", "2025-01-31T10:20:30", None]


def test_general_number_text(spark):
    values = [0.0, 30.0, 0.5, 1234.5678, 0.1, -2.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in frame.select(S.six_digits(F.col("v"))).collect()] == [f"{v:g}" for v in values]


def test_report_texts(spark):
    frame = spark.createDataFrame([("a\tb<c>&\"'",), ("x" * 20,), (None,)], "t string")
    assert [r[0] for r in frame.select(S.report_text(F.col("t"), 18)).collect()] == [
        "a b&lt;c&gt;&amp;&quot;&#x27;", "x" * 15 + "...", "Not available"]
    names = ["C:\\data\\sales:2024?.CSV", "plain.xlsx", " .csv", "uploads/a.b.csv"]
    frame = spark.createDataFrame([(n,) for n in names], "t string")
    assert [r[0] for r in frame.select(S.report_name(F.col("t"))).collect()] == [
        "Data Quality Report - sales_2024_.pdf", "Data Quality Report - plain.pdf",
        "Data Quality Report - Dataset.pdf", "Data Quality Report - a.b.pdf"]
