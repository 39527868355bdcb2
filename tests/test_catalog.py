"""Catalog operations, report and fault injection."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators.faults import inject_faults
from plumbline.plans.report import Report, build_report, read_report
from plumbline.sources import catalog as C
from plumbline.sources.storage import pin


@pytest.fixture
def records(spark):
    rows = [
        (1, "a.csv", "uploads/a.csv", 2, 1, "same"),
        (2, "b.csv", "uploads/b.csv", 2, 1, "other"),
        (3, "c.csv", "uploads/x/../c.csv", 2, 1, "same"),
        (4, "d.csv", "uploads/../secret.csv", 2, 1, "same"),
        (5, "e.csv", "/uploads/e.csv", 2, 1, "fifth"),
    ]
    schema = "id bigint, file_name string, file_path string, rows_count bigint, columns_count bigint, text string"
    return C.with_fingerprint(spark.createDataFrame(rows, schema), "text")


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


def test_paths_stay_below_the_root(records):
    found = {r["id"]: r["resolved_path"] for r in C.valid_paths(records).collect()}
    assert found == {1: "uploads/a.csv", 2: "uploads/b.csv", 3: "uploads/c.csv"}


def test_path_folding(spark):
    paths = ["a/b/../../../c", "./a//b/.", "/a/../b", "..", "uploads", "uploads/", "a/../uploads/x"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in frame.select(C.normal_path(F.col("p"))).collect()] == [
        "../c", "a/b", "/b", "..", "uploads", "uploads", "uploads/x"]


def test_newest_of_each_content(records, spark):
    assert ids(C.latest_distinct(C.valid_paths(records))) == [2, 3]
    allowed = spark.createDataFrame([("uploads/a.csv",), ("uploads/b.csv",)], "file_path string")
    assert ids(C.latest_distinct(records, allowed)) == [1, 2]


def test_existing_copy(records):
    uploads = records.withColumn("upload_id", F.col("id") + 100)
    found = {r["upload_id"]: r["existing_id"] for r in C.find_duplicates(uploads, C.valid_paths(records)).collect()}
    assert found == {101: 3, 102: 2, 103: 3, 104: 3, 105: None}


def test_group_removal(records):
    marked = C.remove_group(records, 1)
    assert ids(marked.filter("status = 'removed'")) == [1, 3, 4]
    assert tuple(C.removal_counts(marked).first()) == (3, 2)
    with pytest.raises(ValueError):
        C.remove_group(records, 99)


def test_refresh(records, spark):
    sources = spark.createDataFrame(
        [("uploads/a.csv", 9, 9), ("uploads/new.csv", 1, 2)], "file_path string, rows_count bigint, columns_count bigint")
    names = spark.createDataFrame([("uploads/a.csv", "Sample A")], "file_path string, display_name string")
    found = {r["file_path"]: r for r in C.refresh(records, sources, names).collect()}
    assert (found["uploads/a.csv"]["file_name"], found["uploads/a.csv"]["rows_count"]) == ("Sample A", 9)
    assert (found["uploads/new.csv"]["action"], found["uploads/new.csv"]["file_name"]) == ("inserted", "new.csv")
    assert found["uploads/b.csv"]["action"] == "kept"


def test_search_order(records, spark):
    positions = spark.createDataFrame([(2, 0), (4, 1)], "id bigint, position int")
    assert [r["id"] for r in C.search(records, "CSV", positions).collect()] == [2, 4, 5, 3, 1]
    assert ids(C.search(records, "B.c")) == [2]


def test_table_fingerprint_ignores_order(spark):
    table = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(100)], "a bigint, b string")
    swapped = table.select(F.col("b").alias("a"), F.col("a").alias("b"))
    first = C.table_fingerprint(table).first()
    assert first == C.table_fingerprint(table.repartition(7)).first()
    assert first != C.table_fingerprint(swapped).first()
    assert first != C.table_fingerprint(table.filter("a > 0")).first()


def test_faults(numbered):
    table = numbered([(f"b{i}", float(i + 1), 100) for i in range(1_000)], "Branch string, Price double, Total bigint")
    found = inject_faults(table, "Branch", "Price", "Total")
    assert found.count() == 1_000
    assert found.filter("Branch is null").count() == 100
    assert found.filter("Price < 0").count() == 40
    assert found.filter("Total = 125").count() == 80
    rows = {r["row_number"]: r["Branch"] for r in found.filter("row_number between 345 and 435").collect()}
    assert rows[351] == rows[401] == "b400" and rows[380] == rows[430] and rows[350] == "b349" and rows[381] == "b380"


def test_report(numbered, tmp_path, spark):
    table = numbered([(10, "a"), (11, "a"), (12, "b"), (100, "b")], "Amount bigint, Grp string")
    report = build_report(table)
    headline = report.tables["headline"].first()
    assert headline["flagged_rows"] == "1"
    scores = {r["dimension"]: r["score"] for r in report.tables["dimensions"].collect()}
    assert scores["Validity"] == "Not evaluated" and scores["Consistency"] == "Not evaluated"
    assert "retail_context" not in report.tables
    example = report.tables["examples"].first()
    assert example["row_number"] == 4 and "Amount is above the IQR boundary." in example["evidence"]
    folder = str(tmp_path / "report")
    report.write(folder)
    stored = read_report(spark, folder)
    assert list(stored.tables) == list(report.tables)
    assert all(stored.tables[n].collect() == t.collect() for n, t in report.tables.items())
    assert "## Headline" in report.markdown() == stored.markdown()


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def test_a_report_is_written_as_one(spark, tmp_path):
    folder = tmp_path / "report"

    def version(n):
        return Report({"columns": spark.createDataFrame([(i, n) for i in range(3)], "ordinal int, n int"),
                       "examples": spark.createDataFrame([(n,)], "n int")})

    with pytest.raises(ValueError, match="no report"):
        read_report(spark, str(folder))
    first = version(1).write(str(folder))
    assert names(folder) == sorted([first, "manifest.json"])
    open_reader = read_report(spark, str(folder))
    broken = Report({**version(2).tables, "examples": spark.range(1).select(F.raise_error(F.lit("lost")).alias("n"))})
    with pytest.raises(Exception, match="lost"):
        broken.write(str(folder))
    assert names(folder) == sorted([first, "manifest.json"])
    assert read_report(spark, str(folder)).tables["examples"].first()["n"] == 1
    second = version(2).write(str(folder))
    assert names(folder) == sorted([first, second, "manifest.json"])
    assert open_reader.tables["examples"].first()["n"] == 1
    third = version(3).write(str(folder))
    assert names(folder) == sorted([second, third, "manifest.json"])
    found = read_report(spark, str(folder)).tables
    assert [tuple(r) for r in found["columns"].collect()] == [(0, 3), (1, 3), (2, 3)]


def test_facts_of_very_wide_tables_are_stored(spark):
    facts = spark.range(50).select("id", (F.col("id") * 2).alias("n"))
    for most in (10, 50):
        kept = pin(facts, most)
        assert sorted(kept.collect()) == sorted(facts.collect()) and kept.dtypes == facts.dtypes
    assert not pin(facts, 50).inputFiles() and pin(facts, 10).inputFiles()
