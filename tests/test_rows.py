import pytest
from pyspark.sql import functions as F

from plumbline.plans import ledger, retail
from plumbline.sources import rows


@pytest.fixture
def no_small_tables(spark):
    """Sizes as large tables have them: Spark broadcasts nothing by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_numbers_meet_rows_without_an_exchange(spark, no_small_tables, capsys, tmp_path):
    """Only one row a written partition, or file, is exchanged; the table itself stays where it was written."""
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("key"), F.lit("x").alias("text"))
    numbered = rows.number_by(df, ["key"], "numbered")
    assert [tuple(r) for r in numbered.orderBy("key").select("key", "row_number").collect()] == [(i, i + 1) for i in range(1000)]
    df.repartition(4).write.parquet(str(tmp_path / "files"))
    for frame in (numbered, rows.number_files(spark.read.parquet(str(tmp_path / "files")))):
        capsys.readouterr()
        frame.explain()
        plan = capsys.readouterr().out
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_columns_after_the_sort_are_those_before_it(spark):
    df = spark.range(200).select((F.col("id") * 11 % 200).alias("key"))
    made = [F.concat(F.lit("k"), F.col("key").cast("string")).alias("name")]
    late = rows.stored_by(df, ["key"], "late", columns=made)
    early = rows.stored_by(df.select("key", *made), ["key"], "early").select("name", "row_number")
    assert late.columns == ["name", "row_number"]
    assert sorted(late.collect()) == sorted(early.collect())


def test_what_is_sorted_is_narrower_than_the_table(spark):
    """The texts that are made of keys are not exchanged."""
    sf = "/root/testdata/sf0.001"
    made = {"InvoiceNo", "StockCode", "Description", "Quantity"}
    assert not made & set(retail.retail_base(spark, sf).columns)
    assert retail.stored_retail(spark, sf).columns == [*retail.RETAIL_COLUMNS, "row_number"]
    assert ledger.stored_ledger(spark, sf).columns[0] == "Order Key"


def plan_of(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_retail_lines_are_exchanged_once_after_their_parts(spark, no_small_tables, capsys):
    """The exchange in which lines meet orders is the one the table is sorted by."""
    base = retail.retail_base(spark, "/root/testdata/sf0.001")
    plan = plan_of(base.orderBy(*retail.ROW_KEYS), capsys)
    assert plan.count("rangepartitioning(") == 1
    assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(OrderKey" not in plan


def test_retail_base_has_the_rows_of_a_join(spark, tmp_path):
    """Orders that are missing, doubled or without a customer, and lines without a key or a part."""
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_shipdate date",
                     [(o, p, 1, n, 2.0, flag, None) for o, p, n, flag in
                      [(1, 1, 1, "R"), (1, 26, 2, "N"), (2, 1, 1, "N"), (7, 1, 1, "N"), (7, 1, 1, "N"), (8, 9, 1, "N"),
                       (9, 1, 1, "N"), (None, 1, 1, "N"), (10, None, 1, "N"), (99, 1, 1, None)]]),
        "part": ("p_partkey long, p_name string, p_retailprice double", [(1, "one", 3.0), (26, None, None)]),
        "orders": ("o_orderkey long, o_custkey long",
                   [(1, 5), (2, 5), (2, 6), (7, 6), (8, 5), (9, None), (None, 5), (10, 5), (11, 5), (12, 77)]),
        "customer": ("c_custkey long, c_nationkey int", [(5, 0), (6, 1)]),
        "nation": ("n_nationkey int, n_name string", [(0, "HERE"), (1, None)]),
    }
    for name, (schema, listed) in tables.items():
        spark.createDataFrame(listed, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = retail.retail_base(spark, str(tmp_path)).select("OrderKey", "PartKey", "LineTotal", "o_custkey", "Country", "Copy")
    joined = [(1, 1, -6.0 + 25, 5, "HERE", 0), (1, 26, None, 5, "HERE", 0), (2, 1, 31.0, 5, "HERE", 0), (2, 1, 31.0, 6, None, 0),
              *[(7, 1, 31.0, 6, None, copy) for copy in (0, 0, 1, 1)]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(joined, key=str)


def test_a_range_of_the_retail_table_is_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(retail, "ROWS_A_RANGE", 100)
    base = retail.retail_base(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in base.groupBy(F.spark_partition_id().alias("range")).count().collect()]
    assert len(sizes) >= 50 and max(sizes) < 500


def test_numbered_tables_are_stored_small(spark):
    stored = rows.stored_by(spark.range(100).select("id"), ["id"], "small")
    assert all(".zstd." in name for name in stored.inputFiles())


@pytest.mark.parametrize("name", ["ledger_numbers", "ledger_summary", "ledger_roles", "ledger_totals", "ledger_kinds"])
def test_ledger_queries_without_row_numbers_store_nothing(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("The ledger was numbered and stored.")

    monkeypatch.setattr(ledger, "stored_ledger", refuse)
    assert getattr(ledger, name)(spark, "/root/testdata/sf0.001").count()


def test_the_ledger_is_the_stored_one(spark):
    sf = "/root/testdata/sf0.001"
    stored = ledger.stored_ledger(spark, sf).drop("row_number")
    read = ledger.ledger_table(spark, sf)
    assert read.schema.simpleString() == stored.schema.simpleString()
    assert read.exceptAll(stored).isEmpty() and stored.exceptAll(read).isEmpty()
