"""A retail table with known faults, derived from the given tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.sources.rows import stored_by
from plumbline.sources.storage import store_once

RETAIL_COLUMNS = [
    "InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID",
    "Country", "LineNumber", "SuppKey", "OrderKey", "PartKey", "LineTotal",
]
ROW_KEYS = ["OrderKey", "PartKey", "SuppKey", "LineNumber", "LineTotal", "InvoiceDate", "Copy"]
ROWS_A_RANGE = 1 << 18


def _returned() -> Column:
    return F.col("l_returnflag") == "R"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the retail table is made of: order lines with their part, customer and nation, and the keys that
    rows are numbered by (``Copy`` tells the lines of repeated orders apart).

    Lines and orders are dealt in one exchange, to ranges of the order key, where they meet; the ranges stand
    in the order of the row numbers, so that sorting needs no exchange of its own.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    buyers = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("OrderKey"), F.struct("o_custkey", "n_name").alias("buyer"))
    )
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("OrderKey"),
        F.col("l_partkey").alias("PartKey"),
        F.col("l_suppkey").alias("SuppKey"),
        F.col("l_linenumber").alias("LineNumber"),
        F.col("l_shipdate").alias("InvoiceDate"),
        "l_quantity", "l_returnflag", "p_name", "p_retailprice", F.lit(True).alias("is_line"),
    )
    # Of a bounded size, so that a task sorts its range in memory however long the table is.
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(lines.count() / ROWS_A_RANGE))
    dealt = (
        sold.unionByName(buyers, allowMissingColumns=True).filter(F.col("OrderKey").isNotNull())
        .repartitionByRange(ranges, "OrderKey")
    )
    # Of an order there is one row; were there more, its lines would stand once for each, as a join has them.
    found = F.collect_list("buyer").over(Window.partitionBy("OrderKey"))
    # Each line once, and the lines of repeated orders twice, without joining twice.
    copies = F.when(F.col("OrderKey") % 200 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    total = (
        F.when(_returned(), -F.col("l_quantity")).otherwise(F.col("l_quantity")) * F.col("p_retailprice")
        + F.when(F.col("PartKey") % 25 == 1, 25.0).otherwise(0.0)
    )
    return (
        dealt.withColumn("buyers", found).filter("is_line")
        .withColumn("buyer", F.explode("buyers"))
        .withColumn("LineTotal", total)
        .select(
            "OrderKey", "PartKey", "SuppKey", "LineNumber", "LineTotal", "InvoiceDate", "l_quantity", "l_returnflag",
            "p_name", "p_retailprice", "buyer.o_custkey", F.col("buyer.n_name").alias("Country"),
        )
        .withColumn("Copy", F.explode(copies))
    )


def retail_columns() -> list[Column]:
    """Order lines as invoices, with missing customers, bad and negative quantities, odd prices,
    conflicting descriptions, wrong totals and repeated orders."""
    order, part, price = F.col("OrderKey"), F.col("PartKey"), F.col("p_retailprice")
    whole_quantity = F.col("l_quantity").cast("int").cast("string")
    made = {
        "InvoiceNo": F.when(_returned() & (part % 3 != 0), F.concat(F.lit("C"), order.cast("string")))
        .otherwise(order.cast("string")),
        "StockCode": F.concat(F.lit("P"), part.cast("string")),
        "Description": F.when((part % 50 == 0) & (F.col("LineNumber") == 1), F.upper("p_name")).otherwise(F.col("p_name")),
        "Quantity": F.when(order % 997 == 0, "bad").when(_returned(), F.concat(F.lit("-"), whole_quantity))
        .otherwise(whole_quantity),
        "UnitPrice": F.when(F.col("SuppKey") % 97 == 5, -price).when(order % 89 == 0, 0.0).otherwise(price),
        "CustomerID": F.when(order % 4 != 0, F.col("o_custkey")),
    }
    return [made[name].alias(name) if name in made else F.col(name) for name in RETAIL_COLUMNS]


def stored_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retail table as ingested: numbered in key order and stored once per application."""
    label = f"retail{sf_dir}"
    return store_once(
        spark, label, lambda: stored_by(retail_base(spark, sf_dir), ROW_KEYS, "retail", columns=retail_columns())
    )


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines, numbered in key order and stored once per application."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return store_once(
        spark, f"lineitem{sf_dir}",
        lambda: stored_by(table(spark, sf_dir, "lineitem"), keys, "lineitem"),
    )
