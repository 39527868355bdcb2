import os
import sys

import pytest
from pyspark.sql import SparkSession, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def numbered(spark):
    """A small table with row numbers, from rows and a schema."""

    def build(rows, schema, partitions=3):
        listed = [(i, *row) for i, row in enumerate(rows, 1)]
        frame = spark.createDataFrame(listed, "row_number bigint, " + schema)
        return frame.repartition(partitions, F.col("row_number"))

    return build
