"""Registered queries against their SQL twins on the smallest data, and the driver contract."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_oracle  # noqa: E402
from plumbline.plans.oracle import SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def database():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, database, name):
    message, good = check_oracle.compare(spark, database, SF_DIR, name)
    assert good, message


def test_contract(spark):
    found = check_oracle.entry.entry(spark)
    assert found.count() == 1 and "overall_quality_score" in found.columns
    assert set(check_oracle.entry.oracle_sql()) <= set(check_oracle.entry.queries())
