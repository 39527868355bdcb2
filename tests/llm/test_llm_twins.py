"""Every SQL twin of the package against its query on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))
import check_oracle  # noqa: E402
from plumbline.llm.oracle import SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    message, good = check_oracle.compare(spark, check_oracle.connect(SF), SF, name)
    assert good, message
