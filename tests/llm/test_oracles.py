import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare

from lattica.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    assert compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.01") > 0
