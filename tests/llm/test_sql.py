"""The operators' queries against their SQL, on the smallest tables."""

from pathlib import Path

import pytest

from reelquery.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, same, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)
