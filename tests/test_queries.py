import os

import pytest
from oracle import compare

from auditlake.queries import ORACLES, QUERIES


#: Large enough that no query is empty.
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name])
