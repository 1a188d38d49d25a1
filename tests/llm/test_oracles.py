import pytest

from corvidex.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
