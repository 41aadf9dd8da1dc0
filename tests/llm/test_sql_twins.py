import pytest

from oracle import compare
from perkline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, sf_dir, name):
    n, here, there = compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)
    assert n > 0 and not here and not there
