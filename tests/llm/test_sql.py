"""Registered operators against their SQL on the smallest tables."""

import pytest
from compare import connect, differences

from eventide.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name]) == []
