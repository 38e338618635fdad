import os

import pytest

from oracle import DATA, assert_equal
from quernstone.plans import oracles, queries

Q, O = queries.queries(), oracles.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_oracle(spark, name):
    assert_equal(spark, Q[name], O[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_query_without_oracle_runs(spark, name):
    assert Q[name](spark, DATA).count() >= 0
