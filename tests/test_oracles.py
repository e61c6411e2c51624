"""Every query of the reference's operators against its SQL, and that those without SQL run."""

import pytest

from tessel.queries import QUERIES, SQL
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0
