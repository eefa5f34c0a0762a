import os

import oracle
import pytest

from factgate.plans.oracles import ORACLES
from factgate.plans.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="the driver's tables are not here")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    oracle.same(QUERIES[name](spark, oracle.SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
