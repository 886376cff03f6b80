from __future__ import annotations

import pytest

from conftest import same_as_oracle
from siftspark.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_as_oracle(spark, duck, queries.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
