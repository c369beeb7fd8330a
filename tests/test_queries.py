"""Every registered query of the engine against its SQL."""

import pytest

from corpusloom.plans import catalogue

from .conftest import canonical

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    rows = want.fetchall()
    assert rows, "an empty result proves nothing"
    assert canonical(got.columns, got.collect()) == canonical(want.columns, rows)


def test_flagship(spark, sf_dir):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries())
    assert catalogue.flagship(spark, sf_dir).count() > 0
