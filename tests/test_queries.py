"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        same_rows(rows, df.columns, duck.sql(ORACLES[name]))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
