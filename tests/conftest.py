import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-tests-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    d = "/root/testdata/sf0.001"
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    return con


def same_rows(got, columns, want):
    """Rows of Spark and of DuckDB as multisets, columns by name, floats to six digits."""
    names = sorted(columns)
    assert names == sorted(want.columns)
    norm = lambda x: round(x, 6) if isinstance(x, float) else x
    a = sorted((tuple(norm(r[c]) for c in names) for r in got), key=repr)
    at = [want.columns.index(c) for c in names]
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b
