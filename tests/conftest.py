import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Compare a query with its SQL: columns, types and rows in any order."""
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    key = lambda r: tuple((v is None, str(v)) for v in r)

    def check(query, sql):
        df, e = query(spark, sf_dir), duck.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(e.columns)
        assert [kinds[dict(df.dtypes)[c]] for c in cols] == [str(e.types[e.columns.index(c)]) for c in cols]
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
        want = sorted((tuple(r[e.columns.index(c)] for c in cols) for r in e.fetchall()), key=key)
        assert got == want
        return got

    return check
