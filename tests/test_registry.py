"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ == "NAType":
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = __spark_entry__.queries()[name](spark, DIR).toPandas()
    assert rows(ours) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
