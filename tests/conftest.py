import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from orebody.workspace import ship_package

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def same(spark, sql):
    def check(query, text):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        found = sql.execute(text)
        at = [c[0] for c in found.description]
        assert sorted(at) == names
        want = [tuple(_plain(r[at.index(n)]) for n in names) for r in found.fetchall()]
        have = [tuple(map(_plain, r)) for r in df.select(names).collect()]
        assert sorted(map(repr, have)) == sorted(map(repr, want))

    return check
