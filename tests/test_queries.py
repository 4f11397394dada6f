"""Every query of the engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridweave.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "nan", "None", "NaT"):
        return "~"
    return str(v)[:10] if hasattr(v, "year") else str(v) if isinstance(v, (str, bool)) else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, oracle, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), oracle.sql(registry.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda d: sorted((tuple(plain(v) for v in r) for r in d[columns].astype(object).itertuples(index=False)), key=str)
    assert rows(ours) == rows(theirs)


def test_entry_without_driver(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
