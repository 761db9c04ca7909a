"""Every registered query of the ledger engine against its SQL at the smallest size."""

import os

import duckdb
import pytest

from tallyspark.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(rows, names, order):
    at = [names.index(k) for k in order]
    return sorted(tuple("∅" if r[i] is None else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        expected = db.sql(ORACLE_SQL[name])
        assert sorted(expected.columns) == sorted(df.columns)
        assert plain(rows, df.columns, sorted(df.columns)) == plain(expected.fetchall(), expected.columns, sorted(df.columns))


def test_hmac_forms_agree(spark):
    assert all(r["thread_key"] == r["inline_key"] for r in QUERIES["hmac_ids"](spark, SF).collect())
