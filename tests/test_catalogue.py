"""Every query against its SQL in another engine."""

import math
import os

import duckdb
import pytest

from veritab.plans import catalogue
from veritab.plans.views import TABLES

DIR = os.environ.get("VERITAB_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(tuple(str(plain(row[i])) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, sql, name):
    found = catalogue.run(spark, name, DIR)
    expected = sql.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.run(spark, name, DIR).count() >= 0
