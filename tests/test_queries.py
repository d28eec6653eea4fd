"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    found = contract.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = Counter(str([plain(r[c]) for c in columns]) for r in found.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(str([plain(row[i]) for i in order]) for row in answer.fetchall())
    assert rows == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 1
