"""Every registered query against its SQL twin on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from verification import base

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = base.QUERIES, base.ORACLES
TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def _cell(v):
    missing = v is None or (isinstance(v, float) and math.isnan(v))
    return (0, "") if missing else (1, v)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[t] for c, t in frame.dtypes} == kinds
    assert _rows(frame.collect(), frame.columns) == _rows(cursor.fetchall(), names)


def test_entry_returns_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(base.QUERIES) == set(base.ORACLES)
