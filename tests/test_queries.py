"""Every query with SQL gives the same rows in both engines; none is empty."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from loamlog.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return round(value, 6) if isinstance(value, float) else value


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_sql_belongs_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted_rows(df.collect(), df.columns)
    assert got[0]
    if name in ORACLE_SQL:
        cursor = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert got == sorted_rows(cursor.fetchall(), columns)
