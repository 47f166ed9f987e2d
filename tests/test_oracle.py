"""Every query that has SQL gives the rows that DuckDB gives on the same tables."""

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tallyspark.plans.oracle import ORACLE_SQL
from tallyspark.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, date, datetime)):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.6f}" if x else "0.000000"
    return str([plain(y) for y in x])


def compare(spark, name, folder=DATA):
    df = QUERIES[name](spark, str(folder))
    own = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    other = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert len(own) == len(other)
    assert own == other


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name)
