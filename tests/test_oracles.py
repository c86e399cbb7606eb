"""Every query against its SQL, at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted(__spark_entry__.plans.ORACLE_SQL)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = sql.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
