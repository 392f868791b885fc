import math

import duckdb
import pytest

import __spark_entry__ as entry
from sedimenta.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", SQL)
def test_spark_and_duckdb_agree(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SQL])
def test_other_queries_run(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "primary_threat", "severity", "payloads", "total_risk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
