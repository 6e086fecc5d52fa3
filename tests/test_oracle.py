"""Every registered query against its DuckDB oracle on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from vitrine.plans import QUERIES

from conftest import SF_SMALL

DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
                 "DATE": "date", "TIMESTAMP": "timestamp"}
RAW = ["region", "nation", "supplier", "part", "orders", "events"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, dict)):
        return str(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    df = q.build(spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = q.oracle()
    if sql is None:
        pytest.fail(f"{name} has no oracle")
    res = duck.execute(sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    types = {c[0]: DUCK_TO_SPARK.get(str(c[1]), str(c[1]).lower().replace(" ", "")) for c in res.description}
    assert types == dict(df.dtypes)
    assert _rows(df.columns, rows) == _rows(cols, res.fetchall())
