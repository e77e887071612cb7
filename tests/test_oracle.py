"""Every catalog query against its SQL on DuckDB, over the smallest tables; all others must run."""

import math

import duckdb
import pytest

from hammerline import registry
from hammerline.plans.standins import TABLES

SF = "/root/testdata/sf0.001"
KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    res = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in res.description}
    assert {c: KIND[t] for c, t in df.dtypes} == kinds
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in res.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
