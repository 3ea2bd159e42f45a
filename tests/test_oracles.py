"""Every query with SQL against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL = {k: v for k, v in entry.oracle_sql().items()}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, bool):
        return int(x)
    return x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", [k for k in sorted(SQL) if k in os.environ.get("ONLY", k).split()])
def test_against_duckdb(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    expected = rows([d[0] for d in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    wrong = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    assert not wrong, f"{len(wrong)} rows differ: {wrong[:3]}"
    assert got[1], "no rows"
