"""Every registered query against its DuckDB equivalent, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE_SQL:
        r = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_entry_points(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
