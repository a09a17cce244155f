"""Every query that SQL can express equals its SQL in DuckDB on the smallest tables; all others run."""

import math
import os

import duckdb
import pytest

from lumenloft import queries as core
from lumenloft.plans.adapters import TABLES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in core.oracle_sql():
        assert got
        return
    cur = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in cur.fetchall())
    assert got == want


def test_entry_without_session():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "day_summary" in e.queries()
