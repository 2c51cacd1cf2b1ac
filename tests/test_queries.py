"""Every query of the library's own operators: its rows are those of its SQL in DuckDB, over the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from tessera.plans.registry import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int | float | Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, list | tuple):
        return "[" + ", ".join(map(plain, x)) + "]"
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, SF_DIR)
    rows = found.collect()
    if name in ORACLE_SQL:
        cursor = con.execute(ORACLE_SQL[name])
        assert table(found.columns, rows) == table([d[0] for d in cursor.description], cursor.fetchall())
    else:
        assert found.columns
