"""The driver's contract: every query has a result on the smallest tables, and the entry does not need its working folder."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not re.match(r"op[0-9]+_", n) and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def shown(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return [shown(y) for y in x]
    return str(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, SMALL)
    rows = [tuple(r[c] for c in sorted(out.columns)) for r in out.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(out.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    same = lambda rs: sorted((tuple(map(shown, r)) for r in rs), key=repr)
    assert same(rows) == same(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
