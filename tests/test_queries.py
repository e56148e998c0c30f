"""Every query against its SQL on the smallest data."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from planwright import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample data")


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return repr(round(float(x), 6) + 0.0)
    return x.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(x, datetime.datetime) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    mine = sorted(tuple(norm(r[k]) for k in names) for r in df.collect())
    r = duck.execute(Q.SQL[name])
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == names
    assert sorted(tuple(norm(row[theirs.index(k)]) for k in names) for row in r.fetchall()) == mine
