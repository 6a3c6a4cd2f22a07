import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert {f"p{n}_found" for n in range(1, 8)} <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Their SQL supposes longer series than those of the smallest tables.
LONGER = ("adf", "kpss", "univariate", "feature_selection")


@pytest.mark.parametrize("name", sorted(n for n in SQL if n not in LONGER))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
