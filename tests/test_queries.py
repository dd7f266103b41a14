"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cohortmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs
