"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import glob
import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def names():
    from sparkloom.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from sparkloom.plans import registry

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, (plain(r[c]) for c in columns))) for r in df.collect())
    rel = con.execute(registry.oracle_sql()[name])
    found = [x[0] for x in rel.description]
    assert sorted(found) == columns
    want = sorted(tuple(str(plain(r[found.index(c)])) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
