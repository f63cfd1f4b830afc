"""Each registered query of the domain against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from trendlake import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    r = con.sql(catalog.ORACLES[name])
    names = r.columns
    assert sorted(names) == cols
    want = [tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()]
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_lines_with_equal_numbers_and_dates(spark, tmp_path):
    """Of an order's equal lines the first in the table counts, as in SQL."""
    con, path = duckdb.connect(), tmp_path / "lineitem.parquet"
    con.sql(f"copy (select i // 4 as l_orderkey, 100 - (i * 7) % 50 as l_suppkey, 1 as l_linenumber, 'N' as l_returnflag, timestamp '2024-01-01' as l_shipdate from range(400) t(i) order by i) to '{path}' (format parquet)")
    con.sql(f"create view lineitem as select * from '{path}'")
    got = catalog.QUERIES["accepted_places"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["accepted_places"]).fetchall())
