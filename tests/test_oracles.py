"""Every query that has SQL gives DuckDB's rows over sf0.001."""
import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == plain(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in entry.queries() if k not in SQL and not k.startswith(("op", "pipeline"))))
def test_others_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
